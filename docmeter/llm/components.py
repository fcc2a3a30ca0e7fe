"""Connected components of a link table by alternating large-star and small-star steps, each a pair of shuffles.

Every step is written to the shared folder, so a lost executor costs at most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmeter.llm.shared import forget, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: those above the node; small: those below, and the node) to the least of node and neighbours."""
    both = links.union(links.select("b", "a"))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    side = near.where("b > a") if large else near
    joined = side.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        joined = joined.union(least.select("a", F.col("m").alias("b")))
    return joined.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of 64-bit nodes -> (node, root): every node that has a link, with the least node of its component."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        last, links = links, written(_star(_star(links, True), False), "links")
        forget(last)
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        before = mark
