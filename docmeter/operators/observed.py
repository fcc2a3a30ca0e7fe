"""Counts that come with a result, from the same job (V5, J9, H5, Q3): Spark's observations, and a listener for streams."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from docmeter.operators import retrieval, usage


def with_counts(rows: DataFrame, name: str, /, **figures: Column) -> tuple[DataFrame, Observation]:
    """rows, and what its next action counts of them: `.get` waits for that action. A stream's go to Figures by `name`."""
    seen = Observation(name)
    aggregates = [c.alias(k) for k, c in figures.items()]
    return (rows.observe(name, *aggregates) if rows.isStreaming else rows.observe(seen, *aggregates)), seen


def sized_vectors(vectors: DataFrame, column: str, dim: int, name: str = "vectors") -> tuple[DataFrame, Observation]:
    """V5: the vectors of the right size, with how many there are, have another size, or are null."""
    seen, counts = with_counts(vectors, name, vectors=F.count(F.lit(1)), wrong=F.count_if(F.size(column) != dim), missing=F.count_if(F.col(column).isNull()))
    return seen.where(F.size(column) == dim), counts


def reranked(candidates: DataFrame, score: object, k: int, name: str = "rerank") -> tuple[DataFrame, Observation]:
    """model_rerank with the numbers of scored, unscored and degraded candidates among those that are kept."""
    rows = retrieval.model_rerank(candidates, score, k)
    return with_counts(rows, name, kept=F.count(F.lit(1)), degraded=F.count_if(F.col("degraded")), unscored_queries=F.count_if((F.col("unscored") > 0) & (F.col("rank") == 1)))


def priced(records: DataFrame, price: DataFrame, name: str = "cost") -> tuple[DataFrame, Observation]:
    """Q2, Q3: costs with how many are unknown, for want of tokens or of a price."""
    rows = usage.with_cost(records, price)
    return with_counts(rows, name, records=F.count(F.lit(1)), tokens_unknown=F.count_if(F.col("price_note") == "tokens unknown"), price_unknown=F.count_if(F.col("price_note") == "price unknown"))


class Figures(StreamingQueryListener):
    """Sums of what streams observed, by name and figure."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.lock = threading.Lock()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        with self.lock:
            for name, row in (event.progress.observedMetrics or {}).items():
                for figure, value in row.asDict().items():
                    self.sums[name][figure] += value or 0

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass


def listening(spark: SparkSession) -> Figures:
    """A listener that the session's streams report to from now on."""
    figures = Figures()
    spark.streams.addListener(figures)
    return figures
