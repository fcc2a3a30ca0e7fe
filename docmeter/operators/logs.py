"""Error logs and tool steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, as the application writes its log: what opens a record (time, level, logger, message), and an exception's line (class stem, text).
START = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,.][^ ]*) \w+ app\.error: (.*)$"
EXCEPTION = r"^([A-Za-z_][\w\.]*)(?:Error|Exception|Interrupt|Error\b[^\n]*): (.*)$"
SPLIT_LINES = 100_000


def records(lines: DataFrame, start: str = START, exception: str = EXCEPTION) -> DataFrame:
    """lines(file, line_no, line) to records: a line with the start pattern opens one, the others of the file follow.

    `exception` is what the exception pattern captures in the record's last line that matches it. Records are cut inside
    splits of a file (a `split` column, as files.numbered_lines gives it, or SPLIT_LINES lines each). A split's lines
    before its first start belong to the last record opened in an earlier split: a second pass over one row a split
    stitches them, so no task holds more than a split of a file.
    """
    split = F.col("split") if "split" in lines.columns else F.expr(f"line_no div {SPLIT_LINES}").alias("split")
    run = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.select("file", split, "line_no", "line").withColumn("record", F.sum(F.col("line").rlike(start).cast("int")).over(run))
    head, line = F.min_by("line", "line_no"), F.trim("line")
    last = F.max_by(F.regexp_extract(line, exception, 1), F.when(line.rlike(exception), F.col("line_no")))
    cut = numbered.groupBy("file", "split", "record").agg(F.regexp_extract(head, start, 1).alias("ts"), F.regexp_extract(head, start, 2).alias("message"), last.alias("exception"))
    # one row a split: its last record, and what stands before its first
    ends = cut.groupBy("file", "split").agg(F.max("record").alias("record"), F.max(F.when(F.col("record") == 0, F.col("exception"))).alias("before"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    owned = ends.withColumn("owner", F.max(F.when(F.col("record") > 0, F.col("split"))).over(earlier)).where("owner is not null and before is not null")
    tails = owned.groupBy("file", F.col("owner").alias("split")).agg(F.max_by("before", "split").alias("later")).join(ends.select("file", "split", "record"), ["file", "split"])
    whole = cut.where("record > 0").join(tails, ["file", "split", "record"], "left")
    return whole.select("file", "split", "record", "ts", "message", F.coalesce("later", "exception").alias("exception"))


def signatures(errors: DataFrame, n: int | None = 20) -> DataFrame:
    """Errors by message and exception class, most frequent first."""
    out = errors.groupBy("message", "exception").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "message", "exception")
    return out.limit(n) if n else out


def unseen(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Signatures that were not there before."""
    same = (now["message"].eqNullSafe(seen["message"])) & (now["exception"].eqNullSafe(seen["exception"]))
    return now.join(seen, same, "left_anti")


def tool_runs(steps: DataFrame) -> DataFrame:
    """L3: steps(run_id, step, tool, ok, ms, retrieval): totals of each run, and what its answer can rest on."""
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("ms").alias("ms"), F.count_if(~F.col("ok")).alias("failures"), F.some(F.col("retrieval")).alias("retrieval_ran"), F.some(F.col("ok") & ~F.col("retrieval")).alias("tool_grounded"))


def collected_sources(sources: DataFrame) -> DataFrame:
    """L4: sources(run_id, step, pos, chunk_id) over steps: the first of each chunk, and all without an id."""
    order = Window.partitionBy("run_id", F.coalesce("chunk_id", F.concat_ws(":", F.lit("none"), "step", "pos"))).orderBy("step", "pos")
    return sources.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
