"""What the operators have in common: the shared folder, written tables and joins whose small side is counted first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join (a few numbers a row) is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of texts in a batch, by setting.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Spark's setting for shuffle files: whether they go at the end of the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch and of a Parquet reader's batch: with whole texts, the defaults of thousands hold tens of MB in each task."""
    for key, rows in BATCH_ROWS.items():
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (local tests), a temporary one."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(key, folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Lists of the scratch() blocks that are open, innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """A block that lists the tables which written() makes inside it; all queries' shuffle files inside it go when they end."""
    made: list[DataFrame] = []
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors, and gives the planner true sizes.

    The write's shuffle files go when it ends, as nothing reads them after it. forget() deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; the tables and shuffle files that it made on its way go."""
    with scratch(spark) as made:
        out = written(make(), name)
    forget(*(t for t in made if t is not out))
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def joined(large: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts `small` only if a count has shown it to hold at most `limit` rows; else both sides are shuffled."""
    return large.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def learn_fold(doc_id: str = "doc_id", mod: int = 3) -> F.Column:
    """crc32 of the id's text modulo `mod` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def without(df: DataFrame, *results: str) -> DataFrame:
    """df without columns that are named like one of the results, in any case."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in results))
