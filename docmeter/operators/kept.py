"""Tables that stand in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, local tests get a temporary folder and a cluster an error."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(key, folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and not again for a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows below which a table stays as its files lie, and rows of a part that `dealt` makes.
FEW, PART = 20_000, 10_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, where its files would leave most cores idle, as a table of many parts, dealt by `key`.

    A row group of Parquet is read by one task, and all that follows the scan runs there: a file of few row groups is
    one task's work however large it is. Counts by task (of the files' footers) show it; then the rows are dealt once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    total, most = df.select(F.spark_partition_id().alias("task")).groupBy("task").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if total < FEW or total / most >= cores / 2:
        return df
    return written(df.repartition(max(2 * cores, total // PART), key), "dealt")


def in_order(df: DataFrame, at: str, tie: str, counted: str) -> DataFrame:
    """df with `before`: how many rows with a true `counted` stand strictly before in `at`, and `nth`: a counted row's
    number from 0 by (at, tie). Rows are dealt by ranges of `at`, and each range starts at the sum of those before it: no
    task sees all rows. `at` is not null."""
    dealt = written(df.repartitionByRange(at).withColumn("_range", F.spark_partition_id()), "ordered")
    hit = F.col(counted).cast("long")
    sizes = dealt.groupBy("_range").agg(F.sum(hit).alias("n"))  # a row a range
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    strictly = Window.partitionBy("_range").orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    each = Window.partitionBy("_range").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(F.broadcast(starts), "_range")
    return both.withColumn("before", F.col("_start") + F.coalesce(F.sum(hit).over(strictly), F.lit(0))).withColumn("nth", F.when(F.col(counted), F.col("_start") + F.coalesce(F.sum(hit).over(each), F.lit(0)))).drop("_range", "_start")
