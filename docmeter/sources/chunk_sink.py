"""A chunk table that is keyed by chunk id: the last write of an id stays, and deletes hold.

Chunks stand by knowledge base and by bucket of their id, so a scope reads its own folders and a write rewrites only the
folders that its ids fall in (dynamic partition overwrite: the old files go when the new ones stand). A batch that is
written twice leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmeter.operators.kept import written
from docmeter.operators.retrieval import small
from docmeter.sources.folders import exists, remove

BUCKETS = 16
KEYS = ["kb_id", "bucket"]


def bucket() -> F.Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _touched(spark: SparkSession, path: str, folders: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(F.broadcast(folders), KEYS, "left_semi")  # at most BUCKETS folders a knowledge base


def _put(rows: DataFrame, path: str) -> None:
    rows.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def upsert(chunks: DataFrame, path: str, seq: str | None = None) -> None:
    """Writes chunks(chunk_id, kb_id, ...). Of repeated ids the one of the largest `seq` stays, or any where there is none.

    A chunk keeps its knowledge base: one that moves must be deleted from the old one.
    """
    spark = chunks.sparkSession
    rows = chunks.withColumn("bucket", bucket())
    if seq:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("kb_id", "chunk_id").orderBy(F.col(seq).desc()))).where("k = 1").drop("k")
    else:
        rows = rows.dropDuplicates(["kb_id", "chunk_id"])
    if exists(spark, path):
        rows = written(rows, "chunk-batch")
        kept = _touched(spark, path, rows.select(*KEYS).distinct()).join(small(rows.select("kb_id", "chunk_id")), ["kb_id", "chunk_id"], "left_anti")
        rows = rows.unionByName(kept.select(rows.columns), allowMissingColumns=True)
    _put(rows, path)


def delete(gone: DataFrame, path: str) -> None:
    """Deletes the chunks of gone(kb_id, chunk_id); folders that end up empty go."""
    spark = gone.sparkSession
    ids = written(gone.select("kb_id", "chunk_id", bucket().alias("bucket")).distinct(), "chunk-deletes")
    folders = ids.select(*KEYS).distinct()
    kept = written(_touched(spark, path, folders).join(small(ids.select("kb_id", "chunk_id")), ["kb_id", "chunk_id"], "left_anti"), "chunk-kept")
    _put(kept, path)
    for r in folders.join(kept.select(*KEYS).distinct(), KEYS, "left_anti").collect():  # folders, not chunks
        remove(spark, f"{path}/kb_id={_escaped(spark, r['kb_id'])}/bucket={r['bucket']}")


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
