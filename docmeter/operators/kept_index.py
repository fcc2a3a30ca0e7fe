"""A keyword index that is kept and changed in batches (B1, B2, S15, ST1).

Tables under one path, each batch a folder of its own: `postings` (term, chunk, tf, sign) by bucket of the term, `terms`
(change of df) by the same buckets, `chunks` (length, sign), and `sums` (change of N and of the tokens), written last: a
batch counts once its sums stand. A delete, or a chunk that is written again, is a batch of negative rows, read from the
index itself. A batch that runs twice overwrites its own folders, so nothing counts twice. Questions read the buckets of
their terms; no text is read again. compact() makes one batch of all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import text
from docmeter.operators.retrieval import BM25_B, FLOOR, K1, coded_structs, small, weighted_top_k
from docmeter.sources.folders import exists

BUCKETS = 64
SUMS = "n long, tokens long, buckets int, batch string"


def bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets the index was begun with."""
    return spark.read.schema(SUMS).parquet(f"{path}/sums").agg(F.min("buckets")).first()[0] if exists(spark, f"{path}/sums") else None


def _batches(spark: SparkSession, path: str, but: str | None = None) -> list[str]:
    """Finished batches."""
    if not exists(spark, f"{path}/sums"):
        return []
    return [r["batch"] for r in spark.read.schema(SUMS).parquet(f"{path}/sums").select("batch").distinct().collect() if r["batch"] != but]


def _table(spark: SparkSession, path: str, name: str, batches: list[str]) -> DataFrame:
    df = spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in batches))
    return df.drop("batch")


def change(spark: SparkSession, path: str, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None, scope: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """One batch: added(chunk_id, content, scope...) replace chunks of the same id, removed(chunk_id) go. Of repeated ids in `added`, one stays.

    `buckets` are those of a new index: about as many as its postings have GB.
    """
    buckets = _buckets(spark, path) or buckets
    before = _batches(spark, path, batch)
    news = added.select("chunk_id", "content", *scope).dropDuplicates(["chunk_id"]) if added is not None else None
    ids = [df.select("chunk_id") for df in (news, removed) if df is not None]
    gone = reduce(DataFrame.union, ids).distinct() if ids else None
    posts, chunks = [], []
    if before and gone is not None:
        gone = small(gone)
        posts.append(_net(_table(spark, path, "postings", before).join(gone, "chunk_id", "left_semi"), "term", "chunk_id", "tf", "dl", *scope).withColumn("sign", F.lit(-1)))
        chunks.append(_net(_table(spark, path, "chunks", before).join(gone, "chunk_id", "left_semi"), "chunk_id", "dl").withColumn("sign", F.lit(-1)))
    if news is not None:
        words = news.select("chunk_id", *scope, text.terms("content").alias("w")).withColumn("dl", F.size("w"))
        posts.append(words.select("chunk_id", *scope, "dl", F.explode("w").alias("term")).groupBy("term", "chunk_id", "dl", *scope).agg(F.count("*").alias("tf")).withColumn("sign", F.lit(1)))
        chunks.append(words.select("chunk_id", "dl", F.lit(1).alias("sign")))
    if not posts:
        return
    _write(reduce(DataFrame.unionByName, posts).withColumn("bucket", bucket(buckets)).repartition("bucket", "term"), f"{path}/postings/batch={batch}", "bucket")
    _write(reduce(DataFrame.unionByName, chunks), f"{path}/chunks/batch={batch}")
    _finish(spark, path, batch, buckets)


def _finish(spark: SparkSession, path: str, batch: str, buckets: int) -> None:
    """What follows from a batch's postings and chunks: its changes of df, N and tokens."""
    _write(_table(spark, path, "postings", [batch]).groupBy("bucket", "term").agg(F.sum("sign").alias("df")).where("df <> 0"), f"{path}/terms/batch={batch}", "bucket")
    _write(_table(spark, path, "chunks", [batch]).agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("dl") * F.col("sign")), F.lit(0)).cast("long").alias("tokens"), F.lit(buckets).alias("buckets")), f"{path}/sums/batch={batch}")


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def _net(rows: DataFrame, *key: str) -> DataFrame:
    """Rows that were added and not taken away since."""
    return rows.groupBy(*key).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")


def stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and the one row (n, avgdl), from the changes alone."""
    batches = _batches(spark, path)
    sums = _table(spark, path, "sums", batches).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).select("n", (F.col("tokens") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
    df = _table(spark, path, "terms", batches).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    raw = df.join(F.broadcast(sums), how="cross").select("bucket", "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="cross").select("bucket", "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf")), sums


def search(questions: DataFrame, path: str, k: int = 20, scope: tuple[str, ...] = ()) -> DataFrame:
    """questions(query_id, query, scope...) over the kept index. A null scope value sees all chunks.

    The postings of the questions' terms are dealt by chunk, and each task keeps its k best chunks of every question: no pair
    of a question and a chunk is shuffled.
    """
    spark = questions.sparkSession
    idf, sums = stats(spark, path)
    avgdl = sums.first()["avgdl"] or 1.0
    asked = questions.select("query_id", *scope, F.explode(text.terms("query")).alias("term")).groupBy("query_id", *scope, "term").agg(F.count("*").alias("times")).withColumn("bucket", bucket(_buckets(spark, path)))
    asked_buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # a number a bucket
    posts = _table(spark, path, "postings", _batches(spark, path)).where(F.col("bucket").isin(asked_buckets))
    met = posts.join(small(asked.select("bucket", "term").distinct()), ["bucket", "term"])
    net = _net(met.select("term", "chunk_id", "tf", "dl", "sign", *scope).repartition("chunk_id"), "chunk_id", "term", "tf", "dl", *scope)
    chunks = net.groupBy("chunk_id", "dl", *scope).agg(F.collect_list(F.struct("term", "tf")).alias("v"))
    weights = asked.join(idf.where(F.col("bucket").isin(asked_buckets)), ["bucket", "term"]).select("query_id", *scope, F.col("term").alias("dim"), (F.col("times") * F.col("idf")).alias("w"))

    def entries(batch: pa.RecordBatch, dims: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code, own = coded_structs(batch.column("v"), "term", dims)
        tf, dl = own.field("tf").to_numpy(zero_copy_only=False), batch.column("dl").to_numpy(zero_copy_only=False)
        return row, code, tf * (K1 + 1) / (tf + K1 * (1 - BM25_B + BM25_B * dl[row] / avgdl))

    return weighted_top_k(weights, chunks, k, entries, list(scope), 9)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The same index as one batch at a new path."""
    batches = _batches(spark, path)
    posts = _table(spark, path, "postings", batches)
    key = [c for c in posts.columns if c not in ("sign", "bucket")]
    _write(_net(posts, "bucket", *key).withColumn("sign", F.lit(1)), f"{into}/postings/batch=0", "bucket")
    _write(_net(_table(spark, path, "chunks", batches), "chunk_id", "dl").withColumn("sign", F.lit(1)), f"{into}/chunks/batch=0")
    _finish(spark, into, "0", _buckets(spark, path))
