"""The kept keyword index and the keyed chunk sink against rebuilds."""

from pyspark.sql import functions as F

from docmeter.operators import kept_index, retrieval
from docmeter.operators.kept import dealt
from docmeter.sources import chunk_sink


def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("kb_id"))


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def same_as_rebuild(spark, path, left, questions):
    idf, sums = kept_index.stats(spark, path)
    want_idf, want_sums = retrieval.term_stats(retrieval.postings(left), left)
    assert rows(idf.select("term", "df", "idf")) == rows(want_idf.select("term", "df", "idf"))
    assert rows(sums) == rows(want_sums)
    shape = ["query_id", "chunk_id", "rank", "score"]
    assert rows(kept_index.search(questions, path, 10).select(shape)) == rows(retrieval.bm25(questions, left, 10).select(shape))


def test_index_after_changes(spark, sf, tmp_path):
    c, path = corpus(spark, sf), str(tmp_path / "i")
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    stale = c.withColumn("content", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("stale words "), "content")).otherwise(F.col("content")))
    kept_index.change(spark, path, "a", stale.where("chunk_id % 4 < 3"), scope=("kb_id",))
    kept_index.change(spark, path, "b", c.where("chunk_id % 3 = 0 or chunk_id % 4 = 3"), scope=("kb_id",))
    same_as_rebuild(spark, path, c, q)
    kept_index.change(spark, path, "c", removed=c.where("chunk_id % 5 = 0"), scope=("kb_id",))
    kept_index.change(spark, path, "c", removed=c.where("chunk_id % 5 = 0"), scope=("kb_id",))  # once more: a restart
    left = c.where("chunk_id % 5 > 0")
    same_as_rebuild(spark, path, left, q)
    kept_index.compact(spark, path, str(tmp_path / "j"))
    same_as_rebuild(spark, str(tmp_path / "j"), left, q)
    scoped = q.withColumn("kb_id", F.lit("src1"))
    got = kept_index.search(scoped, path, 5, ("kb_id",))
    assert rows(got.select("query_id", "chunk_id", "score")) == rows(retrieval.bm25(scoped, left, 5, scope=["kb_id"]).select("query_id", "chunk_id", "score"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "documents.parquet" not in plan


def test_index_of_chunks_without_words(spark, tmp_path):
    c = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None), (4, "beta alpha")], "chunk_id long, content string")
    path = str(tmp_path / "i")
    kept_index.change(spark, path, "1", c)
    kept_index.change(spark, path, "2", removed=c.where("chunk_id in (2, 4)"))
    assert tuple(kept_index.stats(spark, path)[1].first()) == (2, 0.5)


def test_chunk_sink(spark, tmp_path):
    path = str(tmp_path / "chunks")
    made = lambda n, text, kb=3: spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("k"), F.col("id") % kb).alias("kb_id"), F.concat(F.lit(text), "id").alias("content"))
    table = lambda: {r["chunk_id"]: r["content"] for r in chunk_sink.read_chunks(spark, path).collect()}
    chunk_sink.upsert(made(60, "a"), path)
    chunk_sink.upsert(made(20, "b"), path)
    chunk_sink.upsert(made(20, "b"), path)
    want = {f"c{i}": ("b" if i < 20 else "a") + str(i) for i in range(60)}
    assert table() == want and chunk_sink.read_chunks(spark, path).count() == 60
    twice = made(1, "old").withColumn("seq", F.lit(1)).union(made(1, "new").withColumn("seq", F.lit(2)))
    chunk_sink.upsert(twice.drop("seq").where("content = 'new0'"), path)
    assert table() == want | {"c0": "new0"}
    chunk_sink.delete(made(60, "").where("kb_id = 'k1'"), path)
    left = {k: v for k, v in (want | {"c0": "new0"}).items() if int(k[1:]) % 3 != 1}
    assert table() == left
    chunk_sink.delete(made(60, "").where("kb_id = 'k1'"), path)
    assert table() == left
    odd = spark.createDataFrame([("x", "a/b=c", "t")], "chunk_id string, kb_id string, content string")
    chunk_sink.upsert(odd, path)
    chunk_sink.delete(odd, path)
    assert table() == left


def test_last_write_of_a_batch(spark, tmp_path):
    df = spark.createDataFrame([("c", "k", "one", 1), ("c", "k", "two", 2)], "chunk_id string, kb_id string, content string, seq int")
    chunk_sink.upsert(df, str(tmp_path / "c"), "seq")
    assert [r["content"] for r in chunk_sink.read_chunks(spark, str(tmp_path / "c")).collect()] == ["two"]


def test_search_shuffles_no_pairs(spark, tmp_path):
    """B2: tasks keep their best chunks of every question; postings alone are dealt."""
    c = spark.createDataFrame([(i, f"alpha w{i % 5} " * (i % 3 + 1)) for i in range(40)] + [(40, None)], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "alpha w3 w3"), (2, "none"), (3, "w1 none alpha")], "query_id long, query string")
    path = str(tmp_path / "i")
    kept_index.change(spark, path, "1", c)
    found = kept_index.search(q, path, 6)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert rows(found.select("query_id", "chunk_id", "rank", "score")) == rows(retrieval.bm25(q, c, 6).select("query_id", "chunk_id", "rank", "score"))


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    tasks = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks(one)) == 1
    found = dealt(one, "doc_id")
    assert found.count() == 30_000 and found.exceptAll(one).isEmpty()
    assert max(tasks(found)) < 30_000 / 2
    rows.repartition(8).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert dealt(many, "doc_id") is many
    few = one.limit(100)
    assert dealt(few, "doc_id") is few
