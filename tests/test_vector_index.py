"""The inverted file against exact search."""

import random

from docmeter.operators import retrieval, vector_index

LARGE = "/root/testdata/sf0.1"


def given(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    return v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id")


def pairs(df):
    return {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in df.collect()}


def test_recall_and_share_of_pairs(spark, tmp_path):
    q, c = given(spark, LARGE)
    index = vector_index.build(c, str(tmp_path / "i"))
    scored = spark.sparkContext.accumulator(0)
    near, exact = pairs(vector_index.search(q, index, 10, counted=scored)), pairs(retrieval.vector_top_k(q, c, 10))
    assert len(near) == len(exact) and len(near.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(near[k] == exact[k] for k in near.keys() & exact.keys())
    assert scored.value <= 0.15 * q.count() * c.count()  # with 8 threads 0.10


def test_all_cells_are_exact_and_kept(spark, sf, tmp_path):
    q, c = given(spark, sf)
    index = vector_index.build(c.where("chunk_id % 3 > 0"), str(tmp_path / "i"))
    vector_index.add(c.where("chunk_id % 3 = 0"), index)
    again = vector_index.load(spark, index.path)
    assert again.probes == index.probes
    assert pairs(vector_index.search(q, again, 7, probes=len(index.centres))) == pairs(retrieval.vector_top_k(q, c, 7))
    plan = vector_index.search(q.limit(1), again, 7, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters:")[1][:200]


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    r = random.Random(4)
    heads = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in heads[i % 12]]) for i in range(1500)]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = c.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(c, str(tmp_path / "i"))
    assert index.probes <= len(index.centres) // 3
    near, exact = pairs(vector_index.search(q, index, 5)), pairs(retrieval.vector_top_k(q, c, 5))
    assert len(near.keys() & exact.keys()) >= 0.9 * len(exact)


def test_vectors_that_are_left_out(spark, tmp_path):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.0, 2.0])], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    index = vector_index.build(c, str(tmp_path / "i"))
    assert {r["chunk_id"] for r in vector_index.search(q, index, 9).collect()} == {1, 5, 6}
    assert vector_index.search(q, vector_index.build(c.limit(0), str(tmp_path / "e")), 9).count() == 0
