"""Exact ranks without gathering values, numbers in time order, cache matches, observed counts and hooks."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmeter.operators import conversation, evaluation, hooks, observed, retrieval
from docmeter.operators.kept import in_order
from docmeter.plans import details
from docmeter.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_nearest_ranks(spark, rows):
    """Ties, one value, nulls, hot values; with few rows to a bracket it is narrowed first."""
    r = random.Random(6)
    groups = {"ties": [float(r.randrange(9)) for _ in range(3000)], "one": [4.5], "wide": [r.gauss(0, 1e6) for _ in range(5000)], "hot": [1.0] * 4000 + [float(k) for k in range(50)], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "stage string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(x["stage"], x["share"]): (x["v"], x["n"]) for x in evaluation.nearest_rank(df, shares, rows=rows, accuracy=200).collect()}
    want = {(g, p): (sorted(vs)[max(1, math.ceil(round(p * len(vs), 9))) - 1], len(vs)) for g, vs in groups.items() if g != "none" for p in shares}
    assert got == want
    assert evaluation.nearest_rank(df.limit(0), shares).count() == 0


def test_rows_in_order(spark):
    r = random.Random(2)
    rows = [(i, T0 + dt.timedelta(seconds=r.randrange(60)), r.random() < 0.6) for i in range(400)]
    got = {x["id"]: (x["before"], x["nth"]) for x in in_order(spark.createDataFrame(rows, "id long, at timestamp, stored boolean"), "at", "id", "stored").collect()}
    for i, at, stored in rows:
        before = sum(s for _, t, s in rows if t < at)
        assert got[i] == (before, sum(s for j, t, s in rows if (t, j) < (at, i)) if stored else None)


@pytest.mark.parametrize("newest", [7, 50, 2000])
def test_cache_matches_against_every_pair(spark, newest):
    r = random.Random(newest)
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(25)]
    rows = []
    for i in range(220):
        v = [x + r.gauss(0, 0.2) for x in r.choice(vectors)]
        rows.append((i, r.choice(["k1", "k2", None]), T0 + dt.timedelta(seconds=r.randrange(300)), r.choice(["what", "what", "表3.1"]), r.choice([None, "", f"a{i}", f"a{i}"]), None if i % 31 == 0 else v, r.random() < 0.1))
    got = {x["query_id"]: (x["hit_id"], x["score"], x["hit_answer"]) for x in conversation.cache_matches(spark.createDataFrame(rows, "query_id long, kb_id string, at timestamp, question string, answer string, vector array<double>, own_key boolean"), newest=newest, dealt=8).collect()}
    asked = [x for x in rows if not x[6] and x[3] == "what" and x[5]]
    stored = sorted([x for x in asked if x[4]], key=lambda x: (x[2], x[0]))
    want = {}
    for q in asked:
        seen = [x for x in stored if x[2] < q[2]][-newest:]
        near = []
        for e in seen:
            score = round(float(np.dot(q[5], e[5]) / np.linalg.norm(q[5]) / np.linalg.norm(e[5])), 9)
            if e[1] == q[1] and q[1] is not None and score >= 0.92:
                near.append((-score, e[0], e[4]))
        if near:
            s, i, a = min(near)
            want[q[0]] = (i, round(-s, 6), a)
    got = {k: v for k, v in got.items() if rows[k][1] is not None}
    assert got == want and len(want) > 2


@pytest.mark.parametrize("newest", [None, 5])
def test_cache_over_many_tasks(spark, newest):
    """Both sides of a group land in one task whatever the partitions are; without a bound all earlier entries count."""
    r = random.Random(3)
    vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in range(90)]
    rows = [(i, f"k{i % 2}", i, "what", f"a{i}", v, False) for i, v in enumerate(vectors)]
    want = {}
    for i, v in enumerate(vectors):
        seen = [(-round(float(np.dot(v, vectors[j]) / np.linalg.norm(v) / np.linalg.norm(vectors[j])), 9), j) for j in range(max(0, i - newest) if newest else 0, i) if j % 2 == i % 2]
        if seen and -min(seen)[0] >= 0.3:
            want[i] = min(seen)[1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        asked = spark.createDataFrame(rows, "query_id long, kb_id string, at long, question string, answer string, vector array<double>, own_key boolean")
        got = {x["query_id"]: x["hit_id"] for x in conversation.cache_matches(asked, 0.3, newest, dealt=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and len(want) > 20


def test_cache_scores_are_rounded_once(spark):
    """A cosine of 0.9822534999996 is 0.982253 to six places, and not 0.982254 by way of nine."""
    c = 0.9822534999996
    rows = [(1, 1, 1, "what", "a", [1.0, 0.0], False), (2, 1, 2, "what", "b", [c, float(np.sqrt(1 - c * c))], False)]
    asked = spark.createDataFrame(rows, "query_id long, kb_id long, at long, question string, answer string, vector array<double>, own_key boolean")
    assert [x["score"] for x in conversation.cache_matches(asked).collect()] == [0.982253]


def test_observed_counts(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, vector array<double>")
    rows, counts = observed.sized_vectors(v, "vector", 2)
    assert [r["id"] for r in rows.collect()] == [1] and counts.get == {"vectors": 3, "wrong": 1, "missing": 1}
    c = spark.createDataFrame([(q, "q", i, f"t{i}", i) for q in (1, 2) for i in (1, 2)], "query_id int, query string, chunk_id int, content string, rank int")

    def busy(query, texts):
        raise TimeoutError

    rows, counts = observed.reranked(c, busy, 2)
    assert rows.count() == 4 and counts.get == {"kept": 4, "degraded": 4, "unscored_queries": 0}
    figures = observed.listening(spark)
    v.coalesce(1).write.parquet(str(tmp_path / "v"))
    stream, _ = observed.with_counts(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), "stream-vectors", rows=F.count(F.lit(1)), missing=F.count_if(F.col("vector").isNull()))
    streams.drained(stream, "append")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(figures)
    assert dict(figures.sums["stream-vectors"]) == {"rows": 3, "missing": 1}


def test_fact_function(spark):
    def extract(user, assistant):
        if not assistant:
            raise RuntimeError("silent")
        return assistant

    t = spark.createDataFrame([(1, 1, "u", "- a\r\n2. b\na\n\n* "), (1, 2, None, None), (2, 1, "u", "\n".join(f"f{k}" for k in range(9)))], "session_id int, turn_no int, user string, assistant string")
    got = sorted((tuple(r) for r in hooks.extracted_facts(t, extract).collect()), key=str)
    assert got == sorted([(1, 1, 0, "a", None), (1, 1, 1, "b", None), (1, 2, None, None, "RuntimeError: silent"), *((2, 1, k, f"f{k}", None) for k in range(5))], key=str)


def test_embedding_is_tried_again(spark):
    class Busy(Exception):
        status = 429

    class Wrong(Exception):
        status = 400

    def flaky(kind):
        tried = []

        def model(texts):
            tried.append(1)
            if len(tried) < 3:
                raise kind
            return [{"index": i, "embedding": [1.0]} for i in range(len(texts))]

        return model

    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").coalesce(1)
    assert retrieval.embed(t, "id", "t", flaky(Busy), 1, wait=0.01).count() == 2
    assert retrieval.passing(Busy()) and retrieval.passing(TimeoutError()) and not retrieval.passing(Wrong())
    with pytest.raises(Exception, match="Wrong|failed"):
        retrieval.embed(t, "id", "t", flaky(Wrong), 1, wait=0.01).collect()
    for bad in ([0, 0], [0, 2]):
        with pytest.raises(ValueError, match="indexes"):
            retrieval.in_index_order([{"index": i, "embedding": [1.0]} for i in bad], 2)


def test_questions_asked_again_are_single_precision(spark, sf):
    """As in the SQL, whose float plus decimal is a float."""
    first = {x["vec_id"]: x["embedding"][0] for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    again = {x["query_id"] - 1000000: x["vector"][0] for x in details._asked_again(spark, sf).where("query_id >= 1000000").collect()}
    assert again == {i: float(np.float32(v) + np.float32(0.1 * (i % 6))) for i, v in first.items()}
