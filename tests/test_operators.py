import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmeter.operators import chunking, citation, conversation, evaluation, kept_index, logs, metaquery, retrieval, tables, usage
from docmeter.sources import chunk_sink, files
from docmeter.streaming import streams


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_chunks(spark):
    page = "前言。\n表3.1 环境\n\n| a | b |\n| 1 | 2 |\n后记" + "长" * 300 + "。"
    made = chunking.chunks(spark.createDataFrame([(1, 1, page), (2, 1, ""), (3, 1, None)], "doc_id long, page_num int, text string"))
    got = made.collect()
    assert len({r["chunk_id"] for r in got}) == len(got) > 4
    table = [r for r in got if r["chunk_type"] == "child" and "| 1 |" in r["content"]]
    assert len(table) == 1 and table[0]["content"].startswith("表3.1 环境\n| a")
    assert chunking.formula_windows("ab$" + "x" * 50 + "$cd", 10, 2)[0].endswith("$")
    assert "".join(chunking.formula_windows("abcdefghij", 4, 0)) == "abcdefghij"


def test_native_windows_match_loop(spark):
    texts = ["", "a", "x" * 128, "y" * 129, "z" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.windows(F.col("t")).alias("w"))
    for r in df.collect():
        assert r["w"] == chunking.formula_windows(r["t"], 128, 32)


def test_fusion_prefers_shared(spark):
    a = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "query_id int, chunk_id string, rank int, score double")
    b = spark.createDataFrame([(1, "b", 1, 3.0), (1, "c", 2, 2.0)], "query_id int, chunk_id string, rank int, score double")
    got = rows(retrieval.fuse([a, b]), "rank")
    assert [r[1] for r in got] == ["b", "a", "c"] and got[0][3] == 0.8


def test_rerank_outcomes(spark):
    c = spark.createDataFrame([(q, "q", i, f"t{i}", i) for q in (1, 2) for i in (1, 2)], "query_id int, query string, chunk_id int, content string, rank int")

    def partly(query, texts):
        return [0.1]

    def broken(query, texts):
        raise TimeoutError("late")

    got = retrieval.model_rerank(c, partly, 2).collect()
    assert all(not r["degraded"] and r["unscored"] == 1 for r in got)
    got = retrieval.model_rerank(c, broken, 2).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 1, 2] and all(r["degraded"] and "late" in r["note"] for r in got)
    with pytest.raises(Exception, match="late"):
        retrieval.model_rerank(c, broken, 2, strict=True).collect()


def test_bm25_padding_and_scope(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", "k1"), (2, "gamma", "k1"), (3, "alpha", "k2"), (4, "delta", "k2")], "chunk_id int, content string, kb_id string")
    q = spark.createDataFrame([(1, "alpha", "k1")], "query_id int, query string, kb_id string")
    assert {r["chunk_id"] for r in retrieval.bm25(q, corpus, 5, scope=["kb_id"], pad=True).collect()} == {1, 2}
    assert {r["chunk_id"] for r in retrieval.scope_filter(corpus, kb_id="k2").collect()} == {3, 4}


def test_exact_vectors(spark, monkeypatch):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [0.0, 3.0])], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(9)] + [(9, None)], "query_id int, vector array<double>")
    whole = [tuple(r) for r in retrieval.vector_top_k(q, c, 3).orderBy("query_id", "rank").collect()]
    assert [r[1] for r in whole if r[0] == 0] == [1, 2, 5] and {r[0] for r in whole} == set(range(9))
    monkeypatch.setattr(retrieval, "VALUES", 6)  # parts of about three queries
    assert [tuple(r) for r in retrieval.vector_top_k(q, c, 3, block=2).orderBy("query_id", "rank").collect()] == whole
    assert retrieval.vector_top_k(q.limit(0), c, 3).count() == 0 and retrieval.vector_top_k(q, c.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="has not 2 numbers"):
        retrieval.vector_top_k(q, spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0])], c.schema), 3).collect()


def test_hybrid_with_dense_vectors(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", "k1"), (2, "gamma", "k1"), (3, "alpha", "k2")], "chunk_id int, content string, kb_id string")
    q = spark.createDataFrame([(1, "alpha", "alpha", "k1")], "query_id int, query string, question string, kb_id string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1])], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert {r["chunk_id"] for r in retrieval.hybrid(q, corpus, asked, vectors, scope=["kb_id"]).collect()} == {1, 2}
    assert {r["chunk_id"] for r in retrieval.hybrid(q, corpus, asked, vectors).collect()} == {1, 2, 3}


def test_embedding_hook_checks_sizes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string")
    good = retrieval.embed(t, "id", "t", lambda texts: [[float(len(x)), 1.0] for x in texts], 2).collect()
    assert len(good) == 3
    with pytest.raises(Exception, match="wanted"):
        retrieval.embed(t, "id", "t", lambda texts: [[1.0] for _ in texts], 2).collect()


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "question_id int, chunk_id string")
    ranks = spark.createDataFrame([("m", 1, "x", 1), ("m", 1, "b", 2)], "label string, question_id int, chunk_id string, rank int")
    r = evaluation.retrieval_scores(ranks, gold, (1, 3)).first()
    assert (r["questions"], r["hit_1"], r["hit_3"], r["recall_3"], r["mrr"]) == (2, 0.0, 0.5, 0.25, 0.25)
    none = spark.createDataFrame([], "label string, question_id int, chunk_id string, rank int")
    assert evaluation.retrieval_scores(none, gold).count() == 0


def test_latency_is_nearest_rank(spark):
    s = spark.createDataFrame([(200, float(v), False) for v in range(1, 11)] + [(429, None, True)], "status int, a double, degraded boolean")
    r = evaluation.latency(s, ["a"]).first()
    assert (r["n"], r["p50"], r["p95"], r["limited"], r["degraded"]) == (10, 5.0, 10.0, 1, 1)


def test_guardrails(spark):
    runs = spark.createDataFrame([("a", 0.5, 0.0, None), ("b", 0.4, 0.0, 1.0)], "run string, x double, y double, z double")
    assert {r["metric"]: r["verdict"] for r in evaluation.compare(runs, "a", "b", ["x", "y", "z"]).collect()} == {"x": "fail", "y": "no information", "z": "undecidable"}
    with pytest.raises(ValueError):
        evaluation.compare(runs.where("run = 'a'"), "a", "b", ["x"])
    m = spark.createDataFrame([(1, "p", 0.5)], "item int, answer string, coverage double")
    assert evaluation.memory_guardrail(m, m).first()["identical"]


def test_judge_records_failures(spark):
    items = spark.createDataFrame([(1, False), (2, False), (3, True)], "item int, negative boolean")

    def score(r):
        return 1.0 / (r["item"] - 2)

    got = {r["item"]: r for r in evaluation.judge(items, "item", score).collect()}
    assert set(got) == {1, 2} and got[1]["score"] == -1.0 and "ZeroDivisionError" in got[2]["error"]


def test_coverage_is_unknown_if_nothing_matches(spark):
    c = spark.createDataFrame([(1, 0, "a。"), (2, 0, "b。")], "answer_id int, pos int, claim string")
    v = spark.createDataFrame([(1, "other", True), (2, "b", True)], "answer_id int, claim string, supported boolean")
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "answer_id int, n_sources int")
    assert {r["answer_id"]: (r["coverage"], r["verified"]) for r in citation.coverage(c, v, a).collect()} == {1: (None, False), 2: (1.0, True), 3: (0.0, True)}


def test_verify_hook_failure_is_unknown(spark):
    a = spark.createDataFrame([(1, ["x"], ["x y"]), (2, ["z"], [])], "answer_id int, claims array<string>, sources array<string>")

    def judge(said, sources):
        return [sources[0].find(c) >= 0 for c in said]

    assert [tuple(r) for r in citation.verify(a, judge).collect()] == [(1, "x", True)]


def test_quota_edges(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(i, 1, t + dt.timedelta(minutes=i), c, None, False) for i, c in enumerate([1.0, None, 1.0, 0.5])], "request_id int, user_id int, created_at timestamp, cost double, role string, own_key boolean")
    assert [x["blocked"] for x in usage.quota(r, 2.0).orderBy("request_id").collect()] == [False, False, False, True]
    assert not any(x["blocked"] for x in usage.quota(r, None).collect())
    assert not any(x["blocked"] for x in usage.quota(r.withColumn("role", F.lit("admin")), 1.0).collect())
    assert usage.totals(r.withColumn("cost", F.lit(None).cast("double")).withColumn("input_tokens", F.lit(None).cast("int")).withColumn("output_tokens", F.lit(1))).first()["total_cost"] is None


def test_prices(spark):
    best, issues = usage.prices(spark, spark.createDataFrame([("m", '{"input": 1, "output": 2}'), ("bad", "{}"), ("fake", '{"input": 3, "output": 3}')], "model string, value string"))
    assert {r["model"]: r["origin"] for r in best.collect()} == {"m": "override", "fake": "override"} and issues.count() == 1


def test_plan_cursor_and_failures(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"word{i} more words") for i in range(10)], "session_id int, seq int, role string, content string")
    t = conversation.turns(m)
    p = conversation.plan(t, 5, 2).first()
    assert (len(p["kept"]), p["dropped"], p["cursor"]) == (2, 3, 5)
    prev = spark.createDataFrame([(1, "old", 7)], "session_id int, summary string, cursor int")
    p = conversation.plan(t, 5, 2, previous=prev).first()
    assert (p["summary"], len(p["kept"]), p["cursor"], p["skip_reason"]) == ("old", 1, 7, "few turns")

    def fails(parts):
        raise RuntimeError

    p = conversation.plan(t, 5, 2, summarize=fails).first()
    assert (len(p["kept"]), p["dropped"], p["skip_reason"]) == (5, 0, "no summary")
    assert len(conversation.exempt_plan(t, prev).first()["kept"]) == 1


def test_metadata_queries_refuse(spark):
    listed = {"t": metaquery.Listed(spark.range(5).withColumn("owner_id", F.lit(1)), ["id"], [])}
    for bad in ({"table": "x"}, {"table": "t", "fields": ["secret"]}, {"table": "t", "filters": [{"field": "id", "op": "like", "value": 1}]}, {"table": "t", "aggregate": {"fn": "sum", "field": "id"}}, {"table": "t", "order_by": {"field": "z"}}):
        with pytest.raises(metaquery.QueryError):
            metaquery.run(bad, listed, 1)
    assert metaquery.run({"table": "t", "limit": "many"}, listed, 2).count() == 0
    assert [metaquery.clamped(v) for v in (None, 0, 500, "7")] == [20, 1, 100, 7]
    with pytest.raises(metaquery.QueryError):
        metaquery.page(listed["t"].rows, 0, 101)


def test_tables(spark):
    with pytest.raises(ValueError):
        tables.deleted(spark.range(1))
    df = spark.range(2)
    target = T.StructType([*df.schema.fields, T.StructField("extra", T.StringType())])
    got, added = tables.back_filled(df, target, {"extra": "d"})
    assert added == ["extra"] and got.first()["extra"] == "d"


def test_logs(spark):
    lines = ["noise", "2024-01-01 00:00:00,1 ERROR app.error: boom", "  File x", "ValueError: a", " KeyError: b", "2024-01-01 00:00:01.2 WARNING app.error: boom", "2024-01-01 00:00:02,3 ERROR other: boom", "pkg.IOException: c", "KeyError"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert {(r["message"], r["exception"], r["n"]) for r in logs.signatures(logs.records(df)).collect()} == {("boom", "Key", 1), ("boom", "pkg.IO", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode() + b"\xff")
    assert [r["text"] for r in files.texts(spark, str(tmp_path / "a.txt")).collect()] == ["héllo"]
    (tmp_path / "t.csv").write_text("a,b\n1,\n")
    assert files.tables(spark, str(tmp_path / "t.csv")).first()["text"] == "## t.csv\na | b\n1"
    (tmp_path / "g.json").write_text('[{"question": "q", "expect": "e", "page": 3}]')
    assert files.golden(spark, str(tmp_path / "g.json")).first()["page"] == 3
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.benchmark(spark, str(tmp_path / "b.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(ValueError, match="line 2"):
        files.benchmark(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(files.MissingInput):
        files.golden(spark, str(tmp_path / "none.json"))
    v = spark.createDataFrame([('"a"',), ('["x", " "]',), ('[["p"], ["q"]]',), ("plain",)], "v string").select(files.flat_texts(F.col("v")).alias("x"))
    assert [r["x"] for r in v.collect()] == [["a"], ["x"], ["p", "q"], ["plain"]]
    files.write_metrics(spark.createDataFrame([("fact", 0.5)], "metric string, value double"), str(tmp_path / "m"), "one")
    files.write_metrics(spark.createDataFrame([("fact", 0.7)], "metric string, value double"), str(tmp_path / "m"), "two")
    files.write_metrics(spark.createDataFrame([("fact", 0.7)], "metric string, value double"), str(tmp_path / "m"), "two")
    assert rows(spark.read.parquet(str(tmp_path / "m")).select("run", "metric", "value"), "run") == [("one", "fact", 0.5), ("two", "fact", 0.7)]


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_limiter_by_bursts(spark, sf):
    """A key's hits are dealt by bursts; the result is that of the key's whole history."""
    hits = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    got = {r["id"]: r["allowed"] for r in streams.limiter(hits, 2, 36000).collect()}
    keys = hits.select("key", F.unix_micros("at").alias("t"), "id").toPandas().sort_values(["key", "t", "id"])
    for _, g in keys.groupby("key"):
        assert [got[i] for i in g["id"]] == streams.allowed_hits((g["t"] / 1e6).tolist(), [], 2, 36000)[0]
    assert set(got.values()) == {True, False}
    assert streams.allowed_hits([0, 1, 2, 61], [], 2, 60)[0] == [True, True, False, True]


def test_daily_cost_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(1, i, t + dt.timedelta(hours=i), 1.0) for i in range(4)], "user_id long, id long, created_at timestamp, cost double")
    daily = streams.drained(streams.daily_cost(_stream(spark, r, tmp_path / "q")), "update")
    assert [(x["cost"], x["records"]) for x in daily.collect()] == [(4.0, 4)]


def test_incremental_index_keeps_deleted_out(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "one。"), (2, 1, "two。")], "doc_id long, page_num int, text string")
    source = _stream(spark, pages, tmp_path / "p")
    streams.into_index(source, str(tmp_path / "idx"), str(tmp_path / "cp"), lambda s: s.createDataFrame([(2,)], "doc_id long"))
    assert {r["doc_id"] for r in chunk_sink.read_chunks(spark, str(tmp_path / "idx" / "chunks")).collect()} == {"1"}
    more = spark.createDataFrame([(3, 1, "three."), (1, 1, "uno。")], "doc_id long, page_num int, text string")
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    streams.into_index(source, str(tmp_path / "idx"), str(tmp_path / "cp"), lambda s: s.createDataFrame([(2,)], "doc_id long"))
    kept = chunk_sink.read_chunks(spark, str(tmp_path / "idx" / "chunks"))
    assert {r["doc_id"] for r in kept.collect()} == {"1", "3"} and kept.count() == kept.select("chunk_id").distinct().count()
    q = spark.createDataFrame([(1, "uno three one")], "query_id long, query string")
    found = kept_index.search(q, str(tmp_path / "idx" / "index"), 9)
    want = retrieval.bm25(q, kept.where("chunk_type = 'child'").select("chunk_id", "content"), 9)
    assert rows(found.select("chunk_id", F.round("score", 6)), "chunk_id") == rows(want.select("chunk_id", F.round("score", 6)), "chunk_id")


def test_chunks_leave_the_task_in_bounded_batches(spark, monkeypatch):
    """K5: a batch of many pages does not wait in Python until all of its chunks are made."""
    import pyarrow as pa

    from docmeter.operators import chunking

    class Source:
        def select(self, *columns):
            return self

        def mapInArrow(self, task, kinds):
            return task

    monkeypatch.setattr(chunking, "CHARS", 20_000)
    pages = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(200)]), pa.array([1] * 200, pa.int32()), pa.array(["Some words of a page. " * 40] * 200), pa.array([None] * 200, pa.string())], names=["doc_id", "page_num", "text", "summary"])
    made = list(chunking.chunks(Source())(iter([pages])))
    assert len(made) > 20 and max(b.nbytes for b in made) < 100_000
    assert len({i for b in made for i in b.column("chunk_id").to_pylist()}) == sum(map(len, made)) and {d for b in made for d in b.column("doc_id").to_pylist()} == {f"d{i}" for i in range(200)}
