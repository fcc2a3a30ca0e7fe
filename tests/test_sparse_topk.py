"""Keyword and sparse top-k: tasks keep their best chunks, against every pair."""

import math
from collections import Counter

import pytest

from docmeter.operators import retrieval


@pytest.mark.parametrize("values", [retrieval.VALUES, 40])
def test_bm25_against_every_pair(spark, monkeypatch, values):
    monkeypatch.setattr(retrieval, "VALUES", values)  # 40: several parts of the questions
    texts = [f"alpha w{i % 7} w{i % 3} " + "beta " * (i % 4) for i in range(60)] + [None, ""]
    kb = [f"k{i % 2}" if i % 5 else None for i in range(len(texts))]
    asked = [(i, f"w{i % 7} beta beta none alpha", f"k{i % 2}" if i % 3 else None) for i in range(9)] + [(9, "none", None)]
    words = [(t or "").split() for t in texts]
    n, avgdl = len(words), sum(map(len, words)) / len(words)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in Counter(t for w in words for t in set(w)).items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for t, x in raw.items()}
    want = {}
    for q, query, scope in asked:
        score = {c: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in query.split() if t in idf) for c, w in enumerate(words) if scope is None or kb[c] == scope}
        best = sorted((c for c in score if round(score[c], 9)), key=lambda c: (-round(score[c], 9), c))[:4]
        want |= {(q, c): (r + 1, round(score[c], 6)) for r, c in enumerate(best)}
    out = retrieval.bm25(spark.createDataFrame(asked, "query_id long, query string, kb_id string"), spark.createDataFrame(list(zip(range(n), texts, kb, strict=True)), "chunk_id long, content string, kb_id string"), 4, scope=["kb_id"])
    assert {(x["query_id"], x["chunk_id"]): (x["rank"], round(x["score"], 6)) for x in out.collect()} == want and len(want) > 20
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # neither postings nor pairs are shuffled


def test_sparse_vectors_against_every_pair(spark):
    chunks = [(c, b, ((c * 7 + b * 3) % 5 + 1) / 5) for c in range(40) for b in range(6) if (c + b) % 4]
    asked = [(q, b, (q + b) % 3 + 0.5) for q in range(8) for b in range(8) if (q * b) % 3 == 1]
    score = Counter()
    for q, b, w in asked:
        for c, have, v in chunks:
            score[q, c] += w * v * (b == have)
    want = {}
    for q in {a[0] for a in asked}:
        best = sorted((c for c in range(40) if score[q, c]), key=lambda c: (-round(score[q, c], 9), c))[:5]
        want |= {(q, c): r + 1 for r, c in enumerate(best)}
    out = retrieval.sparse_top_k(spark.createDataFrame(asked, "query_id long, bucket int, w double"), spark.createDataFrame(chunks, "chunk_id long, bucket int, w double"), 5)
    assert {(x["query_id"], x["chunk_id"]): x["rank"] for x in out.collect()} == want
    assert "MapInArrow" in out._jdf.queryExecution().toString()


def test_texts_are_read_twice_and_not_shuffled(spark, tmp_path, monkeypatch):
    """The statistics and the meeting read the texts once each; ranked chunks are brought to their texts."""
    spark.createDataFrame([(i, f"w{i % 7} text{i}") for i in range(50)] + [(50, None), (51, "")], "chunk_id long, content string").write.parquet(str(tmp_path / "c"))
    corpus, asked = spark.read.parquet(str(tmp_path / "c")), spark.createDataFrame([(1, "w3 text5")], "query_id long, query string")
    plans, write = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    top = retrieval.bm25(asked, corpus, 3)
    assert [r["chunk_id"] for r in top.orderBy("rank").collect()] == [5, 3, 10]
    reads = [p.split("Initial Plan")[-1].count("FileScan") * (str(tmp_path / "c") in p) for p in plans]
    assert sum(reads) == 1 and "Exchange" not in retrieval.hashed(corpus, "chunk_id", "content")._jdf.queryExecution().executedPlan().toString()
    joined = retrieval.with_chunks(top, corpus)
    assert joined.where("content = 'w5 text5'").count() == 1 and "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_word_breaks_are_the_same_in_one_class(spark):
    """against the alternatives that the one class stands for, over the Basic Multilingual Plane and beyond it."""
    from pyspark.sql import functions as F

    from docmeter.functions import text

    points = [c for c in [*range(0x3000), *range(0x3000, 0x11000, 7), *range(0x1F300, 0x1F400), *range(0x20000, 0x20040)] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{chr(c)}b",) for c in points], "t string")
    old = F.array_remove(F.split(F.lower("t"), rf"(?:[^\p{{L}}\p{{M}}\p{{N}}]|{text.CJK})+"), "")
    new = text.terms("t")
    assert df.where(~F.col("t").rlike(text.CJK) & (old != new)).count() == 0
