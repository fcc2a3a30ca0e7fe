"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

from docmeter.llm import ranked

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 62


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def slow(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, c in counted:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, LAST if doc is None else doc))
        out += [(item, k, None if d == LAST else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, s):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.rank(d, i, s).collect()), key=str)


def test_against_every_document(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Été", "日本", "A1"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(k, text(r.choice([1, 5, 40, 300]))) for k in range(300)] + [(400 + k, "same w1 w2 words") for k in range(60)] + [(500, None), (501, ""), (502, "-- !"), (None, "same w1 w2 words"), (7, "w3 w3")]
    items = [(k, text(r.choice([1, 3, 12]))) for k in range(25)] + [(30, None), (31, "-"), (32, "unknown only"), (33, "same"), (33, "w1"), (None, "w2")]
    want = slow(docs, items)
    for s in (ranked.Settings(), ranked.Settings(block=3, cells=700, part_terms=20, seeds=2, bits=4)):
        assert run(spark, docs, items, s) == want


def test_blocks_are_skipped(spark):
    """One document answers the question far better than the others: blocks of common terms are never scored."""
    docs = [(k, "common word and more " * 3) for k in range(500)] + [(900 + k, "rare find common word") for k in range(12)]
    assert run(spark, docs, [(1, "rare find common word")], ranked.Settings(block=8, cells=2000)) == slow(docs, [(1, "rare find common word")])


def test_edges(spark):
    docs, items = [(1, "one two")], [(1, "one")]
    assert run(spark, [], items, ranked.Settings()) == [] and run(spark, docs, [], ranked.Settings()) == []
    assert run(spark, [(1, None)], items, ranked.Settings()) == []
    long = " ".join(f"t{k % 5000}" for k in range(900_000))  # over 5 MB in one text
    docs = [(1, long), (2, "t1 t2"), (3, "t1 other")]
    assert run(spark, docs, [(1, "t1 t4999"), (2, "other")], ranked.Settings()) == slow(docs, [(1, "t1 t4999"), (2, "other")])
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, score int, `rank` string")
    got = ranked.rank(clash, clash.selectExpr("doc_id AS item_id", "text", "score", "`rank`"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 1
    named = spark.createDataFrame([("q1", "a")], "item_id string, text string")
    assert ranked.rank(clash, named).first()["item_id"] == "q1"


def test_summaries_are_maxima(spark):
    import numpy as np

    a = ranked.Asked(np.arange(4), np.array([9, 7, 5, 3]), [np.array([0, 2]), np.array([1, 2, 3]), np.array([2, 3]), np.array([3])], [])
    end, term, impact = np.array([2, 4, 6]), np.array([0, 2, 1, 2, 0, 3], np.int32), np.array([5, 6, 7, 8, 9, 4], np.int32)
    b_term, b_end, b_doc, b_max = ranked._blocks(end, term, impact, a, 1)
    assert b_term.tolist() == [0, 0, 1, 2, 2, 3] and b_end.tolist() == [1, 2, 3, 4, 5, 6] and b_doc.tolist() == [0, 2, 1, 0, 1, 2]
    assert b_max.tolist() == [5, 6, 9, 0, 7, 8, 0, 6, 0, 8, 0, 4]
