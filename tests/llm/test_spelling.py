"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmeter.llm import registry, spelling

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                c[w] += 1
    c = {w: n for w, n in c.items() if n >= 3}
    form = {}
    for w in c:
        best = min((v for v in c if near(w, v)), key=lambda v: (-c[v], v), default=None)
        form[w] = best if best and c[best] >= 2 * c[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, sum(near(w, v) for v in c), c[form[w]] if form[w] else None) for w, n in c.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_given_texts(spark):
    d = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = registry.QUERIES["op12_spelling"](spark, SMALL)
    assert found(got) == slow(zip(d["doc_id"], d["text"], strict=True))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_hard_words(spark, symbols):
    r = random.Random(3)
    base = ["letter", "étéàÿß", "aaaaaa", "ababab", "wörter", "×÷×÷×÷", "abcdefghij" * 4]
    words = []
    for w in base:
        for _ in range(12):
            k = r.randrange(len(w))
            words.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abcé") + w[k + 1 :]]))
    texts = [(i % 40 if i % 11 else None, " ".join(r.choice(base + words).upper() if r.random() < 0.2 else r.choice(base + words) for _ in range(60))) for i in range(150)]
    texts += [(2000 + k, "lanternes" + " lanterns" * (k < 10) + " lantern" * (k < 4)) for k in range(24)]
    texts += [(1, None), (2, ""), (3, "1234 -- œœœœœœ 日本日本日本"), *[(4, "a" * n) for n in (3000, 3001) for _ in range(3)], (9, "c" * 6_000_000), *[(6, "b" * 41) for _ in range(9)], *[(8, "b" * 40) for _ in range(3)]]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1))
    want = slow(texts)
    assert found(spelling.variants(df, spelling.Settings(symbols=symbols))) == want
    assert found(spelling.variants(df, spelling.Settings(symbols=symbols, whole=6))) == want
    assert sum(x[0] is not None for x in want.values()) > 20 and any(x[0] and x[0] != x[1] for x in want.values())


def test_neighbourhoods_cover_every_edit(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(150)})
    rows = spark.createDataFrame([(w,) for w in words], "r string").select("r", F.explode(spelling.neighbourhood(F.col("r"), 3)).alias("q")).collect()
    met = {frozenset((x["r"], x["q"])) for x in rows}
    assert {frozenset((a, b)) for a in words for b in words if a == b or near(a, b)} <= met


def test_long_chains(spark):
    """Roots are many forms away, and equal counts end a chain."""
    steps = spark.createDataFrame([(f"w{k:03d}", f"w{k + 1:03d}") for k in range(100)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(steps).collect()} == {f"w{k:03d}": "w100" for k in range(100)}
    assert spelling.roots(steps.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
