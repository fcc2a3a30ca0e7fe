"""The language model against one made of dictionaries, and as a probability distribution."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmeter.llm import ngrams, registry

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN = "\0begin"
TINY = ngrams.Settings(shard_tokens=400, slice_bytes=3000, vocabulary_words=100)


class Slow:
    """Interpolated modified Kneser-Ney over lists of tokens; None ends a text."""

    def __init__(self, texts, order):
        self.order, self.words = order, Counter(w for t in texts for w in t)
        self.total, self.different = sum(self.words.values()), len(self.words)
        count, self.counts = Counter(), {}
        for t in texts:
            padded = [BEGIN] * (order - 1) + t
            count.update(tuple(padded[i : i + order]) for i in range(len(t)))
        for k in range(order, 0, -1):
            self.counts[k], lower = count, Counter()
            for gram, n in count.items():
                if k > 1:
                    lower[gram[1:]] += n if gram[1] == BEGIN else 1
            count = lower
        self.less = {k: [0.0, *ngrams.discounts([sum(n == m for n in c.values()) for m in (1, 2, 3, 4)])] for k, c in self.counts.items()}
        self.contexts = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in self.counts}
        for k, c in self.counts.items():
            for gram, n in c.items():
                x = self.contexts[k][gram[:-1]]
                x[0] += n
                x[min(n, 3)] += 1

    def p(self, gram):
        p = 1 / (self.different + 1)
        for k in range(1, self.order + 1):
            part = gram[self.order - k :]
            if x := self.contexts[k].get(part[:-1]):
                n, less = self.counts[k].get(part, 0), self.less[k]
                p = max(n - less[min(n, 3)], 0) / x[0] + sum(less[m] * x[m] for m in (1, 2, 3)) / x[0] * p
        return p

    def row(self, t):
        padded = [BEGIN] * (self.order - 1) + t
        return (
            len(t), sum(w in self.words for w in t), self.total,
            sum(math.log10((self.words[w] + 1) / (self.total + self.different + 1)) for w in t),
            sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(t))),
        )


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)) + [None]


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def same(got, want):
    got = list(got)
    assert [tuple(g[:3]) for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("s", [ngrams.Settings(), ngrams.Settings(shard_tokens=3000, slice_bytes=50_000, vocabulary_words=2000)])
def test_given_texts(spark, s):
    d = pd.read_parquet(f"{SMALL}/documents.parquet")
    model = Slow([tokens(t) for i, t in zip(d["doc_id"], d["text"], strict=True) if learned(i)], 3)
    got = ngrams.score(spark.read.parquet(f"{SMALL}/documents.parquet"), s).toPandas().set_index("doc_id").loc[d["doc_id"]].reset_index()
    same(got[["n_tokens", "n_known", "train_tokens", "base_score", "score"]].itertuples(index=False), [model.row(tokens(t)) for t in d["text"]])
    assert all(h == (not learned(i)) for h, i in zip(got["held_out"], got["doc_id"], strict=True))
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() * 0.9


@pytest.mark.parametrize("order", [1, 2, 4])
def test_orders_and_edges(spark, order):
    """One very common context and word, spread over shards; nulls, empty and repeated texts; clashing names."""
    r = random.Random(order)
    words = ["the"] * 30 + [f"w{k}" for k in range(40)] + ["É", "é"]
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randrange(30)))) for k in range(200)] + [(900 + k, "the the " * 40) for k in range(20)]
    texts += [(300, None), (301, ""), (302, " \t\n"), (303, "new words alone"), (None, "the w1"), (5, "the w1"), (5, "the w1")]
    s = ngrams.Settings(**(vars(TINY) | {"order": order}))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit(1))
    got = ngrams.score(df, s).collect()
    model = Slow([tokens(t) for i, t in texts if learned(i)], order)
    shape = lambda x: (str(x[0]), x[1], x[2], round(x[4], 6))
    rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=shape)
    want = sorted(((i, *model.row(tokens(t))) for i, t in texts), key=shape)
    assert [x[0] for x in rows] == [x[0] for x in want]
    same([x[1:] for x in rows], [x[1:] for x in want])
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]


def test_probabilities_sum_to_one(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 20))) for _ in range(120)]
    model = ngrams.learn(spark.createDataFrame([(t,) for t in texts], "text string"), TINY)
    reader = ngrams.Reader(model)
    ids = np.array([0, *range(2, model.n_words + 1), ngrams.UNKNOWN], np.int64)  # the end, the words, any other
    for context in ((1, 1), (1, 3), (2, 4), (5, ngrams.UNKNOWN), (ngrams.UNKNOWN, 2)):
        columns = [np.full(len(ids), c, np.int64) for c in context] + [ids]
        assert abs(reader.probabilities(columns).sum() - 1) < 1e-9


def test_long_text_and_empty_tables(spark):
    long = " ".join(f"w{k % 3000}" for k in range(900_000))  # over 5 MB
    df = spark.createDataFrame([(1, long), (3, "w1 w2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngrams.score(df).collect()}
    assert got[1]["n_tokens"] == 900_001 and got[1]["train_tokens"] == sum(len(tokens(t)) for i, t in ((1, long), (3, "w1 w2")) if learned(i))
    assert ngrams.score(df.limit(0)).count() == 0
    none = ngrams.score(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert (none["train_tokens"], none["n_known"], none["base_score"], none["score"]) == (0, 0, 0.0, 0.0)


def test_files_of_arrays(tmp_path):
    arrays = [np.arange(5, dtype=np.uint8), np.zeros(0, np.uint64), np.arange(7, dtype=np.uint32)]
    ngrams.save(str(tmp_path), "x", arrays)
    ngrams.save(f"file://{tmp_path}", "x", arrays)
    back = ngrams.opened(f"file://{tmp_path}", "x")
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True)) and [p.name for p in tmp_path.iterdir()] == ["x"]
    columns, count = [np.array([3, 3, 900]), np.array([9, 1 << 40, 2])], np.array([1, 2, 70000])
    blob = ngrams.unpacked(ngrams.packed(columns, count), 2)
    assert [c.tolist() for c in blob[0]] == [c.tolist() for c in columns] and blob[1].tolist() == count.tolist()


def test_query(spark):
    got = registry.QUERIES["op13_perplexity"](spark, SMALL)
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(got.columns)
