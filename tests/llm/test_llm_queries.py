"""The registered queries: against DuckDB where SQL can express them, else against brute force or by held-out accuracy."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import __spark_entry__
from docmeter.llm import mixing, registry, simhash, suffix_dedup
from docmeter.llm.shared import table

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def documents(sf):
    path = f"{sf}/documents.parquet"
    return pd.read_parquet(path)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), con.execute(registry.ORACLES[name]).df()
    rows = lambda df: sorted(tuple("NULL" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_all_are_registered():
    names = {n.split("_")[0] for n in __spark_entry__.queries()}
    assert {f"op{i}" for i in range(1, 14)} | {"pipeline"} <= names


def test_simhash_brute_force(spark):
    got = registry.QUERIES["op5_simhash"](spark, SMALL).toPandas().sort_values("doc_id")
    texts = documents(SMALL).sort_values("doc_id")

    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints, ids = [slow(t) for t in texts["text"]], texts["doc_id"].tolist()
    assert [f"{p:016x}" for p in prints] == got["fingerprint"].tolist()
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert [ids[g] for g in group] == got["component_id"].tolist()


def test_simhash_splits_large_buckets(spark):
    r = random.Random(0)
    prints = {r.getrandbits(64) for _ in range(300)}
    base = r.getrandbits(64)
    prints |= {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(500)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = {tuple(x) for x in simhash.links(df, simhash.Settings(bucket=16)).collect()}
    order = sorted(map(simhash.signed, prints))

    def groups(pairs):
        root = {p: p for p in order}

        def top(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return {p: top(p) for p in order}

    u = np.array(order).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u) <= 2, 1))
    assert groups(found) == groups([(order[i], order[j]) for i, j in near])


def test_allotment_is_least(spark):
    costs = [[5.0, 9.0, 30.0], [1.0, 2.0, 50.0]]
    assert simhash.allot(costs, 2, 2) == (7.0, [0, 1])
    assert simhash.allot(costs, 2, 0) is None
    bits = np.random.RandomState(0).randint(0, 2, (500, 32))
    both = np.hstack([bits, bits]).astype(float)  # bit b goes with bit b + 32
    parts = simhash.arrange(500, both.T @ both, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and all({b % 32 for b in p} == {b % 32 for b in p if b < 32} for p in parts)


def slow_removal(texts):
    seen = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            seen[t[p : p + 50]] = min(seen.get(t[p : p + 50], i), i)
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_brute_force(spark):
    got = registry.QUERIES["op8_suffix_dedup"](spark, SMALL).collect()
    d = documents(SMALL)
    want = slow_removal([(i, t.encode()) for i, t in zip(d["doc_id"], d["text"], strict=True)])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


@pytest.mark.parametrize("frequent", [2, 2000])
def test_suffix_on_hard_texts(spark, frequent):
    r = random.Random(3)
    passage = "".join(r.choice("abcd ") for _ in range(160))
    texts = [(i, "".join(r.choice("ab") for _ in range(r.randrange(40))) + passage[r.randrange(90) :][: r.randrange(45, 120)] + ("xy" * 60 if i % 3 == 0 else "é" * r.randrange(60))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.without_repeats(df, suffix_dedup.Settings(block_bytes=700, frequent=frequent)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == slow_removal([(i, t.encode()) for i, t in texts])


def test_loser_tree():
    r = random.Random(1)
    width = 6
    for _ in range(60):
        runs = [sorted((bytes(r.choice(b"\0ab") for _ in range(r.randint(2, width))) for _ in range(r.randint(0, 12))), key=lambda x: x.ljust(width, b"\0")) for _ in range(r.randint(1, 7))]
        coded = []
        for run in runs:
            m, size = np.zeros((len(run), width), np.uint8), np.array([len(x) for x in run], np.uint8)
            for i, x in enumerate(run):
                m[i, : len(x)] = list(x)
            shared, tails = suffix_dedup.front_code(m, size)
            coded.append((suffix_dedup.front_decode(shared, size, tails, width), shared.tolist()))
        out = list(suffix_dedup.merge([c[0] for c in coded], [c[1] for c in coded], width))
        values = [coded[k][0][i].to_bytes(width, "big") for k, i, _ in out]
        assert values == sorted(x.ljust(width, b"\0") for run in runs for x in run)
        for a, b, (_, _, known) in zip(values, values[1:], out[1:], strict=False):
            assert known == next((k for k in range(width) if a[k] != b[k]), width)


def test_held_out_accuracy(spark):
    d = documents(LARGER)
    labels = pd.read_parquet(f"{LARGER}/labels.parquet").drop_duplicates("doc_id")
    lang = registry.QUERIES["op10_language"](spark, LARGER).toPandas().merge(d, on="doc_id")
    held = lang[lang["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    good = registry.QUERIES["op7_quality"](spark, LARGER).toPandas().merge(labels, on="doc_id")
    held = good[good["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    toxic = registry.QUERIES["op3_toxicity"](spark, LARGER).toPandas().merge(labels, on="doc_id")
    held = toxic[toxic["held_out"]]
    ranks = held["score"].rank()
    n = held["toxic"].sum()
    assert (ranks[held["toxic"] == 1].sum() - n * (n + 1) / 2) / n / (len(held) - n) > 0.8
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(toxic["doc_id"], toxic["held_out"], strict=True))


def test_mixing_meets_targets_and_matches_numpy(spark):
    docs = table(spark, SMALL, "documents")
    got = mixing.mix(docs, docs.select("doc_id", docs["lang"].alias("domain")), mixing.TARGETS).toPandas()
    p, n = np.stack(got["p"]), got["n_tokens"].to_numpy(float)
    share = lambda r: (p * (n * r)[:, None]).sum(0) / n.sum()
    want = np.array([mixing.TARGETS[k] for k in sorted(mixing.TARGETS)])
    assert np.abs(share(got["rate"].to_numpy()) - want).max() < 2e-3
    step, r = 1 / max((p * n[:, None]).T.dot(p).sum(1) / n.sum()), np.ones(len(n))
    for _ in range(mixing.Settings().steps):
        off = want - share(r)
        if np.abs(off).max() <= mixing.Settings().close:
            break
        r = np.maximum(0, r + step * p @ off)
    assert np.allclose(r, got["rate"], atol=1e-6)
