"""Near copies by shingles against brute force: large buckets, equal sets of different bytes."""

import random

from docmeter.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_force(rows, similarity=0.8):
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] != group[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                lo, hi = sorted((group[i], group[j]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    return group


def found(spark, rows, s):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA), s).collect()}


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(40)}" for _ in range(60)]
        texts += [" ".join(base).upper(), "  ".join(base), "\n".join(base)]  # equal sets, different bytes
        for k in range(12):  # a chain: each a bit further from the base
            base = [w if rng.random() > 0.02 else f"new{k}" for w in base]
            texts.append(" ".join(base))
    shared = [f"common{k}" for k in range(30)]
    texts += [" ".join([*shared, *(f"own{i}x{k}" for k in range(n))]) for i, n in enumerate((3, 4, 5, 6, 7, 8, 9, 12, 20, 40))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows, simhash.Similar(bucket=4)) == brute_force(rows)


def test_appended_and_scattered_edits_all_meet(spark):
    rng = random.Random(5)
    word = lambda: f"v{int(rng.paretovariate(0.7)) % 5000}"
    rows = []
    for k in range(60):
        base = [word() for _ in range((12, 30, 100, 300)[k % 4])]
        if k % 3 < 2:  # a tail just under a quarter of the shingles: Jaccard a bit over 0.8
            n = len(base) - 4
            other = base + [word() for _ in range(n // 4)] if k % 3 else base[n // 5 :]
        else:
            other = [w if rng.random() > 0.02 else word() for w in base]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = brute_force(rows)
    assert sum(want[2 * k + 1] == 2 * k for k in range(60) if k % 3 < 2) >= 30
    assert found(spark, rows, simhash.Similar()) == want


def test_texts_that_share_little_meet_nowhere(spark):
    import numpy as np
    from pyspark.sql import functions as F

    s = simhash.Similar()
    shared = [" ".join(f"common{j}x{k}" for k in range(8)) for j in range(10)]
    rows = [(i, " ".join([shared[i % 10], *(f"own{i}x{k}" for k in range(40))])) for i in range(60)]
    rows += [(100, " ".join(f"near{k}" for k in range(50))), (101, " ".join(f"near{k}" for k in range(49)))]
    texts = spark.createDataFrame(rows, SCHEMA)
    sets = {i: simhash.shingle_set(t.encode(), s.width) for i, t in rows}
    often = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    found = simhash.shared_shingles(texts, often, s, 3)
    count = {}
    for x in sets.values():
        for token in x.tolist():
            count[token] = count.get(token, 0) + 1
    assert {(r["key"], r["df"]) for r in found.collect()} == {c for c in count.items() if c[1] > 1}
    first = spark.createDataFrame([(simhash.set_key(x), len(x), 0) for x in sets.values()], "node long, n int, n_frequent int").withColumn("frequent", F.array().cast("array<long>"))
    places = simhash.prefixes(first, found, s.similarity).collect()
    assert {r["node"] for r in places} == {simhash.set_key(sets[i]) for i in (100, 101)}


def test_block_pairs_leave_out_what_parities_rule_out():
    import numpy as np
    import pyarrow as pa

    near, far = np.arange(100, dtype=np.int64) << 54, (np.arange(100, dtype=np.int64) + 200) << 54
    one = lambda node, x: {"node": node, "n": 100, "i": 0, "root": node, "block": 0, "parities": simhash.parities(x)}
    members = pa.array([[one(1, near), one(2, near), one(3, far)]])
    found = np.concatenate(list(simhash.block_pairs(members, np.array([True]), 0.8)))
    assert found.tolist() == [[1, 2]]
