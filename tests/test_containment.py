"""Containment against every pair, by broadcast and by join."""

import random
import re

import pytest

from docmeter.operators.containment import held_needles

LETTERS = "ab1.é"


def slow(needle, text, edges):
    if not edges:
        return needle in text
    head, tail = ("(?<![0-9.])" if needle[0] in "0123456789." else ""), ("(?![0-9.])" if needle[-1] in "0123456789." else "")
    return re.search(head + re.escape(needle) + tail, text) is not None


@pytest.mark.parametrize("edges", [False, True])
@pytest.mark.parametrize("limit", [1 << 30, 300])
@pytest.mark.parametrize("scoped", [False, True])
def test_against_every_pair(spark, edges, limit, scoped):
    r = random.Random(1)
    texts = [(i, "".join(r.choice(LETTERS) for _ in range(r.randrange(120))) if i % 17 else None, r.choice("xy")) for i in range(200)]
    needles = []
    for i in range(120):
        t = texts[r.randrange(200)][1] or "q"
        k = r.randrange(len(t) or 1)
        needles.append((i, t[k : k + r.randrange(1, 60)] if i % 3 == 0 else "".join(r.choice(LETTERS) for _ in range(r.randrange(6))), r.choice("xy") if scoped else r.choice(["x", "y", None])))
    want = {(i, j) for i, n, s in needles for j, t, u in texts if n and t and s in (None, u) and slow(n, t, edges)}
    got = held_needles(spark.createDataFrame(needles, "needle_id long, needle string, s string"), spark.createDataFrame(texts, "text_id long, text string, s string"), ("s",), edges, limit).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_empty_tables(spark):
    n, t = spark.createDataFrame([(1, None), (2, "")], "needle_id long, needle string"), spark.createDataFrame([(1, "a")], "text_id long, text string")
    assert held_needles(n, t).count() == 0 and held_needles(n.limit(0), t.limit(0)).count() == 0
