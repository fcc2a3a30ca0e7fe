"""op3's word ratios against the formulas computed word by word in plain Python."""

import math
from collections import Counter, defaultdict

from docmeter.llm import toxicity

TEXTS = [("you idiot and idiots", 1), ("idiot " * 3 + "你好世界你好世界", 1), ("a fine day and a fine tree", 0), ("Trees and days " + "abcdefghijklmnopqrstuvw", 0), ("", 0), (None, 1), ("unseen word", -1)]


def events(word, depth):
    for nth in range(len(word) + 1):
        back = min(nth, depth - 1)
        byte = word[nth] if nth < len(word) else 0
        at = lambda k: word[nth - k] if nth >= k else 0  # noqa: B023, E731
        yield (word[nth - back : nth], back == nth, byte), (at(2), at(1), byte)


def brute_force(s):
    t, o, tri_of = Counter(), Counter(), {}
    words = defaultdict(Counter)
    for text, label in TEXTS:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in low.encode().split():
            words[w][label] += 1
    for w, n in words.items():
        if not n[1] + n[0]:
            continue
        for key, tri in events(w, s.depth):
            t[key] += n[1]
            o[key] += n[0]
            tri_of[key] = tri
    keys = set(tri_of)
    n3, n2 = Counter(tri_of.values()), Counter(x[:2] for x in tri_of.values())
    parent = defaultdict(list)
    for k in keys:
        parent[k[:2]].append(k)
    ratio = {}
    for k in keys:
        family, d = parent[k[:2]], s.discount
        shared = (n3[tri_of[k]] + 0.001) / (n2[tri_of[k][:2]] + 0.256)
        both = sum(t[x] + o[x] for x in family)
        pooled = (max(t[k] + o[k] - d, 0) + d * len(family) * shared) / both

        def own(c):
            p = sum(c[x] for x in family)  # noqa: B023
            return (max(c[k] - d, 0) + (d * sum(c[x] > 0 for x in family) + s.prior) * pooled) / (p + s.prior) if p else pooled  # noqa: B023

        ratio[k] = math.log(own(t) / own(o))
    value = {w: sum(ratio.get(key, 0.0) for key, _ in events(w, s.depth)) for w in words}
    return {w: v for w, v in value.items() if abs(v) > s.margin}


def test_word_values(spark):
    s = toxicity.Settings(margin=0.1, depth=5)
    rows = spark.createDataFrame([(t, y) for t, y in TEXTS], "text string, counted long")
    found = toxicity.written(toxicity.corpus_words(rows), "words")
    got = {bytes(r["bytes"]): r["value"] for r in found.join(toxicity.lexicon(found, s), "word").collect()}
    want = brute_force(s)
    assert want and got.keys() == want.keys() and all(math.isclose(got[w], want[w], abs_tol=1e-9) for w in want)


def test_ratios_from_many_files(spark):
    import numpy as np
    from docmeter.llm import ngrams

    folder, r = ngrams.new_folder(spark, "ratios"), np.random.RandomState(0)
    keys = np.unique(r.randint(-(1 << 62), 1 << 62, 500))
    df = spark.createDataFrame([(int(k), float(i)) for i, k in enumerate(keys)], "key long, ratio double")
    bits = toxicity.ratio_files(df, folder, rows=60)
    asked = np.concatenate([keys, keys[:9], [5, 6, 7]]).astype(np.int64).view(np.uint64)
    got = toxicity.ratios_of(asked, bits, lambda k: ngrams.opened(folder, f"ratios-{k}"))
    assert bits >= 3 and got.tolist() == [*range(500), *range(9), 0, 0, 0]
    assert toxicity.ratio_files(df.limit(0), folder) == 0


def test_features_keep_every_row(spark):
    rows = spark.createDataFrame([(1, "bad bad good"), (1, "bad bad good"), (None, None), (3, "")], "doc_id long, text string")
    found = toxicity.written(toxicity.corpus_words(rows.selectExpr("text", "cast(null as long) as counted")), "words")
    values = found.where("bytes = cast('bad' as binary)").selectExpr("word", "5.0D as value")
    got = sorted((r["doc_id"] or 0, round(r["ratio"], 9)) for r in toxicity.features(rows, values, toxicity.Settings()).collect())
    assert got == [(0, 0.0), (1, round(4 / 53, 9)), (1, round(4 / 53, 9)), (3, 0.0)]
