"""The stages against brute force on a small table, and their order."""

import re
from pathlib import Path

import pandas as pd

import corpus_pipeline
from docmeter.llm import quality
from docmeter.llm.shared import shared_folder, table, written

SMALL = "/root/testdata/sf0.001"


def shingles(t, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    before = docs.toPandas()
    labels = table(spark, SMALL, "labels")
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, SMALL), f"test-{name}")
        after = kept.toPandas()
        assert after["doc_id"].is_unique and set(after["doc_id"]) <= set(before["doc_id"])
        if name == "quality":
            scored = quality.score(spark, docs.select("doc_id", "text"), labels).where("predicted = 1")
            assert set(after["doc_id"]) == {r["doc_id"] for r in scored.collect()}
        elif name == "near_duplicates":
            sets = {i: shingles(t) for i, t in zip(before["doc_id"], before["text"], strict=True)}
            group = {i: i for i in sets}
            ids = sorted(sets)
            for x, i in enumerate(ids):
                for j in ids[:x]:
                    a, b = sets[i], sets[j]
                    if (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] != group[j]:
                        lo, hi = sorted((group[i], group[j]))
                        group = {k: lo if g == hi else g for k, g in group.items()}
            assert set(after["doc_id"]) == set(group.values())
        elif name == "repeats":
            old = dict(zip(before["doc_id"], before["text"], strict=True))
            assert all(len(t) <= len(old[i]) for i, t in zip(after["doc_id"], after["text"], strict=True))
            seen = {}
            for i, t in zip(before["doc_id"], before["text"], strict=True):
                for p in range(len(t.encode()) - 49):
                    s = t.encode()[p : p + 50]
                    seen[s] = min(seen.get(s, i), i)
            clean = {i for i, t in old.items() if all(seen[t.encode()[p : p + 50]] == i for p in range(len(t.encode()) - 49))}
            assert {i: old[i] for i in clean if old[i].strip()}.items() <= dict(zip(after["doc_id"], after["text"], strict=True)).items()
        elif name == "decontamination":
            word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            items = [cut(t) for t in pd.read_parquet(f"{SMALL}/benchmark.parquet")["text"]]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
            clean = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if not any(tuple(cut(t)[k : k + 10]) in windows for k in range(len(cut(t))))}
            assert set(after["doc_id"]) == clean
        else:
            assert set(after["doc_id"]) == set(before["doc_id"]) and (after["rate"] >= 0).all() and (after["copies"] >= 0).all()
        docs, before = kept, after


def test_run_leaves_only_its_last_table(spark, monkeypatch):
    def stage(spark, docs, sf_dir):
        counts = written(docs.groupBy("doc_id").count(), "counts")
        return docs.join(counts.select("doc_id"), "doc_id", "left_semi")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == table(spark, SMALL, "documents").count()
    assert [p.name[:11] for p in set(folder.iterdir()) - before] == ["stage-three"]


def test_near_duplicates_leaves_one_table(spark):
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    kept = corpus_pipeline.keep_one_of_near_copies(spark, table(spark, SMALL, "documents"), SMALL)
    assert [p.name[:6] for p in set(folder.iterdir()) - before] == ["firsts"]
    assert kept.count() > 0
