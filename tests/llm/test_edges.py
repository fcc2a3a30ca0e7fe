"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: every operator and stage has a defined result."""

import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmeter.llm import decontaminate, language, license_scan, mixing, ogg, quality, simhash, suffix_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
ROWS = [
    (1, "Released under the MIT License.\nplain words of the first text stand here", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "fr", "s", 0),
    (3, "", "fr", "s", 0),
    (4, LONG, "en", "s", 5),
    (5, LONG, "en", "t", 5),
    (None, "a text without an id that is stupid trash", "en", "s", 3),
    (6, "çà et là des mots français éèà", "fr", None, 9),
    (7, "1234 !!! ...", "de", "s", 9),
    (8, "x\x00y nul", "es", "s", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, None, None), (4, 0, 1), (6, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_toxicity(spark, docs, none, labels):
    got = toxicity.score(spark, docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.score(spark, none, labels).count() == 0
    assert {r["score"] for r in toxicity.score(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_quality(spark, docs, none, labels):
    got = quality.score(spark, docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(spark, none, labels).count() == 0
    assert {r["score"] for r in quality.score(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_language(spark, docs, none):
    got = language.predict(spark, docs.select("doc_id", "text"), docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] in (2, 3, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr", "es", "de")
    assert language.predict(spark, none.select("doc_id", "text"), docs).count() == 0
    assert {r["lang_pred"] for r in language.predict(spark, docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_ogg(docs, none):
    got = ogg.media_columns(docs).collect()
    assert len(got) == len(ROWS)
    for r, (_, text, *_rest) in zip(got, ROWS, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert ogg.media_columns(none).count() == 0


def test_licenses(docs, none):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(ROWS)
    r = next(x for x in got if x["doc_id"] == 1)
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (1, 3, 3, "mit", "mit", 1.0)
    r = next(x for x in got if x["doc_id"] == 2)
    assert (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)
    assert license_scan.scan(none).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("w"), F.lit(2).alias("lead"), F.lit(3).alias("label"), F.lit(4).alias("hash"), F.lit(5).alias("word"))
    key = lambda r: (str(r["doc_id"]), r["n_words"])
    assert sorted(license_scan.scan(clash).collect(), key=key) == sorted(got, key=key)


def test_license_blocks_brute_force(spark):
    """Wrapped, edited, scattered and repeated notices, in short and in very long texts, against every window of every text."""
    rng, texts = random.Random(3), ["", None]
    for k, (_, notice) in enumerate(license_scan.TEMPLATES):
        w = notice.split()
        some = lambda n: [rng.choice(["the", "of", "software", "license", "under", "plain", "mit", "copy", "é"]) for _ in range(n)]
        texts += ["\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)), " ".join(x for x in w if rng.random() > 0.15)]
        texts += [" ".join(y for x in w for y in (x, *some(k % 3))), " ".join(some(500) + w[::-1] + some(500)), " ".join(y for x in w for y in (x, *some(200)))]
        texts += [" ".join(w[: len(w) // 2] + some(2) + w[len(w) // 2 :]) + "\n" + " ".join(w)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs, phrases={}).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(texts + texts[:9]):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        best = {}
        for k, tpl in enumerate(license_scan.templates_of(license_scan.TEMPLATES, 0.8)):
            most = max((len(set(tpl.words) & set(w[s : s + tpl.reach])) for s in range(len(w))), default=0)
            if most >= tpl.need:
                best[k] = (tpl.label, most / len(tpl.words))
        r = got[i]
        assert (r["labels"], r["n_templates"]) == (",".join(sorted({x for x, _ in best.values()})), len(best)), t
        assert abs(r["score"] - max((c for _, c in best.values()), default=0)) < 1e-12


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    ids = {r["doc_id"]: r["component_id"] for r in got}
    assert ids[2] == ids[3] == 2 and ids[4] == ids[5] == 4
    assert simhash.near_duplicates(none).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in simhash.similar(docs.select("doc_id", "text")).collect()} >= {(2, 2), (3, 2), (5, 4), (1, 1)}
    assert simhash.similar(none).count() == 0


def test_suffixes(docs, none):
    got = suffix_dedup.without_repeats(docs.withColumn("kept_sha", F.lit("x")))
    rows = got.collect()
    assert len(rows) == len(ROWS)
    one = {r["doc_id"]: r for r in rows}
    assert one[5]["n_removed"] == one[5]["n_bytes"] and one[5]["n_spans"] == 1 and one[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert one[4]["n_removed"] == 0 and one[2]["n_bytes"] == 0
    assert suffix_dedup.without_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    words = " ".join(LONG.split()[100:130])
    items = spark.createDataFrame([(1, words), (1, words), (2, "Mit license"), (3, None), (4, "--"), (None, words), (5, "nothing of this stands anywhere in any of those texts at all")], "item_id long, text string")
    got = decontaminate.hits(docs, items).collect()
    assert len(got) == len(ROWS)
    one = {r["doc_id"]: r for r in got}
    assert one[4]["items"] == [1] and len(one[4]["spans"]) == 21
    assert one[1]["items"] == [2] and [tuple(s) for s in one[1]["spans"]] == [(3, 5)]
    assert one[2]["n_words"] == 0 and one[2]["items"] == []
    assert decontaminate.hits(none, items).count() == 0
    assert all(r["items"] == [] for r in decontaminate.hits(docs, items.limit(0)).collect())


def test_mixing(docs, none):
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labelled, mixing.TARGETS).collect()
    assert len(got) == len(ROWS) and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    assert mixing.mix(none, labelled, mixing.TARGETS).count() == 0
    assert {r["rate"] for r in mixing.mix(docs, labelled.limit(0), mixing.TARGETS).collect()} == {1.0}


def test_warc(spark):
    same = "y" * 1500
    pages = spark.createDataFrame([(1, "http://a b\r\n", same), (2, None, same), (3, "u", None), (None, "u", same), (4, "u", "z" * 999), (5, "u", "z" * 999), (2, "again", same)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages), with_payload=True).collect()
    assert len(got) == 7
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("None", "revisit", 2), ("4", "response", None), ("5", "response", None)])
    assert all(r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in got if r["record_type"] == "response")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_reader_refuses_damage():
    whole = warc.record(1, "u", b"payload") + warc.record(2, "v", b"other", refers_to=1)
    split = [whole[:7], whole[7:50], whole[50:]]
    assert [r.headers["warc-type"] for r in warc.read_records(split)] == ["response", "revisit"]
    with pytest.raises(warc.BadRecord, match="cut off"):
        list(warc.read_records([whole[:-9]]))
    for old, new in ((b"payload", b"pAyload"), (b"Content-Length: 8", b"Content-Length: 9")):
        with pytest.raises((warc.BadRecord, KeyError)):
            list(warc.read_records([gzip.compress(gzip.decompress(warc.record(1, "u", b"payload")).replace(old, new))]))


def foreign(kind, block, *headers):
    return gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *headers, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_of_other_writers(spark, tmp_path):
    http = "Content-Type: application/http;msgtype=response"
    answer = b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\nbody"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        foreign("response", answer, http, "WARC-Target-URI: http://x/"),
        foreign("response", answer, http, f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'body').hexdigest()}", f"WARC-Block-Digest: md5:{hashlib.md5(answer).hexdigest()}"),
        foreign("response", chunked, http, "WARC-Payload-Digest: sha1:AAAA"),
        foreign("response", answer, http, "WARC-Payload-Digest: sha1:AAAA", "WARC-Truncated: length"),
        foreign("response", b"a dns answer", "Content-Type: text/dns", "WARC-Payload-Digest: xxh:1"),
        foreign("resource", b"", "Content-Type: text/plain"),
        foreign("revisit", b"", http),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "a" / "empty.warc.gz").write_bytes(b"")
    got = warc.read_files(spark, str(tmp_path), with_payload=True).collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "response", "response", "resource", "revisit"]
    assert [bytes(r["payload"])[:4] for r in got] == [b"soft", b"", b"body", b"body", b"4\r\nb", b"body", b"a dn", b"", b""]
    assert all(r["page_id"] is None and r["record_id"] == "<urn:uuid:1>" for r in got)
    assert got[2]["url"] == "http://x/" and got[2]["payload_digest"] == hashlib.sha1(b"body").hexdigest() and got[8]["payload_digest"] is None
    for wrong in (foreign("response", answer, http, "WARC-Payload-Digest: sha1:AAAA"), foreign("metadata", b"x", "WARC-Block-Digest: sha512:00"), foreign("response", b"no header", http)):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records([wrong]))


def test_stages(spark, docs, none, labels, tmp_path):
    items = spark.createDataFrame([(1, "no such words in any of the texts that stand in here")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.withColumn("score", F.lit(1)).withColumn("predicted", F.lit("p")).withColumn("kept_text", F.lit("k")).withColumn("rate", F.lit(2)).withColumn("block", F.lit(3)).withColumn("hash", F.lit(4))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, none, docs):
            got = stage(spark, rows, str(tmp_path))
            got.collect()
            if name != "mixing":
                assert got.columns == rows.columns
