"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `window` consecutive words of an
item; an item with fewer words is one window as it is. Every window keeps the least of the hashes of its k-grams
(`gram` words). Two equal windows keep the same hash, so a shared span of at least `window` words always shares a
fingerprint. Fingerprints of documents and items are joined; where they meet, the windows that kept that fingerprint
are compared word for word with the items' windows, which extends each hit to its whole span.

Documents are cut into blocks of `block` window starts, so that rows stay small whatever a text's length. Every start
keeps one fingerprint, so a document's window is compared at most once, also where passages repeat. The items' side is
broadcast only if a count has shown it to be small.

Null texts have no words. Items without words or without an id are left out. Documents are told apart by doc_id and
text: repeated rows come back as often as they stand in the input, and a null doc_id is a document like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.shared import joined, small_batches, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    gram: int = 6
    block: int = 128


def folded(text: str) -> Column:
    """The text with A-Z lower-cased and null as empty; lower() does that for text of ASCII alone."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: str) -> Column:
    return F.array_remove(F.split(folded(text), NO_WORD), "")


def _kept(part: Column, size: int, gram: int) -> Column:
    """For every window of `size` words of an array of words, the least hash of its k-grams."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(part) - (gram - 1)), lambda i: F.xxhash64(*(F.element_at(part, i + k) for k in range(gram))))
    if size == gram:
        least = hashes
    else:
        least = F.transform(F.sequence(F.lit(1), F.size("hashes") - (size - gram)), lambda i: F.least(*(F.element_at("hashes", i + k) for k in range(size - gram + 1))))
    return hashes, least


def _windows(rows: DataFrame, keys: list[str], size: int, s: Settings) -> DataFrame:
    """rows(keys, words) -> (keys, at, part, kept): blocks of window starts, and the fingerprint that each start keeps."""
    gram = min(s.gram, size) if size == s.window else size
    n = F.size("words")
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - {size}) div {s.block}")), lambda c: F.struct((c * s.block).alias("at"), F.slice("words", c * s.block + 1, s.block + size - 1).alias("part")))
    cut = rows.where(n >= size).select(*keys, F.explode(blocks).alias("b")).select(*keys, "b.at", "b.part")
    hashes, least = _kept(F.col("part"), size, gram)
    return cut.withColumn("hashes", hashes).withColumn("kept", least).drop("hashes")


def _texts(part: Column, at: Column, size: int) -> Column:
    return F.array_join(F.slice(part, at, size), " ")


def item_windows(items: DataFrame, size: int, s: Settings) -> DataFrame:
    """items(item_id, words) -> (kept, window, item_id)."""
    rows = _windows(items, ["item_id"], size, s)
    return rows.select("item_id", "part", F.posexplode("kept").alias("nth", "kept")).select("kept", _texts(F.col("part"), F.col("nth") + 1, size).alias("window"), "item_id").distinct()


def hits(documents: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents(doc_id, text), items(item_id, text) -> a row a document: doc_id, n_words, spans, items.

    `spans` are the hit windows as structs (first word, word after the last), `items` the ids of the items whose windows occur.
    """
    small_batches(documents.sparkSession)
    known = written(items.where("item_id is not null").select("item_id", words("text").alias("words")).where(F.size("words") > 0), "items")
    short = sorted(r[0] for r in known.where(F.size("words") < s.window).select(F.size("words")).distinct().collect())
    kinds = [(s.window, known.where(F.size("words") >= s.window)), *((n, known.where(F.size("words") == n)) for n in short)]
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), words("text").alias("words")).withColumn("n_words", F.size("words"))
    keys, found = ["doc_id", "hash"], []
    for size, some in kinds:
        of_items = written(item_windows(some, size, s), "item-windows")
        prints = of_items.select("kept").distinct()
        mine = _windows(docs, keys, size, s)
        each = mine.select(*keys, "at", "part", F.col("kept").alias("all"), F.explode(F.array_distinct("kept")).alias("kept"))
        met = joined(each, prints, "kept", "left_semi")
        starts = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", i) == F.col("kept"))
        candidates = met.select(*keys, "at", "part", F.explode(starts).alias("nth")).select(*keys, (F.col("at") + F.col("nth") - 1).cast("long").alias("start"), _texts(F.col("part"), F.col("nth"), size).alias("window"))
        owners = of_items.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        found.append(joined(candidates, owners, "window").select(*keys, F.lit(None).cast("int").alias("n_words"), F.struct("start", (F.col("start") + size).alias("end")).alias("span"), "ids"))
    kind = items.schema["item_id"].dataType.simpleString()
    rows = docs.select(*keys, "n_words", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(None).cast(f"array<{kind}>").alias("ids"))
    for f in found:
        rows = rows.unionByName(f)
    merged = rows.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("times"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))
    return merged.select("doc_id", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")).drop("one")


def covered(spans: str = "spans") -> Column:
    """Number of words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")))["n"]


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all documents stand in 10-word windows of benchmark items."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = covered().cast("long")
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM ds),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
