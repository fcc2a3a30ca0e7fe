"""License scan: phrases in place, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.

Base labels come from the places where a phrase's words stand consecutively. The method finds every block of text that
holds at least `threshold` of a template's different words. A block is a run of consecutive words, across lines, of up to
the template's length / threshold: wrapped notices are found, and words that are scattered over a long text are not
taken for a notice. It is exact: nothing is sampled or capped.

Templates' words have one global order, the rarest in the corpus first. If a block and a template of m different words
share the needed a = ceil(threshold * m), then
- prefix: the block has one of the template's m - a + 1 rarest words. The places of such words are joined with the
  templates' prefixes, and the words around a place, as far as a block through it can reach, are its surroundings;
- length: the surroundings hold at least a of the template's words;
- position: of a prefix word at place i of the template and j of the surroundings' n template words, in global order, at
  most 1 + min(m - i, n - j) words from it on can be common, which must reach a. (The first common word of a block passes.)
What passes is verified by the whole intersection of every block in the surroundings. The templates are a fixed list, so
their side of the join, and the frequency of their words, have a size that no input changes. Texts are scanned once for
the words' frequencies and once for all the rest; only one row a document is shuffled.

Null and empty texts have no words and the score 0. Documents are told apart by doc_id and text: repeated rows come
back as often as they stand in the input, and a null doc_id is a document like others.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.decontaminate import NO_WORD, folded
from docmeter.llm.shared import table

#: Labelled phrases of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which works name their license, and sentences of the licenses' texts.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v. 2.0"),
    ("mit", "The software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "You may not use this file except in compliance with the License You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: list[str]  # different ones
    need: int
    reach: int  # words of the longest block


def templates_of(templates: list[tuple[str, str]], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        every = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        different = sorted(set(every))
        out.append(Template(label, different, math.ceil(threshold * len(different) - 1e-9), math.ceil(len(every) / threshold - 1e-9)))
    return out


def base(text: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """Columns of the places where the phrases' words stand consecutively in a folded text."""
    gap, edge = NO_WORD, NO_WORD[:-1]
    patterns = {p: rf"(?<![^{edge[1:-1]}]){gap.join(p.split())}(?![^{edge[1:-1]}])" for p in phrases}
    before = lambda p: F.size(F.array_remove(F.split(p, NO_WORD), "")).cast("long")
    anyone = "|".join(patterns.values())
    maybe = text.rlike(r"licen[sc]e") if all("license" in p for p in phrases) else F.lit(True)
    count = lambda p: F.when(maybe, F.regexp_count(text, F.lit(p))).otherwise(0)
    n = sum((count(p) for p in patterns.values()), F.lit(0)).cast("long")
    some = maybe & text.rlike(anyone)
    return {
        "n_base": n,
        "first_word": F.when(some, before(F.regexp_extract(text, rf"(?s)^(.*?)(?:{anyone})", 1))),
        "last_word": F.when(some, before(F.regexp_extract(text, rf"(?s)^(.*)(?:{anyone})", 1))),
        "base": F.array_compact(F.array(*(F.when(count(p) > 0, F.lit(phrases[k])) for k, p in patterns.items()))),
    }


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def best_blocks(documents: DataFrame, templates: list[Template]) -> DataFrame:
    """documents(doc_id, w, ...) -> its columns, lead, template, label, containment: a row for each place of a prefix word, and one
    for a document without any. Of the rows of one document exactly one has `lead`. The label is null where no block qualifies."""
    spark = documents.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = documents.select(F.explode("w").alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").count()
    often = {r["word"]: r["count"] for r in counts.collect()}  # a row a template word
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows, known = [], set()
    for k, t in enumerate(templates):
        ordered = sorted(t.words, key=rank.get)
        for i, w in enumerate(ordered[: len(ordered) - t.need + 1]):
            rows.append((k, t.label, ordered, t.need, t.reach, i + 1, w, w not in known))
            known.add(w)
    prefixes = spark.createDataFrame(rows, "template int, label string, words array<string>, need int, reach int, i int, word string, one boolean")
    probes = _strings(sorted(known))
    places = F.filter(F.transform("w", lambda x, p: F.struct(p.alias("p"), x.alias("word"))), lambda s: F.array_contains(probes, s["word"]))
    placed = documents.select("*", F.posexplode_outer(F.when(F.arrays_overlap("w", probes), places)).alias("k", "place"))
    met = placed.select("*", F.col("place.p").alias("p"), F.col("place.word").alias("word")).join(F.broadcast(prefixes), "word", "left")
    start = F.greatest(F.col("p") - F.col("reach") + 1, F.lit(0))
    around = met.withColumn("around", F.when(F.col("template").isNotNull(), F.slice("w", start + 1, F.col("p") - start + F.col("reach"))))
    mine = around.withColumn("mine", F.array_intersect(_strings(order), "around"))
    m, n, j = F.size("words"), F.size("mine"), F.array_position("mine", F.col("word"))
    may = (n >= F.col("need")) & (1 + F.least(m - F.col("i"), n - j) >= F.col("need")) & (F.size(F.array_intersect("words", "mine")) >= F.col("need"))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.size("around")), lambda s: F.size(F.array_intersect("words", F.slice("around", s, F.col("reach"))))))
    verified = mine.withColumn("common", F.when(may, most))
    found = F.col("common") >= F.col("need")
    lead = (F.coalesce("k", F.lit(0)) == 0) & F.coalesce("one", F.lit(True))
    return verified.select(*documents.columns, lead.alias("lead"), *(F.when(found, c).alias(a) for a, c in (("template", F.col("template")), ("label", F.col("label")), ("containment", F.col("common") / m))))


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates.

    The score is the largest containment of a block that meets the threshold, and 1 where a phrase stands; n_templates
    is how many templates have such a block.
    """
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), folded("text").alias("low")).withColumn("w", F.array_remove(F.split("low", NO_WORD), ""))
    counted = docs.select("doc_id", "hash", "w", F.size("w").cast("long").alias("n_words"), *(c.alias(k) for k, c in base(F.col("low"), phrases).items()))
    rows = best_blocks(counted, templates_of(templates, threshold)).drop("w")
    keys = [k for k in counted.columns if k != "w"]
    one = rows.groupBy(*keys).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count_if("lead").alias("times"), F.size(F.collect_set("template")).cast("long").alias("n_templates"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    result = one.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", "found")).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "n_templates", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one"))
    return result.drop("one")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({k}, '{t.label}', [{', '.join(repr(w) for w in t.words)}], {t.need}, {t.reach})" for k, t in enumerate(templates_of(TEMPLATES, THRESHOLD)))
    cut = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    starts = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i - 1 AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = [{', '.join(repr(x) for x in p.split())}]" for p, label in PHRASES.items())
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, {cut.format('t')} AS w FROM low),
tpl(k, label, words, need, reach) AS (VALUES {values}),
hit AS ({starts}),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS base FROM hit GROUP BY doc_id),
likely AS (SELECT doc_id, w, k, label, words, need, reach FROM d, tpl WHERE len(list_intersect(words, w)) >= need),
m AS (SELECT doc_id, k, label, max(len(list_intersect(words, w[i:i + reach - 1]))) * 1.0 / any_value(len(words)) AS c
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely) GROUP BY doc_id, k, label HAVING max(len(list_intersect(words, w[i:i + reach - 1]))) >= any_value(need)),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS best, count(*) AS n_templates FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CAST(CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(best, 0) END AS DOUBLE) AS score, coalesce(n_templates, 0) AS n_templates
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


OP2_SQL = _sql()
