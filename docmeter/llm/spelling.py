"""Spelling variants: words one edit apart, found through a reduced alphabet.

Each letter stands for one of a few symbols (a hash of the letter), which turns words into reduced words. Two words within
one edit have reduced words within one edit, so the one-edit neighbourhoods of all different reduced words, joined with
the reduced vocabulary, meet every near pair; the words behind each met pair are then compared as they are written
(Levenshtein distance exactly 1). A pair of reduced words is met from one side only, the longer or larger one, which
leaves about length * (symbols + 2) / 2 members of a neighbourhood to shuffle, where the whole alphabet would give
length * 90. The join's keys are short strings that no single word dominates. Words of more than 40 code points, whose
neighbourhoods would grow with the square of their length, meet by their halves instead: one edit leaves one half whole.

A word's form is its most frequent near word, if that is at least twice as frequent; roots follow the forms to the end by
pointer doubling, a join a step over tables in the shared folder (a chain at least doubles its count with each form, so it
has at most 61 steps and 6 doublings end it).

Null and empty texts have no words; texts of any length are read whole, in slices. A null doc_id counts as the empty
string in the noise rule. Repeated rows count as often as they stand. Equal counts: the smaller word in code-point order
is the form. An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import BASE, FOLD, Substrings, frugal, mixed, runs, text_slices
from docmeter.llm.shared import forget, joined, small_batches, table, written

ASCII = np.zeros(256, np.uint8)
ASCII[[*range(65, 91), *range(97, 123)]] = 1
SAME = np.arange(256, dtype=np.uint8)
#: Folded letters of a word: a to z and U+00C0 to U+00FF, whose UTF-8 is 0xC3 and a byte.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


@dataclass(frozen=True)
class Settings:
    symbols: int = 8
    least_length: int = 5  # code points
    least_count: int = 3
    noise: int = 97  # one (document, run) in so many loses a code point; 0: none
    whole: int = 40  # code points up to which neighbourhoods are made; longer words meet by halves
    factor: int = 2  # times a word's count that its form's must be


def _word_task(s: Settings) -> object:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, _, offsets, data in text_slices(batch.column("text"), 1 << 22):
                kind = ASCII[data]
                lead = data == 0xC3
                kind[lead] = 1
                kind[1:][lead[:-1]] = 1
                low = FOLD[data]
                start, end, _, text = runs(kind, offsets, SAME)
                before = np.concatenate([[0], np.cumsum(lead)])
                long = (end - start) - (before[end] - before[start]) >= s.least_length
                start, end, text = start[long], end[long], text[long]
                if not len(start):
                    continue
                key = Substrings(low)(start, end)
                _, first, times = np.unique(mixed(key + (text.astype(np.uint64) + np.uint64(1)) * BASE), return_index=True, return_counts=True)
                whole, prefix = low.tobytes(), {t: zlib.crc32(f"{'' if ids[i + t] is None else ids[i + t]}:".encode()) for t in np.unique(text).tolist()}
                crc = np.array([zlib.crc32(whole[a:b], prefix[t]) for a, b, t in zip(start[first].tolist(), end[first].tolist(), text[first].tolist(), strict=True)], np.int64)
                hit = crc % s.noise == 0 if s.noise else np.zeros(len(crc), bool)
                _, one, back = np.unique(key[first[~hit]], return_index=True, return_inverse=True)
                total = np.bincount(back, times[~hit], len(one)).astype(np.int64)
                at = first[~hit][one]
                names = [whole[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                changed: Counter = Counter()
                for p, h, n in zip(first[hit].tolist(), crc[hit].tolist(), times[hit].tolist(), strict=True):
                    w = whole[start[p] : end[p]].decode()
                    k = h % len(w)
                    if len(w) > s.least_length:
                        changed[w[:k] + w[k + 1 :]] += n
                yield pa.RecordBatch.from_arrays([pa.array(names + list(changed), pa.string()), pa.array([*total.tolist(), *changed.values()], pa.int64())], names=["word", "n"])

    return task


def vocabulary(docs: DataFrame, s: Settings) -> DataFrame:
    """docs(doc_id, text) -> (word, n) of every word that is long and frequent enough, counted over whole texts."""
    part = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(frugal(_word_task(s)), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_count)


def reduced(word: Column, symbols: int) -> Column:
    """The word with every letter replaced by its symbol."""
    return F.translate(word, ALPHABET, "".join(chr(97 + zlib.crc32(c.encode()) % symbols) for c in ALPHABET))


def neighbourhood(r: Column, symbols: int) -> Column:
    """r, its deletions and its replacements by a smaller symbol: with those of the other words, all one-edit neighbours. (An insertion is a deletion of the longer word, a replacement by a larger symbol is met from the other word.)"""
    letters = F.array(*(F.lit(chr(97 + i)) for i in range(symbols)))
    head = lambda i: F.substr(r, F.lit(1), i)
    tail = lambda i: F.substr(r, i)
    places = F.sequence(F.lit(1), F.length(r))
    deleted = F.transform(places, lambda i: F.concat(head(i - 1), tail(i + 1)))
    smaller = lambda i: F.filter(letters, lambda c: c < F.substr(r, i, F.lit(1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(smaller(i), lambda c: F.concat(head(i - 1), c, tail(i + 1)))))
    return F.array_distinct(F.concat(F.array(r), deleted, replaced))


def long_pairs(words: DataFrame, s: Settings) -> DataFrame:
    """(word, n, near, near_n) candidates of which one at least is longer than `whole` code points, each way once.

    Words within one edit, the shorter of m code points, share their first or their last m div 2: four hashes a word.
    """
    long = words.where(F.length("word") >= s.whole)
    halves = []
    for less in (0, 1):
        m = F.length("word") - less
        size = F.floor(m / 2).cast("int")
        halves += [F.xxhash64(m, F.lit("first"), F.substr("word", F.lit(1), size)), F.xxhash64(m, F.lit("last"), F.substr("word", F.length("word") - size + 1))]
    keyed = long.select("word", "n", F.explode(F.array(*halves)).alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    met = keyed.join(other, "key").where("word < near").where((F.length("word") > s.whole) | (F.length("near") > s.whole))
    return met.select("word", "n", "near", "near_n").distinct()


def near_words(words: DataFrame, s: Settings) -> DataFrame:
    """words(word, n) -> (word, n, near, near_n), a row for each ordered pair exactly one edit apart."""
    keyed = words.where(F.length("word") <= s.whole).withColumn("r", reduced(F.col("word"), s.symbols))
    # different reduced words meet by their neighbourhoods, then stand for all their words
    known = keyed.select("r").distinct()
    met = known.select("r", F.explode(neighbourhood(F.col("r"), s.symbols)).alias("q")).join(known.withColumnRenamed("r", "q"), "q")
    left = keyed.join(met, "r").select("word", "n", "r", "q")
    right = keyed.select(F.col("r").alias("q"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    short = left.join(right, "q").where("r <> q or word < near").select("word", "n", "near", "near_n")
    pair = short.unionByName(long_pairs(words, s)).where(F.levenshtein("word", "near", 1) == 1)
    ways = F.array(*(F.struct(F.col(a).alias("word"), F.col(b).alias("n"), F.col(c).alias("near"), F.col(d).alias("near_n")) for a, b, c, d in (("word", "n", "near", "near_n"), ("near", "near_n", "word", "n"))))
    return pair.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): where following the forms ends."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(joined(at.select("word", "root"), step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        forget(at)
        at = after
    return at.select("word", "root")


def variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs(doc_id, text) -> word, n, n_near, form, form_n, root of every word."""
    small_batches(docs.sparkSession)
    words = written(vocabulary(docs, s), "spelling-words")
    best = near_words(words, s).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    fits = -F.col("best.m") >= s.factor * F.col("n")
    grouped = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "spelling")
    forget(words)
    root = roots(grouped.where("form is not null").select("word", "form"))
    return joined(grouped, root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of `documents` with its near words counted, its form and its root."""
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
