"""Toxicity by class-conditional Kneser-Ney models of words.

An event is a word's next byte (or its end) after the word's bytes so far, at most `depth` - 1 of them, so a word's
probability is a product over all its bytes, however many. Each class discounts its own counts; the mass that the
discount frees goes to backoff counts that both classes share: the pooled counts after the same bytes, discounted in
turn in favour of how many different events end in the last three bytes, given the two before. An expression that neither
class has seen therefore adds nothing, and a rare one is smoothed alike in both.

Counts are gathered from all labelled rows by the learning rule, and every word of the corpus gets its log-likelihood
ratio from the ratios of all its events. Those are sorted arrays by 64-bit hashes in files of the shared folder, which
workers memory-map; they grow with the input.

A text's score compares the two classes' log-likelihoods per word: the mean of the words' log ratios as far as they are
beyond `margin` on either side (words that say little either way follow style instead), then a logistic calibration on a
part of the learning rows which the counts leave out.

Null and empty texts have no words and get the score at ratio 0. Null or repeated labels: null is not learned from, a
repeated label of one id counts once (the largest). Repeated rows are scored alike. With no labels of either class
every score is 0.5. A null doc_id is kept, scored, and never learned from (held_out null becomes false). Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import BASE, FOLD, Substrings, frugal, frugal_group, mixed, runs, text_slices
from docmeter.llm.ngrams import drop_folder, new_folder, opened, save
from docmeter.llm.shared import forget, joined, learn_fold, small_batches, table, written

WORD = np.zeros(256, np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Settings:
    depth: int = 12
    discount: float = 0.75
    prior: float = 4.0  # pooled events that each class's counts after a context are joined by
    margin: float = 3.0
    steady: int = 50  # words without evidence that are counted to every text, so that a few words alone decide little
    calibration_part: int = 4  # one learning row in so many calibrates and is not counted


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, key, start and length of each different word, which word each one is, and the words' text numbers."""
    low = FOLD[data]
    start, end, _, text = runs(low, offsets, WORD)
    key, first, which = np.unique(Substrings(low)(start, end), return_index=True, return_inverse=True)
    return low, key, start[first], (end - start)[first], which, text


def events(low: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words as bytes: key, parent (the bytes before), last three bytes and word number of every event."""
    length = np.diff(offsets)
    n = length + 1
    word = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[:-1][word] + nth
    byte = np.where(nth == length[word], 0, np.append(low, np.uint8(0))[at]).astype(np.int64)
    back = np.minimum(nth, depth - 1)
    parent = mixed(Substrings(low).raw(at - back, at) * np.uint64(2) + (back == nth).astype(np.uint64) + np.uint64(1))
    key = mixed(parent + (byte.astype(np.uint64) + np.uint64(1)) * BASE)
    before = lambda k: np.where(nth >= k, low[np.maximum(at - k, 0)], 0).astype(np.int64)
    return key, parent, (before(2) << 16) | (before(1) << 8) | byte, word


def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("counted").to_numpy(zero_copy_only=False)
        toxic, ordinary = (label == 1).astype(np.int64), (label == 0).astype(np.int64)
        for i, j, offsets, data in text_slices(batch.column("text"), 1 << 22):
            low, key, start, length, which, text = words(data, offsets)
            if not len(key):
                continue
            t, o = (np.bincount(which, x[i:j][text], len(key)).astype(np.int64) for x in (toxic, ordinary))
            whole = low.tobytes()
            text_of = pa.array([whole[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), text_of, pa.array(t), pa.array(o)], names=["word", "bytes", "t", "o"])


def corpus_words(rows: DataFrame) -> DataFrame:
    """rows(text, counted: 1 toxic, 0 ordinary, else not counted) -> (word, bytes, t, o) of every different word."""
    part = rows.select("text", F.coalesce("counted", F.lit(-1)).alias("counted")).mapInArrow(frugal(_word_task), "word long, bytes binary, t long, o long")
    return part.groupBy("word").agg(F.first("bytes").alias("bytes"), F.sum("t").alias("t"), F.sum("o").alias("o"))


def counts(known: DataFrame, s: Settings) -> DataFrame:
    """Counts (t, o) of every event in toxic and ordinary learning texts, from the words' counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, o = (batch.column(c).to_numpy() for c in ("t", "o"))
            for i, j, offsets, data in text_slices(batch.column("bytes")):
                key, parent, tri, word = events(data, offsets, s.depth)
                uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
                sums = [np.bincount(back, x[i:j][word], len(uniq)).astype(np.int64) for x in (t, o)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uniq.view(np.int64), parent[first].view(np.int64), tri[first], *sums)], names=["key", "parent", "tri", "t", "o"])

    part = known.select("bytes", "t", "o").mapInArrow(frugal(task), "key long, parent long, tri long, t long, o long")
    return part.groupBy("key").agg(F.first("parent").alias("parent"), F.first("tri").alias("tri"), F.sum("t").alias("t"), F.sum("o").alias("o"))


def ratios(count: DataFrame, s: Settings) -> DataFrame:
    """Log ratio of every counted event (key, ratio). One that no class has counted has none: what is freed after its context says how much text the classes have."""
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    parents = count.groupBy("parent").agg(F.sum("t").alias("pt"), F.sum("o").alias("po"), seen("t").alias("kt"), seen("o").alias("ko"), F.count("*").alias("k"))
    tri = count.groupBy("tri").agg(F.count("*").alias("n3"))
    two = tri.groupBy(F.expr("tri >> 8").alias("two")).agg(F.sum("n3").alias("n2"))
    backoff = tri.join(two, F.expr("tri >> 8") == F.col("two")).select("tri", ((F.col("n3") + 0.001) / (F.col("n2") + 0.256)).alias("shared"))
    less = lambda c: F.greatest(c - s.discount, F.lit(0.0))
    both = F.col("pt") + F.col("po")
    pooled = (less(F.col("t") + F.col("o")) + s.discount * F.col("k") * F.col("shared")) / both
    own = lambda c, p, k: F.when(F.col(p) > 0, (less(F.col(c)) + (s.discount * F.col(k) + s.prior) * F.col("pooled")) / (F.col(p) + s.prior)).otherwise(F.col("pooled"))
    return count.join(parents, "parent").join(backoff, "tri").withColumn("pooled", pooled).select("key", F.log(own("t", "pt", "kt") / own("o", "po", "ko")).alias("ratio"))


def ratio_files(ratio: DataFrame, folder: str, rows: int = 1 << 20) -> int:
    """Writes ratios(key, ratio) as sorted arrays, a file for each of 2**bits ranges of keys with about `rows` each. Returns bits."""
    bits = max(0, (ratio.count() // rows).bit_length())

    def store(group: pa.Table) -> pa.Table:
        key = group.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        save(folder, f"ratios-{group.column('part')[0].as_py()}", [key[order], group.column("ratio").to_numpy()[order]])
        return pa.table({"part": group.column("part").slice(0, 1)})

    part = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    made = {r["part"] for r in ratio.withColumn("part", part).groupBy("part").applyInArrow(frugal_group(store), "part long").collect()}
    for k in set(range(1 << bits)) - made:
        save(folder, f"ratios-{k}", [np.zeros(0, np.uint64), np.zeros(0)])
    return bits


def ratios_of(key: np.ndarray, bits: int, file: Callable[[int], list[np.ndarray]]) -> np.ndarray:
    """The ratios of events, 0 where an event has none."""
    one, back = np.unique(key, return_inverse=True)
    out = np.zeros(len(one))
    part = (one >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(first, np.append(first[1:], len(one)), strict=True):
        have, ratio = file(int(part[lo]))
        if len(have):
            at = np.minimum(np.searchsorted(have, one[lo:hi]), len(have) - 1)
            out[lo:hi] = np.where(have[at] == one[lo:hi], ratio[at], 0.0)
    return out[back]


def lexicon(found: DataFrame, s: Settings) -> DataFrame:
    """corpus_words() -> (word, value): the log ratio of every word in which it is beyond the margin. Every event's ratio counts: workers memory-map them all."""
    count = written(counts(found.where("t + o > 0"), s), "toxicity-counts")
    ratio = written(ratios(count, s), "toxicity-ratios")
    forget(count)
    folder = new_folder(found.sparkSession, "toxicity")
    bits = ratio_files(ratio, folder)
    forget(ratio)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = functools.cache(lambda k: opened(folder, f"ratios-{k}"))
        for batch in batches:
            word = batch.column("word").to_numpy()
            for i, j, offsets, data in text_slices(batch.column("bytes")):
                key, _, _, which = events(data, offsets, s.depth)
                value = np.bincount(which, ratios_of(key, bits, file), j - i)
                yield pa.RecordBatch.from_arrays([pa.array(word[i:j]), pa.array(value)], names=["word", "value"])

    value = found.select("word", "bytes").mapInArrow(frugal(task), "word long, value double")
    out = written(value.where(F.abs("value") > s.margin), "lexicon")
    drop_folder(found.sparkSession, folder)
    return out


def features(rows: DataFrame, values: DataFrame, s: Settings) -> DataFrame:
    """rows(doc_id, text, ...) without text, with the mean log ratio per word beyond the margin."""
    others = [c for c in rows.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in text_slices(batch.column("text")):
                _, key, _, _, which, text = words(data, offsets)
                one, times = np.unique(text * np.int64(len(key) + 1) + which, return_counts=True)
                owner = one // (len(key) + 1)
                ends = pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key[one % (len(key) + 1)].view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), *arrays], names=[*others, "word", "times"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    found = rows.mapInArrow(frugal(task), f"{schema}, word array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id())
    kept = [*others, "row", "n"]
    each = found.withColumn("n", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)).select(*kept, F.posexplode_outer(F.arrays_zip("word", "times")).alias("nth", "x")).select(*kept, "nth", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
    # a row's first word, or the null in place of words, keeps the row
    met = joined(each, values, "word", "left").where("value is not null or nth = 0 or nth is null")
    beyond = F.when(F.col("value") > 0, F.col("value") - s.margin).otherwise(F.col("value") + s.margin)
    summed = met.groupBy(*kept).agg((F.coalesce(F.sum(beyond * F.col("times")), F.lit(0.0)) / (F.first("n") + s.steady)).alias("ratio"))
    return summed.select(*others, "ratio")


def shape(ratio: np.ndarray) -> np.ndarray:
    """What the calibration reads of a text's ratio."""
    return np.stack([10 * ratio, np.sign(ratio) * np.log1p(50 * np.abs(ratio))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with a small penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + keep * w)
    return w


def score(spark: SparkSession, documents: DataFrame, labels: DataFrame, s: Settings = Settings(), calibration_rows: int = 20_000) -> DataFrame:  # noqa: B008
    """documents(doc_id, text) scored after learning from labels(doc_id, toxic). Returns doc_id, held_out, score, predicted, ratio.

    The calibration reads at most `calibration_rows` labelled rows (a number each); everything else covers all rows.
    """
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(learn_fold() != 1).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(s.calibration_part)) == 0
    rows = joined(documents.select("doc_id", "text"), known, "doc_id", "left").select("doc_id", "text", F.coalesce(learn_fold() == 1, F.lit(False)).alias("held_out"), F.when(apart, F.col("toxic")).alias("calibrates"), F.when(~apart, F.col("toxic")).alias("counted"))
    found = written(corpus_words(rows), "toxicity-words")
    values = lexicon(found, s)
    measured = written(features(rows.drop("counted"), values, s), "toxicity-features")
    forget(found, values)
    fit = measured.where("calibrates is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "ratio").limit(calibration_rows).select("calibrates", "ratio").toPandas()
    y = fit["calibrates"].to_numpy(float)
    weights = logistic(shape(fit["ratio"].to_numpy(float)), y) if 0 < y.sum() < len(y) else np.zeros(3)
    z = F.lit(float(weights[0])) * 10 * F.col("ratio") + F.lit(float(weights[1])) * F.signum("ratio") * F.log1p(50 * F.abs("ratio")) + F.lit(float(weights[2]))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return measured.select("doc_id", "held_out", p.alias("score"), (p >= 0.7).cast("int").alias("predicted"), "ratio")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored; labels learned from the rows whose crc32(doc_id) mod 3 is not 1."""
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
