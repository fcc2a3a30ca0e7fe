"""Language-model scoring: interpolated modified Kneser-Ney over token n-grams.

Counting. One pass counts the tokens; words get ids in order of frequency (0: a text's end, 1: before its begin). A second
pass turns texts into n-grams of ids, sums equal ones in each slice of texts and sends them, sorted and packed, to shards.
A shard sums its n-grams, stores them, and sends each different one without its first id to the next lower order, where
it counts once (with all its occurrences where it begins a text): Kneser-Ney's continuation counts. So every order is one
exchange, and all n-grams of the corpus are kept: what is stored grows with the input.

A shard holds the n-grams of the contexts that hash to it. A context that may have more than a shard's share of tokens (by
the count of its rarest word) is spread over several shards by the n-gram's last word; its sums are added when it is read.

Store. A shard is one file in the shared folder: 48-bit n-gram hashes in order (the shard's number stands for more bits),
each with the place of its count in a short table, and the same for contexts with their total and their numbers of n-grams
of count 1, 2 and more. Workers memory-map the files, so all workers of a machine share one copy in the page cache; where
the shared folder isn't mounted, a file is fetched once into the executor's own Spark folder first.

Scoring. p(w | context) = max(0, c - D(c)) / total + gamma(context) * p(w | shorter context), with D1, D2 and D3+ of each
order from its counts of counts, down to 1 / (V + 1) for a word that was never seen; an unknown context passes the shorter
one's probability on. The score sums log10 p over a text's tokens and its end.

Null and empty texts have the end alone. A null doc_id is scored and never learned from (held_out false). Repeated rows
count and are scored each. Texts of any length are read whole, in slices of whole texts. Without training texts every
probability is 1 / (V + 1) = 1. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import BASE, FOLD, Substrings, frugal, frugal_group, mixed, runs, text_slices
from docmeter.llm.shared import forget, learn_fold, shared_folder, small_batches, table, written

WORD = np.ones(256, np.uint8)
WORD[[32, *range(9, 14)]] = 0
END, BEGIN, UNKNOWN = 0, 1, -1
ENDING = np.uint64(0x5DEECE66D)  # stands in the vocabulary for a text's end


@dataclass(frozen=True)
class Settings:
    order: int = 3
    slice_bytes: int = 1 << 23
    shard_tokens: int = 1 << 21
    vocabulary_words: int = 1 << 20  # of a file of the vocabulary


# files of arrays


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of several arrays. Written beside and renamed, so a task that runs twice leaves one whole file."""
    out, ends = io.BytesIO(), []
    for a in arrays:
        out.write(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.int64).tobytes() + a.tobytes() + bytes(-a.nbytes % 8))
        ends.append(out.tell())
    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(out.getvalue())
    store.move(part, f"{path}/{name}")


def opened(folder: str, name: str) -> list[np.ndarray]:
    """save()'s arrays, memory-mapped."""
    store, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if not isinstance(store, fs.LocalFileSystem):
        from pyspark import SparkFiles

        own = f"{SparkFiles.getRootDirectory()}/{os.path.basename(folder)}-{name}"
        if not os.path.exists(own):
            part = f"{own}.{uuid.uuid4().hex}"
            with store.open_input_stream(path) as source, open(part, "wb") as f:
                while block := source.read(1 << 22):
                    f.write(block)
            os.replace(part, own)
        path = own
    data = np.memmap(path, np.uint8, "r")
    at, out = 0, []
    while at < len(data):
        kind, width, n = data[at : at + 24].view(np.int64).tolist()
        out.append(data[at + 24 : at + 24 + n * width].view(f"{chr(kind)}{width}"))
        at += 24 + n * width + -(n * width) % 8
    return out


def least(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


# tokens and n-grams


def tokens(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, hash of every token with the end of each text, and its text number, by slices of whole texts."""
    for i, j, offsets, data in text_slices(column, size):
        low = FOLD[data]
        start, end, _, text = runs(low, offsets, WORD)
        n = np.bincount(text, minlength=j - i)
        key = np.full(len(start) + j - i, ENDING)
        key[np.arange(len(start)) + text] = Substrings(low)(start, end)
        yield i, j, key, np.repeat(np.arange(j - i), n + 1)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and each row's place among them."""
    code, one = pd.factorize(key)
    by = np.argsort(one)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return one[by], place[code]


def grams(ids: np.ndarray, text: np.ndarray, order: int, begin: int = BEGIN) -> list[np.ndarray]:
    """Columns of ids, the last word's last; `begin` stands before each text."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    nth = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
    out = []
    for back in range(order - 1, 0, -1):
        c = np.full(len(ids), begin, np.int64)
        c[nth >= back] = ids[np.flatnonzero(nth >= back) - back]
        out.append(c)
    return [*out, ids]


def fold(columns: list[np.ndarray], n: int) -> np.ndarray:
    """64-bit hash of each row."""
    h = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    for c in columns:
        h = mixed(h * BASE + c.view(np.uint64) + np.uint64(1))
    return h


def summed(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order, with their counts added up."""
    if not len(count):
        return columns, count
    # neighbouring columns that fit one number are sorted as one
    bits = int(max(c.max() for c in columns)).bit_length()
    each = max(1, 63 // max(1, bits))
    keys = [reduce(lambda a, b: (a << bits) | b, columns[k : k + each]) for k in range(0, len(columns), each)]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(count[order], at)


def counted(ids: np.ndarray, which: np.ndarray, text: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of a slice whose tokens are `which` of `ids`: different ones in order, and how often each stands."""
    own, local = np.unique(np.append(ids, BEGIN), return_inverse=True)
    bits = len(own).bit_length()
    columns = grams(local[:-1][which], text, order, int(local[-1]))
    if bits * order > 63:
        return summed([own[c] for c in columns], np.ones(len(which), np.int64))
    one, count = np.unique(reduce(lambda a, b: (a << bits) | b, columns), return_counts=True)
    return [own[(one >> (bits * k)) & ((1 << bits) - 1)] for k in range(order - 1, -1, -1)], count


def packed(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """Sorted rows as compressed byte planes."""
    first = np.diff(columns[0], prepend=np.int64(0))
    planes = [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T) for c in (first, *columns[1:], count)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpacked(blob: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(order + 1, 8, -1)
    columns = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum(columns[0]), *columns[1:-1]], columns[-1]


class Places:
    """Which shard an n-gram and its context belong to. `common`: counts of the words that are more frequent than a shard's tokens, by id."""

    def __init__(self, shards: int, common: np.ndarray, limit: int):
        self.shards, self.common, self.limit = shards, common, limit

    def spread(self, context: list[np.ndarray], n: int) -> np.ndarray:
        """Over how many shards each context is dealt."""
        most = np.full(n, self.shards, np.int64)
        for c in context:
            known = self.common[np.minimum(np.maximum(c, 0), len(self.common) - 1)]
            most = np.minimum(most, -(-np.where((c >= 0) & (c < len(self.common)), known, 1) // self.limit))
        return most

    def base(self, context: list[np.ndarray], n: int) -> np.ndarray:
        return (fold(context, n) >> np.uint64(20)) % np.uint64(self.shards)

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        n = len(columns[-1])
        part = mixed(columns[-1].view(np.uint64)) % self.spread(columns[:-1], n).astype(np.uint64)
        return ((self.base(columns[:-1], n) + part) % np.uint64(self.shards)).astype(np.int64)


def dealt(columns: list[np.ndarray], count: np.ndarray, places: Places) -> Iterator[tuple[int, bytes]]:
    """Sorted rows by shard."""
    shard = places.of(columns)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(shard[at[0]]), packed([c[at] for c in columns], count[at])


# vocabulary


class Vocabulary:
    """Ids and counts of words, from files by the top bits of their hashes."""

    def __init__(self, folder: str, bits: int):
        self.bits, self.file = bits, functools.cache(lambda k: opened(folder, f"words-{k}"))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of hashes in order: id (or UNKNOWN) and count."""
        ids, n = np.full(len(key), UNKNOWN, np.int64), np.zeros(len(key), np.int64)
        part = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        first = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(key))
        for lo, hi in zip(first, first[1:], strict=False):
            have, number, count = self.file(int(part[lo]))
            if len(have):
                at = np.minimum(np.searchsorted(have, key[lo:hi]), len(have) - 1)
                hit = have[at] == key[lo:hi]
                ids[lo:hi][hit], n[lo:hi][hit] = number[at[hit]], count[at[hit]]
        return ids, n


def learn_vocabulary(docs: DataFrame, folder: str, s: Settings) -> tuple[int, int, int, np.ndarray]:
    """Writes the words' files. Returns N, V, the files' bits and the counts of the words more frequent than a shard's tokens, by id."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key, _ in tokens(batch.column("text"), s.slice_bytes):
                word, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    found = written(docs.select("text").mapInArrow(frugal(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "ngram-words")
    n_tokens, n_words = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = max(0, (n_words // s.vocabulary_words).bit_length())
    # ids by frequency: the end first, then words in ranges of falling counts, each range numbered in its own task
    ranged = written(found.orderBy((F.col("word") == int(ENDING)).desc(), F.desc("n"), "word").withColumn("m", F.monotonically_increasing_id()), "ngram-ids")
    sizes = ranged.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("size")).orderBy("p").collect()  # a number a partition
    firsts, total = {}, 0
    for r in sizes:
        firsts[r["p"]] = total
        total += r["size"]
    starts = spark.createDataFrame(list(firsts.items()) or [(0, 0)], "p long, first long")
    number = F.col("first") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    ids = ranged.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(starts), "p").select("word", "n", F.when(number == 0, END).otherwise(number + 1).alias("id"))

    def store(group: pa.Table) -> pa.Table:
        key = group.column("word").to_numpy().view(np.uint64)
        order = np.argsort(key)
        save(folder, f"words-{group.column('part')[0].as_py()}", [key[order], least(group.column("id").to_numpy()[order]), least(group.column("n").to_numpy()[order])])
        return pa.table({"part": group.column("part").slice(0, 1)})

    part = F.shiftrightunsigned("word", 64 - bits) if bits else F.lit(0).cast("long")
    made = {r["part"] for r in ids.withColumn("part", part).groupBy("part").applyInArrow(frugal_group(store), "part long").collect()}
    for k in set(range(1 << bits)) - made:
        save(folder, f"words-{k}", [np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)])
    often = ids.where(F.col("n") > s.shard_tokens).select("id", "n").collect()  # fewer than N / shard_tokens
    common = np.ones(max([r["id"] for r in often], default=1) + 1, np.int64)
    for r in often:
        common[r["id"]] = r["n"]
    forget(found, ranged)
    return n_tokens, n_words, bits, common


# counting


def _gram_task(folder: str, bits: int, places: Places, s: Settings) -> object:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, bits)
        for batch in batches:
            for _, _, key, text in tokens(batch.column("text"), s.slice_bytes):
                word, which = distinct(key)
                rows = list(dealt(*counted(vocabulary.find(word)[0], which, text, s.order), places))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    return task


def table_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values and each one's place among them."""
    code, uniq = pd.factorize(values)
    return uniq, least(code)


def halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits as arrays of 32 and 16."""
    return (key >> np.uint64(32)).astype(np.uint32), ((key >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def _shard_task(folder: str, order: int, places: Places) -> object:
    def task(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpacked(b.as_py(), order) for b in group.column("blob")]
        columns, count = summed([np.concatenate([p[0][k] for p in parts]) for k in range(order)], np.concatenate([p[1] for p in parts]))
        n = len(count)
        del parts
        key = fold(columns, n)
        by = np.argsort(key)
        values, code = table_of(count[by])
        arrays = [*halves(key[by]), code, values]
        # rows are in order, so a context's stand together
        context = columns[:-1]
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in context], axis=0) if context else False
        at = np.flatnonzero(new)
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count > 2)]
        one = fold([c[at] for c in context], len(at))
        by = np.argsort(one)
        code, different = pd.factorize(fold(sums, len(at)))
        first = np.empty(len(different), np.int64)
        first[code[::-1]] = np.arange(len(at))[::-1]
        save(folder, f"grams-{order}-{shard}", arrays + [*halves(one[by]), least(code[by]), *(least(x[first]) for x in sums)])
        out = []
        if order > 1:
            lower = summed(columns[1:], np.where(columns[1] == BEGIN, count, 1))
            out = list(dealt(*lower, places))
        figures = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [n, int(count.sum())]
        return pa.table({"shard": pa.array([*(r[0] for r in out), shard], pa.int64()), "blob": pa.array([*(r[1] for r in out), None], pa.binary()), "figures": pa.array([None] * len(out) + [figures], pa.list_(pa.int64()))})

    return task


def discounts(counts: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams of count 1 to 4; halves where a corpus is too small to say."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


@dataclass(frozen=True)
class Model:
    """What scoring needs beside the files."""

    folder: str
    order: int
    bits: int
    n_tokens: int
    n_words: int
    shards: int
    common: np.ndarray
    limit: int
    figures: dict[int, list[int]]  # by order: n-grams of count 1 to 4, all, their counts' sum


def learn(docs: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """A model of docs(text), with its files in a new folder of the shared one."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "ngrams")
    n_tokens, n_words, bits, common = learn_vocabulary(docs, folder, s)
    shards = max(1, -(-n_tokens // s.shard_tokens))
    places = (shards, common, s.shard_tokens)
    rows = docs.select("text").mapInArrow(frugal(_gram_task(folder, bits, Places(*places), s)), "shard long, blob binary")
    figures, last = {}, None
    for order in range(s.order, 0, -1):
        out = written(rows.groupBy("shard").applyInArrow(frugal_group(_shard_task(folder, order, Places(*places))), "shard long, blob binary, figures array<long>"), f"ngram-counts-{order}")
        figures[order] = [x or 0 for x in out.select(*(F.sum(F.col("figures")[k]).alias(f"f{k}") for k in range(6))).first()]
        if last is not None:
            forget(last)
        last, rows = out, out.where("blob is not null").select("shard", "blob")
    forget(last)
    return Model(folder, s.order, bits, n_tokens, n_words, shards, common, s.shard_tokens, figures)


# scoring


class Reader:
    """Probabilities from a model's memory-mapped files."""

    def __init__(self, m: Model):
        self.m, self.places = m, Places(m.shards, m.common, m.limit)
        self.vocabulary = Vocabulary(m.folder, m.bits)
        self.less = {k: np.array([0.0, *discounts(f[:4])]) for k, f in m.figures.items()}
        self.file = functools.lru_cache(4096)(lambda k, shard: opened(m.folder, f"grams-{k}-{shard}"))

    def find(self, order: int, what: int, shard: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """Of each (shard, key): the stored values (an n-gram's count; a context's total and three numbers), 0 where there is none.

        Rows are looked up in the files' own order, so that neighbours read the same pages.
        """
        high, low = halves(key)
        if self.m.shards <= 1 << 16:
            by = np.argsort((shard.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)))
        else:
            by = np.lexsort((key, shard))
        shard, high, low = shard[by], high[by], low[by]
        out = [np.zeros(len(key), np.int64) for _ in range(1 if what == 0 else 4)]
        for lo, hi in zip(first := np.flatnonzero(np.diff(shard, prepend=-1)), [*first[1:], len(shard)], strict=True):
            try:
                arrays = self.file(order, int(shard[lo]))
            except FileNotFoundError:  # a shard without n-grams
                continue
            have, rest, code, *values = arrays[:4] if what == 0 else arrays[4:]
            place, at = np.searchsorted(have, high[lo:hi]), np.arange(hi - lo)
            while True:
                at = at[place[at] < len(have)]
                at = at[have[place[at]] == high[lo:hi][at]]
                if not len(at):
                    break
                same = rest[place[at]] == low[lo:hi][at]
                hit = at[same]
                for o, v in zip(out, values, strict=True):
                    o[by[lo + hit]] = v[code[place[hit]]]
                at = at[~same]
                place[at] += 1
        return out

    def values(self, order: int, what: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        """find() for n-grams (what 0) or contexts (what 1) of ids; single ids are looked up once each."""
        back = None
        if len(columns) == 1:
            back, one = pd.factorize(columns[0])
            columns = [one]
        n = len(columns[0])
        key = fold(columns, n)
        if what == 0:
            out = self.find(order, 0, self.places.of(columns), key)
        else:
            base, spread, out = self.places.base(columns, n), self.places.spread(columns, n), [np.zeros(n, np.int64) for _ in range(4)]
            for k in range(int(spread.max(initial=0))):
                at = np.flatnonzero(spread > k)
                for a, b in zip(out, self.find(order, 1, ((base[at] + np.uint64(k)) % np.uint64(self.m.shards)).astype(np.int64), key[at]), strict=True):
                    a[at] += b
        return out if back is None else [x[back] for x in out]

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """p of each row's last id after the others."""
        m = self.m
        p = np.full(len(columns[-1]), 1 / (m.n_words + 1))
        for order in range(1, m.order + 1):
            part = columns[m.order - order :]
            (count,) = self.values(order, 0, part)
            less = self.less[order]
            own = np.maximum(count - less[np.minimum(count, 3)], 0)
            if order == 1:
                f = m.figures[1]
                total, freed = np.full(len(own), f[5]), np.full(len(own), less[1:] @ np.array([f[0], f[1], f[4] - f[0] - f[1]], float))
            else:
                total, *kinds = self.values(order, 1, part[:-1])
                freed = less[1] * kinds[0] + less[2] * kinds[1] + less[3] * kinds[2]
            seen = total > 0
            p[seen] = own[seen] / total[seen] + freed[seen] / total[seen] * p[seen]
        return p


def perplexities(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs(text and others) -> the others with n_tokens, n_known, base_score, score, perplexity."""
    others = [c for c in docs.columns if c != "text"]
    known = vars(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Model(**known))
        for batch in batches:
            for i, j, key, text in tokens(batch.column("text"), s.slice_bytes):
                word, which = distinct(key)
                ids, count = (x[which] for x in reader.vocabulary.find(word))
                first = np.searchsorted(text, np.arange(j - i))
                n = np.diff(first, append=len(text))
                base = np.add.reduceat(np.log10((count + 1) / (known["n_tokens"] + known["n_words"] + 1)), first)
                score = np.add.reduceat(np.log10(reader.probabilities(grams(ids, text, known["order"]))), first)
                arrays = [n.astype(np.int64), np.add.reduceat((count > 0).astype(np.int64), first), base, score, 10 ** np.minimum(-score / n, 300)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), *map(pa.array, arrays)], names=[*others, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(frugal(task), f"{schema}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def score(docs: DataFrame, s: Settings = Settings(), mod: int = 7, held: int = 2) -> DataFrame:  # noqa: B008
    """docs(doc_id, text) scored by a model of those whose crc32(doc_id) mod `mod` is not `held`."""
    fold_ = learn_fold(mod=mod)
    model = learn(docs.where(fold_ != held).select("text"), s)
    rows = docs.select("doc_id", F.coalesce(fold_ == held, F.lit(False)).alias("held_out"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), "text")
    return perplexities(rows, model, s)


def op13_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a trigram model of the rows whose crc32(doc_id) mod 7 is not 2."""
    return score(table(spark, sf_dir, "documents"))
