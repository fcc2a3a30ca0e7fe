"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints: the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of `width` words (repeats count;
fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is set if it is in over half of them. A text without
words has fingerprint zero and is linked like any other.

Linking works on different fingerprints. Their bits are put into parts so that bits which differ together share a part
(greedily, by the bits' correlation over all fingerprints): parts that vary independently make better filters. By the
general pigeonhole principle two fingerprints at distance <= t agree to within t_i bits on some part i whenever the t_i
sum to t - parts + 1; a part may have t_i = -1, which takes no part in it. Dynamic programming allots the t_i with the
least estimated work: for each part and threshold the probes sent and the candidates they meet. The candidates at t_i = 0
are measured (the sum of squared counts of the part's values), at t_i > 0 extended by the measured rates at which single
bits differ. The number of parts is chosen by the same estimate.

A fingerprint then probes every key of its part within t_i bits. A bucket of up to `bucket` fingerprints is verified pair
by pair inside one row. A larger bucket is split exactly: its members agree on the part, so two of them at distance <= t
agree on one of t + 1 cuts of the remaining bits, and each member goes to t + 1 smaller buckets, again and again. Different
fingerprints that agree on all but r bits are at most 2**r, so this ends with small buckets; nothing is capped. A bucket
returns only links that join its members' groups (a spanning forest), never all its pairs.

Defined cases: null text counts as empty; repeated rows share a fingerprint; a null doc_id keeps its row, takes no part in
the choice of the smallest id, and its component_id is that of the other rows, or null if none has an id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmeter.llm.byteops import FOLD, frugal, frugal_group, text_slices
from docmeter.llm.components import components
from docmeter.llm.shared import forget, joined, small_batches, table, written

LOWER = bytes(FOLD)


@dataclass(frozen=True)
class Settings:
    width: int = 3
    distance: int = 2
    bucket: int = 128


def fingerprint(text: bytes, width: int) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return majority(line, starts, stops)


def majority(line: bytes, starts: list[int], stops: list[int], block: int = 1 << 14) -> int:
    """Bits that are set in over half of the hashes of line[start:stop]."""
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(starts), block):
        hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[k : k + block], stops[k : k + block], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        # sums of at most 255 rows fit a byte
        total += sum(np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255))
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def with_fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fp)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j, offsets, data in text_slices(batch.column("text")):
                whole = data.tobytes()
                out[i:j] = [fingerprint(whole[offsets[k] : offsets[k + 1]], width) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(task), "doc_id long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits that are set together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy(zero_copy_only=False))
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "both"])

    parts = prints.select("fp").mapInArrow(frugal(task), "n long, both array<double>").select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("both")).orderBy("pos").collect()
    if not parts:
        return 0, np.zeros((64, 64))
    return int(parts[0]["n"]), np.array([r["both"] for r in parts]).reshape(64, 64)


def _bits(prints: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column b is bit b."""
    return ((prints.astype(np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def arrange(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal width with correlated bits together: each is seeded with the bit that has most unused correlation."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))  # noqa: B023
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def allot(costs: list[list[float]], distance: int, most: int) -> tuple[float, list[int]] | None:
    """Thresholds from -1 to most, one a part, that sum to distance - parts + 1 and cost least; costs[i][t] for t >= 0. None if there are none."""
    goal = distance - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, most + 1):
                price = (spent + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if total + t not in after or price < after[total + t]:
                    after[total + t] = price
        best = after
    return best.get(goal)


def plan(prints: DataFrame, s: Settings, most: int | None = None, sample: int = 1_000_000) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that takes part, for the number of parts with the least estimated work.

    No threshold is above `most` (0: parts must agree as they are, so nothing is probed with flipped bits).
    The estimate looks at about `sample` fingerprints; it decides how fast the search is, not what it finds.
    """
    n, both = bit_statistics(prints)
    mean = np.diag(both) / max(n, 1)
    differ = 2 * mean * (1 - mean)
    arranged = [arrange(n, both, parts) for parts in range(2, s.distance + 3)]
    masks = sorted({mask_of(bits) for some in arranged for bits in some})
    rate = min(1.0, sample / max(n, 1))
    some_prints = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < rate * 1e6)
    sums = some_prints.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)))).alias("x")).groupBy("x.part", "x.value").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("agree")).collect()
    agree = {masks[r["part"]]: r["agree"] / rate**2 for r in sums}
    options = []
    for some in arranged:
        costs = []
        for bits in some:
            odds = differ[bits] / np.maximum(1 - differ[bits], 0.1)
            # elementary symmetric sums of the odds: pairs that differ in exactly t of the part's bits, against those in none
            shape = [1.0] + [0.0] * s.distance
            for o in odds:
                for t in range(s.distance, 0, -1):
                    shape[t] += o * shape[t - 1]
            probes, ways = [0.0], 1.0
            for t in range(1, s.distance + 1):
                ways = ways * (len(bits) - t + 1) / t
                probes.append(probes[-1] + ways)
            base = agree.get(mask_of(bits), 0.0)
            costs.append([max(n, 1) * (1 + probes[t]) * 8 + base * sum(shape[: t + 1]) for t in range(s.distance + 1)])
        if found := allot(costs, s.distance, s.distance if most is None else most):
            options.append((*found, some))
    _, thresholds, some = min(options, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(some, thresholds, strict=True) if t >= 0]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to `most` of the bits."""
    out, level = [0], [(0, -1)]
    for _ in range(most):
        level = [(m | 1 << b, k) for m, last in level for k, b in enumerate(bits) if k > last]
        out += [m for m, _ in level]
    return out


def spanning(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different prints: each one that others reach by steps of at most `distance` bits, and the least of its group."""
    x = prints.view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x) <= distance
    group = np.arange(len(x))
    while True:
        least = np.where(near, group, len(x)).min(1)
        if (least == group).all():
            break
        group = least
    moved = np.flatnonzero(group != np.arange(len(x)))
    return prints[moved], prints[group[moved]]


@F.udf(T.ArrayType(T.StructType([T.StructField("mask", T.LongType()), T.StructField("key", T.LongType())])), useArrow=True)
def _cuts(mask: int, fp: int, distance: int) -> list[tuple[int, int]]:
    """Of a fingerprint in a large bucket whose members agree on mask: masks with a part of the remaining bits added, and its bits there."""
    rest = [b for b in range(64) if not mask >> b & 1]
    parts = min(distance + 1, len(rest))
    added = [sum(1 << b for b in rest[k::parts]) for k in range(parts)]
    return [(signed((mask & (1 << 64) - 1) | a), signed(fp & ((mask & (1 << 64) - 1) | a))) for a in added]


def links(prints: DataFrame, s: Settings) -> DataFrame:
    """prints(fp), all different -> links(a, b) with the same components as all pairs at most s.distance bits apart."""
    probes = []
    for bits, t in plan(prints, s):
        mask = mask_of(bits)
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        keys = F.array(*(own.bitwiseXOR(F.lit(signed(m))) for m in _flips(bits, t))) if t else F.array(own)
        # a probe with flipped bits meets its partner under the partner's own key
        probes.append(prints.select(F.lit(signed(mask)).alias("mask"), "fp", F.posexplode(keys).alias("nth", "key"), F.lit(t).alias("t")))
    found = None
    open_ = probes[0]
    for p in probes[1:]:
        open_ = open_.union(p)
    last = None
    while True:
        open_ = written(open_, "probes")
        if last is not None:
            forget(last)
        size = open_.groupBy("mask", "key").agg(F.count("*").alias("n"), F.max((F.col("nth") == 0).cast("int")).alias("own")).where("n > 1 and own = 1")
        grouped = open_.join(size, ["mask", "key"])
        small = grouped.where((F.col("n") <= s.bucket)).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    fps = batch.column("fps").slice(first, 256)
                    pairs = [spanning(np.unique(v.values.to_numpy(zero_copy_only=False)), s.distance) for v in fps]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], names=["a", "b"])

        verified = written(small.mapInArrow(frugal(verify), "a long, b long").distinct(), "verified")
        found = verified if found is None else found.union(verified)
        large = grouped.where(F.col("n") > s.bucket)
        if large.isEmpty():
            forget(open_)
            return found
        # Members of a bucket reached by flipped bits agree on the part's unflipped bits only: they are cut again from no bits.
        start = F.when(F.col("t") == 0, F.col("mask")).otherwise(F.lit(0))
        last, open_ = open_, large.select("fp", F.explode(_cuts(start, F.col("fp"), F.lit(s.distance))).alias("x")).select("x.mask", "fp", F.lit(0).alias("nth"), "x.key", F.lit(0).alias("t")).distinct()


def near_duplicates(documents: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents(doc_id, text) -> (doc_id, fp, component_id)."""
    small_batches(documents.sparkSession)
    prints = written(with_fingerprints(documents, s.width), "fingerprints")
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "different")
    groups = components(links(first.select("fp"), s))
    rooted = first.join(groups, first["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents: 3-word shingles, links at 2 or fewer bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# near-duplicates by a similarity of shingles


@dataclass(frozen=True)
class Similar:
    width: int = 5
    similarity: float = 0.8
    distance: int = 3  # differing bits of the fingerprints that the first search links
    bucket: int = 1024  # texts of a bucket that are compared inside one row
    leaders: int = 4  # members of a large bucket that all others are compared with before its pairs
    sample: int = 16  # one text in so many is looked at for the order of the shingles
    frequent: int = 1 << 18  # shingles at most that the order puts last
    group: int = 1 << 20  # shingles about that are sorted in one piece


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Different shingles' hashes, sorted."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, stops, strict=True)], np.uint64)).view(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits of the SHA-256 of a shingle set."""
    return int.from_bytes(hashlib.sha256(shingles.tobytes()).digest()[:8], "big", signed=True)


def set_print(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set: bits that are set in over half of its hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 14):
        ones += np.unpackbits(shingles[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big", signed=True)


def parities(shingles: np.ndarray, bits: int = 1024) -> bytes:
    """For each of `bits` cells whether an odd number of shingles falls into it: sets differ in at least as many shingles as in cells."""
    cell = (shingles.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits) & 1).tobytes()


def frequent_of(shingles: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of a set's shingles are among the frequent ones, and these by their count and hash."""
    token, count = often
    if not len(token):
        return np.zeros(len(shingles), bool), shingles[:0]
    place = np.minimum(np.searchsorted(token, shingles), len(token) - 1)
    is_one = token[place] == shingles
    return is_one, shingles[is_one][np.argsort(count[place[is_one]], kind="stable")]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of a few rows at a time."""
    for batch in batches:
        for i, j, offsets, data in text_slices(batch.column("text")):
            whole = data.tobytes()
            yield batch.column("doc_id").slice(i, j - i), [shingle_set(whole[offsets[k] : offsets[k + 1]], width) for k in range(j - i)]


def frequent_shingles(texts: DataFrame, s: Similar) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted, and their counts. They decide how fast the search is, not what it finds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, s.width):
            token, count = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], names=["token", "n"])

    some = texts.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(s.sample)) == 0)
    count = written(some.mapInArrow(frugal(task), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4"), "frequent")
    least, total = 4, 0
    for n, tokens in count.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += tokens
        if total > s.frequent:
            least = n + 1
            break
    rows = count.where(F.col("n") >= least).orderBy("token").toArrow()
    return rows.column("token").to_numpy(), rows.column("n").to_numpy()


def shared_shingles(texts: DataFrame, often: Broadcast, s: Similar, parts: int) -> DataFrame:
    """(node, key, df): the shingles, frequent ones left out, that more than one set holds, with the number of these sets.

    Shingles are dealt by hash into `parts` groups, a row a group and some texts, and each group is sorted in one piece.
    No shingle makes a group large, as those that many sets hold are left out; the others that a set has alone stay there.
    """

    def dealt(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, node = np.concatenate(sets), np.repeat(np.array([set_key(x) for x in sets], np.int64), [len(x) for x in sets])
        rare = ~frequent_of(token, often.value)[0]
        token, node = token[rare], node[rare]
        part = (token.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, token, node = part[order], token[order], node[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*at[1:].tolist(), len(part)]
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)] if len(at) else [], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[at]), cut(token), cut(node)], names=["part", "token", "node"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, sets in _sets(batches, s.width):
            held += sets
            size += sum(map(len, sets))
            if size >= 1 << 19:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def met(group: pa.Table) -> pa.Table:
        token, node = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("token", "node"))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # equal sets are one
        token, node = token[new], node[new]
        df = np.diff(np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)))
        df = np.repeat(df, df)
        return pa.table({"node": node[df > 1], "key": token[df > 1], "df": df[df > 1].astype(np.int32)})

    return texts.mapInArrow(frugal(task), "part int, token binary, node binary").groupBy("part").applyInArrow(frugal_group(met), "node long, key long, df int")


def prefixes(first: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(node, n, i, key): first shingles of each set of first(node, n, n_frequent, frequent) in one global order, and their places.

    A set of n has at least similarity * n in common with one as similar, so the two share one of its n - ceil(similarity * n) + 1
    first ones. The order is by the number of sets (those of a single set first, which nothing can share, so that they are
    only counted), then by hash; frequent ones come last, by their count in the sample.
    """
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    both = first.join(own, "node", "left").withColumn("own", F.coalesce(F.col("own.key"), F.array().cast("array<long>")))
    both = both.withColumn("alone", F.col("n") - F.col("n_frequent") - F.size("own"))
    both = both.withColumn("left", (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - F.col("alone")).cast("int"))
    some = lambda c, size: F.slice(c, F.lit(1), F.greatest(size, F.lit(0)))
    keys = F.concat(some("own", F.col("left")), some("frequent", F.col("left") - F.size("own")))
    return both.where("left > 0").select("node", "n", "alone", F.posexplode(keys).alias("at", "key")).select("node", "n", (F.col("alone") + F.col("at")).alias("i"), "key")


def _may_be(n: str, i: str, m: str, j: str, similarity: float) -> F.Column:
    """Whether sets of n and m shingles whose first common one is at places i and j (from 0) can be as similar."""
    a, b = F.col(n), F.col(m)
    need = F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9
    return (F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9) & (F.least(a - F.col(i), b - F.col(j)) >= need)


def _may_still_be(pairs: DataFrame, first: DataFrame, s: Similar) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sizes and parities do not rule the similarity out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "m"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(n), -1) for c in ("x", "y"))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            may = (np.minimum(n, m) >= s.similarity * np.maximum(n, m) - 1e-9) & (differ <= (n + m) * (1 - s.similarity) / (1 + s.similarity) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(may)) for c in ("a", "b")], names=["a", "b"])

    of = lambda node, n, x: first.select(F.col("node").alias(node), F.col("n").alias(n), F.col("parities").alias(x))
    both = pairs.distinct().join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b")
    return written(both.select("a", "b", "n", "m", "x", "y").mapInArrow(frugal(task), "a long, b long"), "pairs")


def _verified(pairs: DataFrame, own: DataFrame, first: DataFrame, s: Similar) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, s.width):
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    pairs = _may_still_be(pairs, first, s)
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = first.select("doc_id", "node").join(met, "node", "left_semi").select("doc_id").distinct()
    sets = written(joined(own, ids, "doc_id", "left_semi").mapInArrow(frugal(to_sets), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("shared"))
    near = written(shared.where(F.col("shared") >= F.lit(s.similarity) * (F.col("n") + F.col("m") - F.col("shared")) - 1e-9).select("a", "b"), "similar")
    forget(pairs, sets)
    return near


def block_pairs(members: pa.ListArray, same_block: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of members of each bucket with different roots that can be as similar; of members of one block or of two."""
    flat = members.flatten()
    node, n, i, root, block = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "i", "root", "block"))
    odd = np.frombuffer(b"".join(flat.field("parities").to_pylist()), np.uint64).reshape(len(node), -1) if len(node) else np.zeros((0, 16), np.uint64)
    size = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size

    def may_be(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, y = n[p].astype(float), n[q].astype(float)
        may = (root[p] != root[q]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
        may &= np.minimum(x - i[p], y - i[q]) >= similarity / (1 + similarity) * (x + y) - 1e-9
        p, q = p[may], q[may]
        may = np.ones(len(p), bool)
        for k in range(0, len(p), 1 << 15):
            x, y = p[k : k + (1 << 15)], q[k : k + (1 << 15)]
            differ = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64)
            may[k : k + (1 << 15)] = differ <= (n[x] + n[y]) * (1 - similarity) / (1 + similarity) + 1e-9
        x, y = node[p[may]], node[q[may]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)

    for m in np.unique(size[same_block & (size > 1)]):
        x, y = np.triu_indices(m, 1)
        at = start[same_block & (size == m)]
        step = max(1, (1 << 20) // len(x))
        for k in range(0, len(at), step):
            yield may_be((at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel())
    for at, m in zip(start[~same_block], size[~same_block], strict=True):
        own = block[at : at + m]
        x, y = at + np.flatnonzero(own == own.min()), at + np.flatnonzero(own != own.min())
        yield may_be(np.repeat(x, len(y)), np.tile(y, len(x)))


def _bucket_pairs(buckets: DataFrame, s: Similar) -> DataFrame:
    """buckets(key, node, n, i, root, parities) -> pairs (a, b) of every bucket's members that have different roots and can be as similar.

    A bucket with more than `bucket` members is cut into blocks, and each two blocks make a row, so that every pair is
    compared and no row grows with the bucket.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("lo").to_numpy() == batch.column("hi").to_numpy()
            for k in range(0, batch.num_rows, 64):
                pairs = np.concatenate([np.zeros((0, 2), np.int64), *block_pairs(batch.column("members").slice(k, 64), same[k : k + 64], s.similarity)])
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    size = buckets.groupBy("key").agg(F.ceil(F.count("*") / s.bucket).cast("int").alias("blocks"))
    dealt = buckets.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.struct("node", "n", "i", "root", "block", "parities").alias("m"))
    return to.groupBy("key", "lo", "hi").agg(F.collect_list("m").alias("members")).select("lo", "hi", "members").mapInArrow(frugal(task), "a long, b long").distinct()


def _live(places: DataFrame) -> DataFrame:
    """places(key, node, n, i, root) of the buckets whose members have more than one root."""
    live = places.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return written(places.join(live, "key"), "buckets")


def _rooted(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    return nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar(documents: DataFrame, s: Similar = Similar()) -> DataFrame:  # noqa: B008
    """documents(doc_id, text) -> (doc_id, component_id): near copies by the Jaccard similarity of their shingle sets, all of them.

    Texts with equal shingle sets are one (told apart by 64 bits of the sets' SHA-256). SimHash finds most near copies:
    fingerprints of the sets link at `distance` or fewer differing bits (the search above), and whole sets verify the
    links. The fingerprints of a similar pair can lie further apart, so a second search looks for the pairs that these
    links have not joined: a set of n shingles goes to the buckets of its n - ceil(similarity * n) + 1 first ones in one
    global order, by the number of sets that hold them, all counted; two sets of the similarity always share one of these. One member of each bucket, or
    several ones after each other if buckets stay large, is compared with the others first, so that a group of copies gets
    one root; then members with different roots are compared pair by pair, in buckets of any size. Pairs are left
    out only if their sizes, the place of their common shingle or the parities of their cells rule the similarity out.
    Null text counts as empty; ids that are null make no group.
    """
    small_batches(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    often = documents.sparkSession.sparkContext.broadcast(frequent_shingles(own, s))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, s.width):
            usual = [frequent_of(x, often.value)[1] for x in sets]
            some = [x[: len(y) - math.ceil(s.similarity * len(y) - 1e-9) + 1] for x, y in zip(usual, sets, strict=True)]
            ends = np.cumsum([0, *map(len, some)], dtype=np.int32)
            node, fp = (pa.array([f(x) for x in sets], pa.int64()) for f in (set_key, set_print))
            columns = {"doc_id": ids, "node": node, "fp": fp, "n": pa.array([len(x) for x in sets], pa.int32()), "parities": pa.array([parities(x) for x in sets], pa.binary()), "n_frequent": pa.array([len(x) for x in usual], pa.int32()), "frequent": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some)))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    prints = written(own.mapInArrow(frugal(task), "doc_id long, node long, fp long, n int, parities binary, n_frequent int, frequent array<long>"), "prints")
    first = written(prints.groupBy("node").agg(F.min(F.struct("doc_id", "fp", "n", "parities")).alias("f")).select("node", "f.*"), "texts")

    least = first.groupBy("fp").agg(F.min("node").alias("least"))
    linked = links(least.select("fp"), Settings(width=s.width, distance=s.distance))
    of = lambda fp, node: least.select(F.col("fp").alias(fp), F.col("least").alias(node))
    equal = first.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = linked.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(_verified(equal.union(near), own, first, s))

    # one text of each set (repeated rows come back repeatedly, which only repeats a pair)
    chosen = prints.join(first.select("doc_id", "node"), ["doc_id", "node"], "left_semi").select("node", "n", "n_frequent", "frequent").dropDuplicates(["node"])
    parts = max(1, (prints.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // s.group)
    places = written(prefixes(chosen, shared_shingles(own, often, s, parts), s.similarity), "places")
    shared = places.select("key").groupBy("key").count().where("count > 1").select("key")
    buckets = written(_rooted(places.join(shared, "key"), groups).select("key", "node", "n", "i", "root"), "buckets")
    forget(places)
    as_links = lambda found: groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)
    for nth in range(s.leaders):
        leader = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(nth)), "node", "n", "i", "root")).alias("l")).select("key", F.col("l.node").alias("a"), F.col("l.n").alias("m"), F.col("l.i").alias("j"), F.col("l.root").alias("other"))
        led = buckets.join(leader, "key").where("root <> other").where(_may_be("n", "i", "m", "j", s.similarity))
        groups = components(as_links(_verified(led.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")), own, first, s)))
        last, buckets = buckets, _live(_rooted(buckets.drop("root"), groups))
        forget(last)
        size = buckets.groupBy("key").count().agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).first()
        if (size["pairs"] or 0) <= 16 * (size["n"] or 0):
            break
    more = _verified(_bucket_pairs(buckets.join(first.select("node", "parities"), "node"), s), own, first, s)
    forget(buckets)
    groups = groups if more.isEmpty() else components(as_links(more))
    named = _rooted(first.select("node", "doc_id"), groups)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
