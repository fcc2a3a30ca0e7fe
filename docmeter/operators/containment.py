"""Which of many texts hold which of many needles, without comparing all pairs.

Each needle stands for one of its substrings, its anchor: the first of its GRAM-byte substrings with the least hash, or all
of a shorter needle. A text is read once: rolling hashes of its bytes are looked up among the anchors' hashes, sorted, and
at each place that meets one the needle's bytes are compared in full. Needles of other scopes are passed over at the hit.

Few needles (counted bytes, at most BYTES at once) are broadcast, so texts are not shuffled. More needles meet texts by a
join on scope and anchor instead: a text gives each substring that has the least hash among WINDOW neighbours, which every
needle of at least GRAM + WINDOW - 1 bytes shares with any text that holds it; shorter needles stay in broadcast parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 8, 8
BYTES = 32_000_000
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)], np.uint64)
_NUMERIC = frozenset(b"0123456789.")


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from every place."""
    n = max(0, len(data) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += (data[k : k + n].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor(needle: bytes) -> tuple[int, int, int]:
    """Size, place and hash of the substring that a needle is found by."""
    size = min(GRAM, len(needle))
    h = gram_hashes(np.frombuffer(needle, np.uint8), size)
    at = int(h.argmin())
    return size, at, int(h[at])


def minimizers(data: np.ndarray) -> np.ndarray:
    """Different hashes that are least among WINDOW neighbours somewhere."""
    h = gram_hashes(data, GRAM)
    if len(h) < WINDOW:
        return np.unique(h.min(keepdims=True)) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def edges_fit(text: bytes, at: int, needle: bytes) -> bool:
    """a needle whose edge is a digit or a dot touches no further one."""
    end = at + len(needle)
    return not (needle[0] in _NUMERIC and at and text[at - 1] in _NUMERIC) and not (needle[-1] in _NUMERIC and end < len(text) and text[end] in _NUMERIC)


def _same(x: object, y: object) -> bool:
    return x is None or x == y


def held_needles(needles: DataFrame, texts: DataFrame, scope: tuple[str, ...] = (), numeric_edges: bool = False, limit: int = BYTES) -> DataFrame:
    """needles(needle_id, needle, scope...) in texts(text_id, text, scope...) -> (needle_id, text_id), each once.

    A null scope value of a needle fits every text. Empty and null needles are in no text. `numeric_edges` asks for F3.
    """
    wanted = needles.where(F.coalesce("needle", F.lit("")) != "").select("needle_id", F.encode("needle", "utf-8").alias("needle"), *scope).distinct()
    size = F.octet_length("needle")
    anywhere = F.exists(F.array(F.lit(False), *(F.col(c).isNull() for c in scope)), lambda x: x)
    total, short, unscoped = wanted.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(size < GRAM + WINDOW - 1, size)), F.lit(0)), F.count_if(anywhere)).first()
    if total <= limit or unscoped:
        return _by_broadcast(wanted, texts, scope, numeric_edges, max(1, -(-total // limit)))
    few = _by_broadcast(wanted.where(size < GRAM + WINDOW - 1), texts, scope, numeric_edges, max(1, -(-short // limit)))
    return few.unionByName(_by_join(wanted.where(size >= GRAM + WINDOW - 1), texts, scope, numeric_edges))


def _kinds(needles: DataFrame, texts: DataFrame) -> str:
    return f"needle_id {needles.schema['needle_id'].dataType.simpleString()}, text_id {texts.schema['text_id'].dataType.simpleString()}"


def _by_broadcast(needles: DataFrame, texts: DataFrame, scope: tuple[str, ...], numeric_edges: bool, parts: int) -> DataFrame:
    """Needles in `parts` parts, each a pass over the texts."""
    out = None
    for part in range(parts):
        rows = needles.where(F.pmod(F.xxhash64("needle_id"), F.lit(parts)) == part).toArrow() if parts > 1 else needles.toArrow()
        held = needles.sparkSession.sparkContext.broadcast(_table(rows, scope))
        found = texts.select("text_id", "text", *scope).mapInArrow(_scan(held, scope, numeric_edges), _kinds(needles, texts))
        out = found if out is None else out.unionAll(found)
    return out


def _table(rows: pa.Table, scope: tuple[str, ...]) -> tuple:
    """Needles, and by anchor size the sorted hashes with each one's place in the needle and number."""
    needles = rows.column("needle").to_pylist()
    found: dict[int, list] = {}
    for k, needle in enumerate(needles):
        size, at, h = anchor(needle)
        found.setdefault(size, []).append((h, at, k))
    tables = {}
    for size, entries in found.items():
        entries.sort()
        tables[size] = np.array([e[0] for e in entries], np.uint64), [e[1] for e in entries], [e[2] for e in entries]
    return rows.column("needle_id").combine_chunks(), needles, list(zip(*(rows.column(c).to_pylist() for c in scope), strict=True)) if scope else [()] * len(needles), tables


def _scan(held: Broadcast, scope: tuple[str, ...], numeric_edges: bool):  # noqa: ANN202
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, needles, scopes, tables = held.value
        for batch in batches:
            hits: list[tuple[int, int]] = []
            mine = list(zip(*(batch.column(c).to_pylist() for c in scope), strict=True)) if scope else [()] * len(batch)
            for row, value in enumerate(batch.column("text")):
                raw = (value.as_py() or "").encode()
                data, done = np.frombuffer(raw, np.uint8), set()
                for size, (hashes, places, numbers) in tables.items():
                    h = gram_hashes(data, size)
                    first = np.searchsorted(hashes, h)
                    met = np.flatnonzero((first < len(hashes)) & (hashes[np.minimum(first, len(hashes) - 1)] == h))
                    for at in met.tolist():
                        e = int(first[at])
                        while e < len(hashes) and hashes[e] == h[at]:  # needles with the same anchor
                            k, begin = numbers[e], at - places[e]
                            if k not in done and begin >= 0 and raw.startswith(needles[k], begin) and all(map(_same, scopes[k], mine[row])) and (not numeric_edges or edges_fit(raw, begin, needles[k])):
                                done.add(k)
                            e += 1
                hits += [(k, row) for k in sorted(done)]
            if hits:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([h[0] for h in hits])), batch.column("text_id").take(pa.array([h[1] for h in hits]))], names=["needle_id", "text_id"])

    return task


def _by_join(needles: DataFrame, texts: DataFrame, scope: tuple[str, ...], numeric_edges: bool) -> DataFrame:
    """Needles meet texts by scope and anchor; the pairs that meet are compared."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the least hash of the first window: a text that holds the needle has it as a minimizer too
            h = [int(gram_hashes(np.frombuffer(x[: GRAM + WINDOW - 1], np.uint8), GRAM).min()) for x in batch.column("needle").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(h, np.uint64).view(np.int64))], names=[*batch.schema.names, "anchor"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [minimizers(np.frombuffer((x or "").encode(), np.uint8)) for x in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(batch)), [len(m) for m in each])
            found = np.concatenate(each) if each else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("text_id", *scope)), pa.array(found.view(np.int64))], names=["text_id", *scope, "anchor"])

    kinds = {c: needles.schema[c].dataType.simpleString() for c in scope}
    scoped = "".join(f", {c} {k}" for c, k in kinds.items())
    n = needles.mapInArrow(anchors, f"needle_id {needles.schema['needle_id'].dataType.simpleString()}, needle binary{scoped}, anchor long")
    t = texts.select("text_id", "text", *(F.col(c).cast(k).alias(c) for c, k in kinds.items())).mapInArrow(marks, f"text_id {texts.schema['text_id'].dataType.simpleString()}{scoped}, anchor long")
    met = t.join(n, [*scope, "anchor"]).select("text_id", "needle_id", "needle").distinct()
    both = met.join(texts.select("text_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw")), "text_id")
    found = both.where(F.contains("raw", F.col("needle")))
    if numeric_edges:

        @F.pandas_udf("boolean")
        def fits(raw, needle):  # noqa: ANN001, ANN202
            import pandas as pd

            def one(t: bytes, x: bytes) -> bool:
                at = t.find(x)
                while at >= 0:
                    if edges_fit(t, at, x):
                        return True
                    at = t.find(x, at + 1)
                return False

            return pd.Series([one(bytes(t), bytes(x)) for t, x in zip(raw, needle, strict=True)], dtype=bool)

        found = found.where(fits("raw", "needle"))
    return found.select("needle_id", "text_id").distinct()
