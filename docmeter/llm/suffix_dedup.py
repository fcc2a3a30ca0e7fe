"""Repeated passages, byte for byte, by a distributed merge sort of sampled suffixes.

A byte of a document goes if a string of `length` bytes covers it that also starts in a document with a smaller id.

Sampled suffixes. Of the `length - gram + 1` grams in each window of `length` bytes, the one with the least hash (the
leftmost of equal ones) is the window's anchor. Equal windows have their anchor at the same place, so it is enough to
sort the suffixes that start at anchors, about one in (length - gram) / 2. All windows of one anchor are one entry: the
suffix from the anchor and the bytes before it, as far as those windows reach.

1. Documents are packed into blocks of about `block_bytes`. Each block sends the hashes of its anchors' grams, sorted
   and delta-coded, by hash range; the ranges tell each block which grams also occur in another document.
2. Each block sorts the suffixes of those entries (equal entries once, with the block's least id), front-codes the run
   and sends it by key range; sampled splitters divide the ranges. A range combines the blocks' runs with a loser tree
   that keeps, for each run's head, the prefix it is known to share with the last output: heads with different known
   prefixes are never compared, others only from that prefix on. Neighbours in the merged order give the groups of one
   gram; a group of equal entries has its least id at once, others are resolved window by window.
   Entries of a gram that is very frequent are dealt out by their windows' hashes instead, so no range has to hold a
   frequent gram's whole group.
3. Each block gets a bit for every window of its entries that occurs under a smaller id, and removes what they cover.

Whole texts, any length; results are exact but for collisions of 64-bit hashes. Null text counts as empty. Documents
with the same id do not remove from each other. A null id counts as larger than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import Substrings, frugal, frugal_group, frugal_pair, mixed, text_slices
from docmeter.llm.shared import small_batches, table, without, written

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    length: int = 50
    gram: int = 24
    block_bytes: int = 2 << 20
    range_bytes: int = 16 << 20
    frequent: int = 2000


def pack(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True) if size else b"", kind)


# blocks


def to_blocks(documents: DataFrame, s: Settings) -> DataFrame:
    """Rows of (block, n_bytes, docs): documents as compressed Arrow, about s.block_bytes of text each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([nth]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "docs"])

        for batch in batches:
            for i, j, _, data in text_slices(batch.column("text"), s.block_bytes):
                if held and size + len(data) > s.block_bytes:
                    yield out()
                    nth, held, size = nth + 1, [], 0
                held.append(batch.slice(i, j - i))
                size += len(data)
        if held:
            yield out()

    return written(documents.mapInArrow(frugal(task), "block long, n_bytes long, docs binary"), "blocks")


def from_block(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all().combine_chunks()


def loose(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column with nullable fields inside its structs, as Spark declares what comes back."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_struct(column.type):
        return column
    parts = [loose(part) for part in column.flatten()]
    return pa.StructArray.from_arrays(parts, fields=[pa.field(f.name, p.type) for f, p in zip(column.type, parts, strict=True)], mask=column.is_null())


# anchors and entries


def least_gram(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes, the place of the least by its upper 32 bits (the leftmost of equal ones)."""
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        key = np.minimum(key[: len(key) - step], key[step:])
        span += step
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def entries(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Of one slice: anchor, first and last window start, text number, gram hash and class hash of each entry."""
    none = np.zeros(0, np.int64)
    if len(data) < s.length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Substrings(data)
    last = len(data) - s.gram + 1
    grams = mixed((hashes.sums[s.gram :] - hashes.sums[:last]) * hashes.back[:last])
    place = least_gram(grams, s.length - s.gram + 1)
    whole = np.ones(len(place), bool)
    for end in offsets[1:].tolist():  # windows that would cross into the next text
        whole[max(0, end - s.length + 1) : end] = False
    new = np.append(True, place[1:] != place[:-1])
    new[1:] |= ~whole[:-1]
    lo = np.flatnonzero(new & whole)
    if not len(lo):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ends = new.copy()
    ends[:-1] = new[1:]
    ends[:-1] |= ~whole[1:]
    ends[-1] = True
    hi = np.flatnonzero(ends & whole)
    anchor = place[lo]
    return anchor, lo, hi, np.searchsorted(offsets, lo, side="right") - 1, grams[anchor], hashes(lo, hi + s.length)


def block_entries(docs: pa.Table, s: Settings) -> tuple[np.ndarray, ...]:
    """Of a whole block: text start, anchor, lo, hi (from the block's first byte), id, gram hash and class hash."""
    column = docs.column("text").chunk(0) if docs.num_rows else pa.array([], pa.string())
    ids = docs.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
    parts, base = [], 0
    for i, _, offsets, data in text_slices(column, 1 << 19):
        a, lo, hi, text, gram, kind = entries(data, offsets, s)
        parts.append((a + base, lo + base, hi + base, ids[i + text], gram, kind))
        base += len(data)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)


def all_bytes(docs: pa.Table) -> np.ndarray:
    return np.concatenate([data for _, _, _, data in text_slices(docs.column("text").chunk(0), 1 << 23)] or [np.zeros(0, np.uint8)]) if docs.num_rows else np.zeros(0, np.uint8)


def classes(kind: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each class, each entry's class, and each class's least id."""
    _, first, which = np.unique(kind, return_index=True, return_inverse=True)
    least = np.full(len(first), LAST)
    np.minimum.at(least, which, ids)
    return first, which, least


def _short(gram: np.ndarray) -> np.ndarray:
    return mixed(gram) >> np.uint64(24)  # least hashes are small ones: mixed again, they spread evenly. 40 bits; a collision only keeps an entry longer


# 1. which grams occur in two documents


def gram_runs(blocks: DataFrame, ranges: int, s: Settings) -> DataFrame:
    """(range, block, hashes, counts, sample): a block's different gram hashes in a range, and how many classes each has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block"), batch.column("docs"), strict=True):
                docs = from_block(docs.as_py())
                a, _, _, ids, gram, kind = block_entries(docs, s)
                if not len(a):
                    continue
                first, _, least = classes(kind, ids)
                most = np.zeros(len(first), np.int64)
                np.maximum.at(most, np.unique(kind, return_inverse=True)[1], ids)
                short, which, count = np.unique(_short(gram[first]), return_inverse=True, return_counts=True)
                low, high = np.full(len(short), LAST), np.full(len(short), -LAST - 1)
                np.minimum.at(low, which, least)
                np.maximum.at(high, which, most)
                # lowest bit: in two documents of this block
                figure = (np.minimum(count, 32767).astype(np.uint16) << np.uint16(1)) | (low < high).astype(np.uint16)
                part = ((short * np.uint64(ranges)) >> np.uint64(40)).astype(np.int64)
                data = all_bytes(docs)
                some = a[np.random.RandomState(block.as_py() & 0xFFFFFFFF).randint(0, len(a), 32)]
                sample = b"".join(data[x : x + s.gram].tobytes() for x in some)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                end = np.append(cut[1:], len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.array([block.as_py()] * len(cut), pa.int64()), pa.array([pack(np.diff(short[i:j], prepend=short[i : i + 1] * 0)) for i, j in zip(cut, end, strict=True)], pa.binary()), pa.array([pack(figure[i:j]) for i, j in zip(cut, end, strict=True)], pa.binary()), pa.array([sample if k == 0 else None for k in range(len(cut))], pa.binary())],
                    names=["range", "block", "hashes", "counts", "sample"],
                )

    return blocks.select("block", "docs").mapInArrow(frugal(task), "range long, block long, hashes binary, counts binary, sample binary")


def shared_grams(runs: DataFrame, s: Settings) -> DataFrame:
    """(block, range, hashes): of each block's grams those that occur in another document; the lowest bit: very frequent."""

    def task(group: pa.Table) -> pa.Table:
        hashes = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("hashes")]
        figures = np.concatenate([unpack(x.as_py(), np.uint16) for x in group.column("counts")])
        owner = np.repeat(np.arange(len(hashes)), list(map(len, hashes)))
        short = np.concatenate(hashes)
        _, which, blocks_ = np.unique(short, return_inverse=True, return_counts=True)
        both = np.bincount(which, figures & 1) > 0
        often = np.bincount(which, figures >> 1) > s.frequent
        kept = ((blocks_ > 1) | both)[which]
        value = (short << np.uint64(1)) | often[which].astype(np.uint64)
        return pa.table({"block": group.column("block"), "hashes": pa.array([pack(np.diff(value[(owner == k) & kept], prepend=np.uint64(0))) for k in range(len(hashes))], pa.binary())})

    return runs.select("range", "block", "hashes", "counts").groupBy("range").applyInArrow(frugal_group(task), "block long, hashes binary")


def splitters(runs: DataFrame, ranges: int, s: Settings, most: int = 4096) -> list[bytes]:
    """Grams that divide the sorted suffixes evenly, from a sample of at most 32 * most of them."""
    rows = runs.where("sample is not null").orderBy(F.xxhash64("block")).select("sample").limit(most).collect()
    grams = sorted(r["sample"][k : k + s.gram] for r in rows for k in range(0, len(r["sample"]), s.gram))
    return sorted({bytes(grams[len(grams) * k // ranges]) for k in range(1, ranges)}) if grams else []


# 2. sorted runs and their merge


def front_code(suffixes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix with the one before, and the remaining bytes, of sorted zero-padded suffixes."""
    shared = np.zeros(len(suffixes), np.uint8)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), suffixes.shape[1])  # padding counts
    tail = (np.arange(suffixes.shape[1]) >= shared[:, None]) & (np.arange(suffixes.shape[1]) < sizes[:, None])
    return shared, suffixes[tail].tobytes()


def front_decode(shared: np.ndarray, sizes: np.ndarray, tails: bytes, width: int) -> list[int]:
    out, last, at = [], b"", 0
    for known, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        end = at + max(0, size - known)
        last = (last[:known] + tails[at:end]).ljust(width, b"\0")
        at = end
        out.append(int.from_bytes(last, "big"))
    return out


def merge(runs: list[list[int]], shared: list[list[int]], width: int) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, bytes shared with the output before) in sorted order, by a loser tree.

    known[r] is how many bytes run r's head shares with the last output. Of two heads the one with more known bytes is
    the smaller; only if both have as many are they compared, and the loser then knows what it shares with the winner.
    """
    n = 1
    while n < len(runs):
        n *= 2
    over = 1 << (8 * width)  # larger than every suffix
    head = [r[0] if r else over for r in runs] + [over] * (n - len(runs))
    at, known, lost = [0] * n, [0] * n, [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = head[a], head[b]
        if x < y or (x == y and a < b):
            a, b = b, a
            x, y = y, x
        # a lost against b
        if x < over:
            known[a] = width - (((x ^ y).bit_length() + 7) >> 3)
        return b, a

    win = list(range(n))
    size = n
    while size > 1:
        size //= 2
        nxt = []
        for k in range(size):
            w, loser = play(win[2 * k], win[2 * k + 1])
            lost[size + k] = loser
            nxt.append(w)
        win = nxt
    w = win[0]
    first = True
    while head[w] < over:
        yield w, at[w], 0 if first else known[w]
        first = False
        at[w] += 1
        if at[w] < len(runs[w]):
            head[w] = runs[w][at[w]]
            known[w] = shared[w][at[w]]
        else:
            head[w], known[w] = over, -1
        k = (n + w) >> 1
        while k:
            o = lost[k]
            if known[o] > known[w]:
                lost[k], w = w, o
            elif known[o] == known[w]:
                w, lost[k] = play(w, o)
            k >>= 1


def suffix_runs(blocks: DataFrame, grams: DataFrame, cuts: list[bytes], ranges: int, s: Settings) -> DataFrame:
    """(kind, range, block, body): kind 0 a front-coded run of sorted suffixes, kind 1 windows of frequent grams by hash."""
    reach = s.length - s.gram
    bounds = np.array(cuts, f"S{s.gram}") if cuts else np.zeros(0, f"S{s.gram}")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            block, docs = left.column("block")[0].as_py(), from_block(left.column("docs")[0].as_py())
            value = np.sort(np.concatenate([np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in right.column("hashes")]))
            a, lo, hi, ids, gram, kind = block_entries(docs, s)
            first, _, least = classes(kind, ids)
            found = np.searchsorted(value, _short(gram[first]) << np.uint64(1))
            near = value[np.minimum(found, len(value) - 1)] if len(value) else np.zeros(len(first), np.uint64)
            kept = (near >> np.uint64(1)) == _short(gram[first]) if len(value) else np.zeros(len(first), bool)
            data = np.append(all_bytes(docs), np.zeros(s.length + reach, np.uint8))
            often = kept & ((near & np.uint64(1)) > 0)
            out += _runs(block, data, np.flatnonzero(kept & ~often), a[first], lo[first], hi[first], least)
            out += _windows(block, data, np.flatnonzero(often), lo[first], hi[first], least)
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "range", "block", "body"])

    def _runs(block: int, data: np.ndarray, c: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> list[tuple]:
        a, lo, hi = a[c], lo[c], hi[c]
        sizes = (hi + s.length - a).astype(np.uint8)
        suffix = data[a[:, None] + np.arange(s.length)]
        suffix[np.arange(s.length) >= sizes[:, None]] = 0
        text = np.ascontiguousarray(suffix).view(f"S{s.length}").ravel()
        order = np.argsort(text, kind="stable")
        suffix, sizes, c, a, lo = suffix[order], sizes[order], c[order], a[order], lo[order]
        part = np.searchsorted(bounds, np.ascontiguousarray(suffix[:, : s.gram]).view(f"S{s.gram}").ravel(), side="right")
        rows = []
        for p in np.unique(part):
            i, j = np.searchsorted(part, [p, p + 1])
            shared, tails = front_code(suffix[i:j], sizes[i:j])
            before = (a[i:j] - lo[i:j]).astype(np.uint8)
            # the bytes before the anchor, right-aligned
            left = data[np.maximum(a[i:j, None] - reach + np.arange(reach), 0)][np.arange(reach) >= reach - before[:, None]]
            rows.append((0, int(p), block, _joined(c[i:j].astype(np.uint32), least[c[i:j]], shared, sizes[i:j], before, np.frombuffer(tails, np.uint8), left)))
        return rows

    def _windows(block: int, data: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> list[tuple]:
        if not len(c):
            return []
        n = (hi - lo)[c] + 1
        owner = np.repeat(c, n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        h = np.zeros(len(owner), np.uint64)
        for k in range(s.length):
            h = (h ^ (data[lo[owner] + nth + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x100000001B3)
        h = mixed(h)
        part = ((h >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(40)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows = []
        for p in np.unique(part):
            i, j = np.searchsorted(part[order], [p, p + 1])
            some = order[i:j]
            rows.append((1, int(p), block, _joined(h[some], least[owner[some]], owner[some].astype(np.uint32), nth[some].astype(np.uint8))))
        return rows

    schema = "kind int, range long, block long, body binary"
    return blocks.select("block", "docs").groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(frugal_pair(task), schema)


def _joined(*arrays: np.ndarray) -> bytes:
    parts = [pack(x) for x in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(body: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(unpack(body[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


def least_of(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each key the least id that any equal key has."""
    _, which = np.unique(key, return_inverse=True)
    least = np.full(int(which.max()) + 1 if len(which) else 0, LAST)
    np.minimum.at(least, which, ids)
    return least[which]


def merged_masks(runs: list[list[np.ndarray]], s: Settings) -> list[np.ndarray]:
    """For each run's entries, bits of the windows that occur under a smaller id."""
    reach = s.length - s.gram
    decoded = [front_decode(r[2], r[3], r[5].tobytes(), s.length) for r in runs]
    base = np.cumsum([0, *map(len, decoded)])
    order, shared = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
    for k, (run, at, known) in enumerate(merge(decoded, [r[2].tolist() for r in runs], s.length)):
        order[k], shared[k] = base[run] + at, known
    group = np.cumsum(shared < s.gram)
    ids, sizes, before = (np.concatenate([r[k] for r in runs])[order] for k in (1, 3, 4))
    text = np.zeros((base[-1], reach + s.length), np.uint8)
    tails = np.concatenate([r[6] for r in runs])
    column = np.arange(reach)
    unsorted_before = np.concatenate([r[4] for r in runs])
    left = np.zeros((base[-1], reach), np.uint8)
    left[column >= reach - unsorted_before[:, None]] = tails
    text[:, :reach] = left[order]
    whole = np.frombuffer(b"".join(x.to_bytes(s.length, "big") for r in decoded for x in r), np.uint8).reshape(-1, s.length)
    text[:, reach:] = whole[order]
    # entries that are alike in all their bytes
    power = np.multiply.accumulate(np.full(text.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    kind = np.zeros(base[-1], np.uint64)
    for k in range(text.shape[1]):
        kind += (text[:, k].astype(np.uint64) + np.uint64(1)) * power[k]
    kind = mixed(kind ^ (before.astype(np.uint64) << np.uint64(8)) ^ sizes.astype(np.uint64))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    alike = np.minimum.reduceat(kind, start) == np.maximum.reduceat(kind, start) if len(start) else np.zeros(0, bool)
    size = np.diff(np.append(start, len(group)))
    least = np.repeat(np.minimum.reduceat(ids, start), size) if len(start) else ids
    windows = before.astype(np.int64) + sizes - s.length + 1
    mask = np.where(np.repeat(alike, size) & (least < ids), (1 << windows) - 1, 0)
    bounds, ends = start[~alike], (start + size)[~alike]
    k = 0  # some groups at a time, none cut
    while k < len(bounds):
        e = max(k + 1, int(np.searchsorted(np.cumsum(ends[k:] - bounds[k:]), 50_000, side="right")) + k)
        some = np.concatenate([np.arange(i, j) for i, j in zip(bounds[k:e], ends[k:e], strict=True)])
        mask[some] = _by_window(text[some], reach - before[some].astype(np.int64), windows[some], ids[some], s)
        k = e
    out = np.zeros(base[-1], np.uint32)
    out[order] = mask
    return [out[base[i] : base[i + 1]] for i in range(len(runs))]


def _by_window(text: np.ndarray, first: np.ndarray, windows: np.ndarray, ids: np.ndarray, s: Settings) -> np.ndarray:
    owner = np.repeat(np.arange(len(text)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    power = np.multiply.accumulate(np.full(text.shape[1] + 1, 0xD6E8FEB86659FD93 | 1, np.uint64))
    back = np.multiply.accumulate(np.full(text.shape[1] + 1, pow(0xD6E8FEB86659FD93 | 1, -1, 1 << 64), np.uint64))
    sums = np.zeros((len(text), text.shape[1] + 1), np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1], axis=1, out=sums[:, 1:])
    at = first[owner] + nth
    # a window's key holds its place against the anchor, which equal windows share
    key = mixed((sums[owner, at + s.length] - sums[owner, at]) * back[at] + at.astype(np.uint64))
    smaller = least_of(key, ids[owner]) < ids[owner]
    return np.bincount(owner, np.where(smaller, 1 << nth, 0), len(text)).astype(np.int64)


def masks(runs: DataFrame, s: Settings) -> DataFrame:
    """(block, classes, masks) of every range: only classes of which something goes."""

    def task(group: pa.Table) -> pa.Table:
        blocks_, bodies = group.column("block").to_pylist(), group.column("body")
        out = []
        if group.column("kind")[0].as_py() == 0:
            parts = [_split(b.as_py(), np.uint32, np.int64, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8) for b in bodies]
            for block, part, mask in zip(blocks_, parts, merged_masks(parts, s), strict=True):
                some = mask > 0
                out.append((block, pack(part[0][some]), pack(mask[some])))
        else:
            parts = [_split(b.as_py(), np.uint64, np.int64, np.uint32, np.uint8) for b in bodies]
            h, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            gone = least_of(h, ids) < ids
            end = np.cumsum([0, *(len(p[0]) for p in parts)])
            for k, (block, part) in enumerate(zip(blocks_, parts, strict=True)):
                some = gone[end[k] : end[k + 1]]
                out.append((block, pack(part[2][some]), pack((1 << part[3][some].astype(np.uint32)).astype(np.uint32))))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "classes", "masks"])

    return runs.groupBy("kind", "range").applyInArrow(frugal_group(task), "block long, classes binary, masks binary")


# 3. removal


def removed_bytes(docs: pa.Table, found: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """For each byte of a block, whether it goes."""
    _, lo, hi, ids, _, kind = block_entries(docs, s)
    n = len(all_bytes(docs))
    steps = np.zeros(n + 1, np.int32)
    if len(lo):
        _, which, least = classes(kind, ids)
        bits = np.zeros(len(least), np.int64)
        for c, m in found:
            np.bitwise_or.at(bits, c, m.astype(np.int64))
        later = ids > least[which]
        np.add.at(steps, lo[later], 1)
        np.add.at(steps, hi[later] + s.length, -1)
        own = np.flatnonzero(~later & (bits[which] > 0))
        for b in range(s.length - s.gram + 1):
            at = lo[own[(bits[which[own]] >> b) & 1 > 0]] + b
            np.add.at(steps, at, 1)
            np.add.at(steps, at + s.length, -1)
    return np.cumsum(steps[:-1]) > 0


def without_repeats(documents: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents (doc_id, text, further columns kept) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text (a character that is cut in two goes whole).

    Columns of documents that are named like one of these are replaced.
    """
    small_batches(documents.sparkSession)
    documents = without(documents, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    blocks = to_blocks(documents, s)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    spark = documents.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // s.range_bytes)
    runs = written(gram_runs(blocks, ranges, s), "gram-runs")
    found = masks(suffix_runs(blocks, shared_grams(runs, s), splitters(runs, ranges, s), ranges, s), s)
    names = documents.columns

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = from_block(left.column("docs")[0].as_py())
        pairs = [(unpack(c.as_py(), np.uint32), unpack(m.as_py(), np.uint32)) for c, m in zip(right.column("classes"), right.column("masks"), strict=True)]
        gone, data = removed_bytes(docs, pairs, s), all_bytes(docs)
        out: list[list] = [[], [], [], [], []]
        at = 0
        for _, _, offsets, _ in text_slices(docs.column("text").chunk(0)):
            for i, j in zip(offsets[:-1] + at, offsets[1:] + at, strict=True):
                g = gone[i:j]
                kept = data[i:j][~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and bool(g[0])))
                for column, x in zip(out, (int(j - i), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    column.append(x)
            at += int(offsets[-1])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([*(loose(docs.column(n)) for n in names), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return blocks.select("block", "docs").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(frugal_pair(task), f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte repeats remove from all documents."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
