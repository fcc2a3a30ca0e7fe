"""Ogg: media columns written as pages with checksums and read back by packets.

The writer cuts a payload of 8-bit samples into packets, deals them in turn to `streams` logical streams, and lays each
stream's packets out in pages by lacing values (runs of 255 and a smaller last one). Pages of the streams alternate.
Granule positions count a stream's samples up to the last packet that ends on the page; -1 where none ends.

The reader checks every page's checksum, demultiplexes by serial number, checks page order, joins packets from lacing
values (also across pages), derives each packet's time from granule positions, and puts the samples back in order.

A page's checksum is CRC-32 with polynomial 0x04c11db7, bits not reflected, start 0. zlib has the reflected kind; the two
agree after the bits of every byte of the input, and of the result, are reversed, so zlib does the work.

Null and empty texts are one block of 64 zero bytes. Every value depends on the text alone, so equal texts have equal
values. Repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmeter.llm.shared import table

HEADER, HEADER_BYTES = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC = b"\x01pcm8"
BLOCK = 64
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class BadPage(ValueError):
    """A page that breaks the format, or whose checksum is wrong."""


@dataclass(frozen=True)
class Settings:
    streams: int = 2
    packet: int = 4000
    rate: int = 8000


def page_crc(page: bytes) -> int:
    raw = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return head[:22] + page_crc(head).to_bytes(4, "little") + head[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """One logical stream: (packet, granule position at its end) into pages of up to 255 lacing values."""
    out: list[bytes] = []
    lacing, body, granule, opened = bytearray(), bytearray(), -1, False
    for k, (packet, position) in enumerate(packets):
        at = 0
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        for n, value in enumerate(values):
            lacing.append(value)
            body += packet[at : at + value]
            at += value
            done = n == len(values) - 1
            if done:
                granule = position
            final = done and k == len(packets) - 1
            if len(lacing) == 255 or final or (done and k == 0):  # the header packet has a page of its own
                out.append(_page(opened * CONTINUED | (not out) * FIRST | final * LAST, granule, serial, len(out), bytes(lacing), bytes(body)))
                lacing, body, granule, opened = bytearray(), bytearray(), -1, not done
    return out


def write(payload: bytes, s: Settings = Settings()) -> bytes:  # noqa: B008
    """A physical stream of the payload's packets, dealt to the logical streams in turn."""
    chunks = [payload[i : i + s.packet] for i in range(0, len(payload), s.packet)]
    streams = []
    for k in range(s.streams):
        packets, position = [(MAGIC + struct.pack("<BBII", k, s.streams, s.rate, s.packet), 0)], 0
        for chunk in chunks[k :: s.streams]:
            position += len(chunk)
            packets.append((chunk, position))
        streams.append(_pages(0x4F670000 + k, packets))
    heads = [pages[0] for pages in streams]  # all first pages stand before any other
    rest = [pages[1:] for pages in streams]
    return b"".join(heads) + b"".join(pages[i] for i in range(max(map(len, rest), default=0)) for pages in rest if i < len(pages))


def read(media: bytes) -> tuple[bytes, dict[int, list[tuple[float, int]]]]:
    """The samples in order, and by stream number each packet's (end time in seconds, bytes)."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER_BYTES:
            raise BadPage("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEADER, media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise BadPage(f"no whole page at byte {at}")
        page = media[at:end]
        if page_crc(page[:22] + bytes(4) + page[26:]) != crc:
            raise BadPage(f"wrong checksum at byte {at}")
        known = streams.setdefault(serial, {"next": 0, "open": [], "packets": [], "ends": [], "last": False})
        if number != known["next"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(known["open"]) or known["last"]:
            raise BadPage(f"page {number} of stream {serial:x} is out of order")
        known["next"], known["last"] = number + 1, bool(flags & LAST)
        place, length, ended = 27 + n, 0, []
        for value in lacing:
            length += value
            if value < 255:
                known["packets"].append(b"".join([*known["open"], page[place : place + length]]))
                known["open"] = []
                ended.append(len(known["packets"]) - 1)
                place, length = place + length, 0
        if length:
            known["open"].append(page[place : place + length])
        if ended and granule >= 0:
            # packets that end on one page get their times backwards from the page's granule position
            position, times = granule, []
            for k in reversed(ended):
                times.append(position)
                position -= len(known["packets"][k]) if k else 0
            known["ends"] += reversed(times)
        at = end
    data: dict[int, list[bytes]] = {}
    times: dict[int, list[tuple[float, int]]] = {}
    for known in streams.values():
        if known["open"] or not known["last"] or not known["packets"] or not known["packets"][0].startswith(MAGIC):
            raise BadPage("a stream is cut off or has no header")
        k, _, rate, _ = struct.unpack("<BBII", known["packets"][0][len(MAGIC) :])
        data[k] = known["packets"][1:]
        times[k] = [(end / rate, len(p)) for p, end in zip(known["packets"][1:], known["ends"][1:], strict=True)]
    order = [data[k] for k in sorted(data)]
    return b"".join(part[i] for i in range(max(map(len, order), default=0)) for part in order if i < len(part)), times


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def features(samples: bytes, times: dict[int, list[tuple[float, int]]]) -> str:
    """Streams, packets, seconds, mean level, root mean square and zero crossings a sample."""
    # float32 differences of 8-bit samples are exact
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    crossings = np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)) / max(1, len(x) - 1)
    seconds = max((t for part in times.values() for t, _ in part), default=0.0)
    return f"streams={len(times)};packets={sum(map(len, times.values()))};seconds={seconds:.4f};mean={x.mean(dtype=np.float64):.4f};rms={np.sqrt(np.dot(x, x) / len(x)) if len(x) < 1 << 20 else np.sqrt(np.mean(np.square(x, dtype=np.float64))):.3f};zcr={crossings:.5f}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(documents: DataFrame, s: Settings = Settings(), keep_media: bool = False) -> DataFrame:  # noqa: B008
    """documents(doc_id, text) with their texts stored as Ogg and read back; `keep_media` adds the stored bytes as `media`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for first in range(0, big.num_rows, 500):
                batch = big.slice(first, 500)
                rows: list[tuple] = []
                for text in batch.column("text"):
                    n, payload = payload_of(text.as_py())
                    media = write(payload, s)
                    samples, times = read(media)
                    rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, times), *([media] if keep_media else [])))
                names = [c.split()[0] for c in COLUMNS.split(", ")] + ["media"] * keep_media
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, {COLUMNS}" + ", media binary" * keep_media)


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as 8-bit samples in Ogg, read back and measured."""
    return media_columns(table(spark, sf_dir, "documents"))
