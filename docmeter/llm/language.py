"""Language by nearest centroid: normalised TF-IDF vectors of byte bigrams and trigrams against several centroids a language.

Letters are lower-cased (A-Z), every other ASCII byte is a space, and each n-gram falls into one of `cells` cells.
Document frequencies come from all learning rows. The centroids (spherical k-means, `centroids` a language) are fitted on
at most about `sample_rows` learning rows, shared evenly between the languages and picked by a hash of the id.

A text goes to the language of the centroid with the largest cosine (ties: the alphabetically first). It is `rejected` if
that cosine lies below the `reject_quantile` of the cosines which the language's own sample rows have.

A null text, or one without a letter, is `und` with score 0. If nothing can be learned, all is `und`. Null languages are not
learned from; repeated rows are scored alike; a null doc_id is scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import frugal, text_slices
from docmeter.llm.shared import learn_fold, small_batches, table, without

LETTER = np.zeros(256, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Settings:
    cells: int = 4096  # a power of two
    centroids: int = 3
    sample_rows: int = 6000
    reject_quantile: float = 0.005
    rounds: int = 12


def term_counts(data: np.ndarray, offsets: np.ndarray, cells: int) -> np.ndarray:
    """N-gram counts, a row a text."""
    n = len(offsets) - 1
    out = np.zeros(n * cells, np.float32)
    if len(data):
        b = LETTER[data]
        text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * cells
        shift = np.uint32(32 - cells.bit_length() + 1)
        for size in (2, 3):
            if len(b) < size:
                continue
            gram = b[: len(b) - size + 1].copy()
            for k in range(1, size):
                gram = (gram << np.uint32(8)) | b[k : len(b) - size + 1 + k]
            whole = (text[: len(gram)] == text[size - 1 :]) & (gram != 0)  # inside one text, not only spaces
            cell = ((gram * np.uint32(2654435761) + np.uint32(size)) * np.uint32(0x9E3779B1)) >> shift
            out += np.bincount((text[: len(gram)] + cell)[whole], minlength=n * cells)
    return out.reshape(n, cells)


def vectors(column: pa.Array, idf: np.ndarray, cells: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Unit TF-IDF vectors of successive slices of a column."""
    for first in range(0, len(column), 1024):
        for i, j, offsets, data in text_slices(column.slice(first, 1024)):
            x = np.log1p(term_counts(data, offsets, cells)) * idf
            yield first + i, first + j, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids by spherical k-means; starts from rows that are far from each other."""
    centres = [x.mean(0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-9)
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _frequencies(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(cells, np.int64)
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            for _, _, offsets, data in text_slices(batch.column("text").slice(first, 1024)):
                total += (term_counts(data, offsets, cells) > 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "n"])


def predict(spark: SparkSession, documents: DataFrame, learn: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents(doc_id, text, further columns kept) with lang_pred, score and rejected, learned from learn(doc_id, text, lang).

    Columns of documents that are named like one of the results are replaced.
    """
    small_batches(spark)
    documents = without(documents, "lang_pred", "score", "rejected")
    flag = "has_letter"
    while flag in map(str.lower, documents.columns):
        flag += "_"
    learn = learn.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang")
    size = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    n = sum(size.values())
    found = learn.select("text").mapInArrow(lambda b: _frequencies(b, s.cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(s.cells)
    df[found["cell"]] = found["n"]
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in vectors(batch.column("text"), idf, s.cells):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "v"])

    languages, centres, limits = [], np.zeros((0, s.cells), np.float32), []
    if n:
        share = F.create_map(*(F.lit(v) for k, c in size.items() for v in (k, min(1.0, s.sample_rows / len(size) / c))))
        picked = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6 < share[F.col("lang")])
        sample = picked.select("lang", "text").mapInArrow(frugal(to_vectors), "lang string, v binary").toPandas()
        for lang in sorted(set(sample["lang"])):
            x = np.stack([np.frombuffer(v, np.float16) for v in sample["v"][sample["lang"] == lang]]).astype(np.float32)
            c = kmeans(x, s.centroids, s.rounds)
            limits += [float(np.quantile((x @ c.T).max(1), s.reject_quantile))] * len(c)
            languages += [lang] * len(c)
            centres = np.vstack([centres, c])
    model = spark.sparkContext.broadcast((np.array(languages, object), centres, np.array(limits), idf))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, limit, weights = model.value
        for batch in batches:
            pred, score, rejected = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            letter = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
            if len(names):
                for i, j, x in vectors(batch.column("text"), weights, s.cells):
                    cosine = x @ c.T
                    best = cosine.argmax(1)
                    pred[i:j], score[i:j] = names[best], np.clip(cosine[np.arange(j - i), best], 0, 1)
                    rejected[i:j] = score[i:j] < limit[best]
            pred[~letter], score[~letter], rejected[~letter] = "und", 0.0, True
            kept = [k for k in batch.schema.names if k not in ("text", flag)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, "lang_pred", "score", "rejected"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    asked = documents.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return asked.mapInArrow(frugal(nearest), f"{kept}, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's language, learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(learn_fold(mod=4) == 2, F.lit(False))
    return predict(spark, documents.select("doc_id", "text", held_out.alias("held_out")), documents.where(~held_out))
