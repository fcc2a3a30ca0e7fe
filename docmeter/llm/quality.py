"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Tokens are runs of word bytes (case kept) and runs of other visible ASCII. Each token's cell (a hash) has a fixed sparse
ternary index vector. Its context vector sums the index vectors of the tokens at most two places away, over every text
of the corpus; a word vector is the unit context vector plus the unit index vector. A document is the mean of its
tokens' vectors, with that mean's length, the logarithm of the token count, the share of different tokens and the mean
token length.

The network (one hidden layer of tanh units, logistic output, both in numpy) is fitted with Adam on at most `fit_rows`
learning rows, picked by a hash of the id, both classes with equal weight. A temperature and a shift, fitted by log-loss on
a tenth of them that the weights never see, calibrate its probabilities; `predicted` is 1 from a probability of 0.5 on.

Null and empty texts have the zero vector and a defined score. Null labels are not learned from; of repeated labels of
one id the largest counts. Repeated rows are scored alike. A null doc_id is scored and never learned from. With labels
of one class only, or none, every score is that class's share, or 0.5. Columns of documents that are named like one of
the results (in any case) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.byteops import Substrings, frugal, mixed, runs, text_slices
from docmeter.llm.shared import joined, learn_fold, small_batches, table, without

TOKEN = np.full(256, 2, np.uint8)
TOKEN[: 0x21] = 0
TOKEN[127] = 0
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    dims: int = 48
    nonzero: int = 4
    window: int = 2
    hidden: int = 24
    fit_rows: int = 20_000
    epochs: int = 60


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every cell's nonzero entries, from the cell number alone."""
    h = mixed(np.arange((1 << s.bits) * s.nonzero, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(-1, s.nonzero)
    return (h % np.uint64(s.dims)).astype(np.int64), np.where((h >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)


def tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, text number and length of every token."""
    start, end, _, text = runs(data, offsets, TOKEN)
    cell = (Substrings(data)(start, end) >> np.uint64(64 - bits)).astype(np.int64) if len(start) else start
    return cell, text, end - start


def _contexts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors(s)
    size = (1 << s.bits) * s.dims
    total = np.zeros(size)
    for batch in batches:
        for _, _, offsets, data in text_slices(batch.column("text"), 1 << 22):
            cell, text, _ = tokens(data, offsets, s.bits)
            for away in range(1, s.window + 1):
                same = np.flatnonzero(text[away:] == text[:-away])
                left, right = cell[same], cell[same + away]
                for a, b in ((left, right), (right, left)):
                    for k in range(s.nonzero):
                        total += np.bincount(a * s.dims + place[b, k], sign[b, k], size)
    total = total.reshape(-1, s.dims)
    some = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(s.dims))], names=["cell", *(f"c{k}" for k in range(s.dims))])


def word_vectors(documents: DataFrame, s: Settings) -> np.ndarray:
    """Word vectors of all cells, from every text."""
    columns = [f"c{k}" for k in range(s.dims)]
    sums = documents.select("text").mapInArrow(frugal(lambda b: _contexts(b, s)), "cell long, " + ", ".join(f"{c} double" for c in columns)).groupBy("cell").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # 2**bits rows at most
    vectors = np.zeros((1 << s.bits, s.dims))
    vectors[sums["cell"]] = sums[columns]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    index = np.zeros_like(vectors)
    place, sign = index_vectors(s)
    np.add.at(index, (np.arange(len(index))[:, None], place), sign)
    return (unit(vectors) + unit(index)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """A document's vector: the mean word vector and four figures of its shape."""
    out = np.zeros((len(column), s.dims + 4), np.float32)
    for i, j, offsets, data in text_slices(column, 1 << 21):
        cell, text, length = tokens(data, offsets, s.bits)
        if not len(cell):
            continue
        n = np.bincount(text, minlength=j - i)
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        mean = np.add.reduceat(vectors[cell], first, axis=0) / n[some, None]
        different = np.bincount(np.unique((text << s.bits) | cell) >> s.bits, minlength=j - i)
        out[i + some, : s.dims] = mean * 3
        out[i + some, s.dims] = np.linalg.norm(mean, axis=1)
        out[i + some, s.dims + 1] = np.log1p(n[some]) / 5
        out[i + some, s.dims + 2] = different[some] / n[some]
        out[i + some, s.dims + 3] = np.bincount(text, length, j - i)[some] / n[some] / 5
    return out


class Network:
    """Input, tanh units, logistic output."""

    def __init__(self, inputs: int, hidden: int):
        r = np.random.RandomState(0)
        self.w = [r.randn(inputs, hidden) / np.sqrt(inputs), np.zeros(hidden), r.randn(hidden) / np.sqrt(hidden), np.zeros(1)]
        self.shift, self.scale, self.temperature, self.shifted = np.zeros(inputs), np.ones(inputs), 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(((x - self.shift) / self.scale) @ a + b) @ c + d

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int) -> None:
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        r, m, v, t = np.random.RandomState(1), [0.0] * 4, [0.0] * 4, 0
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        z = (x - self.shift) / self.scale
        for _ in range(epochs):
            order = r.permutation(len(z))
            for k in range(0, len(z), 128):
                part = order[k : k + 128]
                a, b, c, d = self.w
                h = np.tanh(z[part] @ a + b)
                e = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y[part]) * weight[part] / len(part)
                back = e[:, None] * c * (1 - h * h)
                t += 1
                for i, g in enumerate((z[part].T @ back + 1e-4 * a, back.sum(0), h.T @ e + 1e-4 * c, e.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """The temperature and the shift with the least log-loss on rows that were held back, by Newton's method with a small penalty."""
        z = np.stack([self.logit(x), np.ones(len(x))], axis=1)
        start = w = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - y) + 0.1 * (w - start))
        if np.isfinite(w).all() and w[0] > 0.01:
            self.temperature, self.shifted = 1 / w[0], w[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.shifted, -30, 30)))


def score(spark: SparkSession, documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents with held_out, score and predicted, after learning from labels(doc_id, quality). All columns are kept."""
    small_batches(spark)
    documents = without(documents, "held_out", "score", "predicted")
    known = labels.where("doc_id is not null and quality is not null").where(learn_fold() != 1).groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(s.fit_rows)
    vectors = word_vectors(documents, s)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), shared.value, s)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("doc_id"), pa.array([v.tobytes() for v in x], pa.binary())], names=["quality", "doc_id", "v"])

    rows = joined(documents.select("doc_id", "text"), picked, "doc_id", limit=s.fit_rows).select("quality", F.xxhash64("doc_id").alias("doc_id"), "text").mapInArrow(frugal(pool), "quality long, doc_id long, v binary").toPandas().sort_values(["doc_id", "v"])
    y = rows["quality"].to_numpy(float)
    net, constant = None, float(y.mean()) if len(y) else 0.5
    if 0 < y.sum() < len(y):
        x = np.stack([np.frombuffer(v, np.float32) for v in rows["v"]]).astype(float)
        back = rows["doc_id"].to_numpy() % 10 == 0
        net = Network(x.shape[1], s.hidden)
        net.fit(x[~back] if 0 < y[~back].sum() < (~back).sum() else x, y[~back] if 0 < y[~back].sum() < (~back).sum() else y, s.epochs)
        if 0 < y[back].sum() < back.sum():
            net.calibrate(x[back], y[back])

    kept = documents.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probability(pooled(batch.column("text"), shared.value, s)) if net else np.full(batch.num_rows, constant)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept) + 1)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.withColumn("held_out", F.coalesce(learn_fold() == 1, F.lit(False))).mapInArrow(frugal(rate), f"{schema}, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored; labels learned from the rows whose crc32(doc_id) mod 3 is not 1."""
    return score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
