"""V4: approximate vector search by an inverted file that is built once and kept (V4, and the blocks of G12).

Build: a coarse quantiser (spherical k-means on a bounded sample) gives each vector a cell; vectors are written
partitioned by cell, with a one-byte code a number and the length of what the code leaves out. Search: a question probes
its nearest cells, which prunes partitions; inside them codes bound every cosine from both sides, and only vectors whose
upper bound reaches the k-th best lower bound are compared number by number. So nothing is lost inside the probed cells,
and recall depends on their number alone, which build() measures on sampled questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.operators.retrieval import VALUES, top_k


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # vectors that the cells and the number of probes are fitted on
    asked: int = 200  # of those, the questions whose recall is measured
    steps: int = 12
    recall: float = 0.97  # wanted on the sampled questions
    k: int = 10
    file_rows: int = 200_000


@dataclass(frozen=True)
class Index:
    """A kept index: where it is, its cells' centres and how many cells a question probes."""

    path: str
    centres: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(-1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def fit_cells(v: np.ndarray, cells: int, steps: int) -> np.ndarray:
    """Centres of `cells` groups of unit vectors by cosine; an empty group keeps its centre."""
    centres = v[np.random.RandomState(5).choice(len(v), cells, replace=False)]
    for _ in range(steps):
        at = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, v)
        centres = np.where((np.bincount(at, minlength=cells) > 0)[:, None], unit(sums), centres)
    return centres


def fit_probes(v: np.ndarray, centres: np.ndarray, s: Settings) -> int:
    """The smallest number of cells that gives sampled questions the wanted share of their k nearest."""
    asked = v[:: max(1, len(v) // s.asked)]
    near = np.argsort(-(asked @ v.T), axis=1, kind="stable")[:, 1 : s.k + 1]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    turn = np.take_along_axis(order, (v @ centres.T).argmax(1)[near], axis=1)
    share = np.cumsum(np.bincount(turn.ravel(), minlength=len(centres))) / max(1, turn.size)
    return int(min(len(centres), np.searchsorted(share, s.recall) + 1))


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A signed byte for each number, each vector's scale, and the length of what is left out."""
    scale = np.abs(v).max(axis=1) / 127
    code = np.rint(v / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
    left = v - code * scale[:, None]
    return code, scale, np.sqrt((left * left).sum(1)) + 1e-12


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(rows: DataFrame, key: str, centres: Broadcast, spread: Broadcast) -> DataFrame:
    """rows(key, vector) with cell, part (of the cell), scale, left and code; zero vectors too."""
    kind = rows.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = unit(_numbers(batch.column("vector")))
            if v.shape[1] != centres.value.shape[1]:
                raise ValueError(f"a vector has not {centres.value.shape[1]} numbers")
            cell = (v @ centres.value.T).argmax(1)
            code, scale, left = coded(v)
            part = np.random.RandomState(len(batch)).randint(0, 1 << 30, len(batch)) % spread.value[cell]
            columns = [batch.column(key), batch.column("vector"), *map(pa.array, (cell.astype(np.int32), part.astype(np.int32), scale, left)), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "vector", "cell", "part", "scale", "left", "code"])

    return rows.mapInArrow(task, f"{key} {kind}, vector array<double>, cell int, part int, scale double, left double, code binary")


def _doubles(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where(F.size("vector") > 0).select(key, F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def build(vectors: DataFrame, path: str, key: str = "chunk_id", s: Settings = Settings()) -> Index:  # noqa: B008
    """Writes an index of vectors(key, vector) to `path`. Null, empty and unfinished vectors (a null or NaN number) are left out.

    The number of cells is the square root of the number of vectors, at most a 32nd of the sample.
    """
    spark, rows = vectors.sparkSession, _doubles(vectors, key)
    n = rows.count()
    taken = rows.select(key, "vector").orderBy(F.xxhash64(F.col(key))).limit(s.sample).select("vector").toArrow().column("vector").combine_chunks()
    if not n:
        return Index(path, np.zeros((0, 0)), 0)
    v = unit(_numbers(taken))
    centres = fit_cells(v, max(1, min(int(n**0.5), len(v) // 32)), s.steps)
    sizes = np.bincount((v @ centres.T).argmax(1), minlength=len(centres)) * (n / len(v))
    spread = np.maximum(1, np.ceil(sizes / s.file_rows)).astype(np.int64)  # files of a cell, by its share of the sample
    index = Index(path, centres, fit_probes(v, centres, s))
    _write(rows, key, index, spark.sparkContext.broadcast(centres), spark.sparkContext.broadcast(spread), "overwrite")
    meta = [(index.probes, k, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(meta, "probes int, cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return index


def _write(rows: DataFrame, key: str, index: Index, centres: Broadcast, spread: Broadcast, mode: str) -> None:
    found = _assigned(rows, key, centres, spread)
    found.repartition("cell", "part").drop("part").write.mode(mode).partitionBy("cell").parquet(f"{index.path}/vectors")


def add(vectors: DataFrame, index: Index, key: str = "chunk_id") -> None:
    """Appends more vectors to a kept index, in the cells that it has."""
    context = vectors.sparkSession.sparkContext
    _write(_doubles(vectors, key), key, index, context.broadcast(index.centres), context.broadcast(np.ones(len(index.centres), np.int64)), "append")


def load(spark: SparkSession, path: str) -> Index:
    """A kept index."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # a row a cell
    return Index(path, np.array([r["centre"] for r in rows]), rows[0]["probes"])


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, key: str = "chunk_id", counted: object | None = None) -> DataFrame:
    """queries(query_id, vector) -> (query_id, key, score, rank), the k nearest in each query's cells. `counted`: an
    accumulator that gets the number of cosines computed in full.

    The queries are broadcast in parts of at most VALUES numbers, each part a scan of the cells that it probes.
    """
    spark = queries.sparkSession
    asked = _doubles(queries, "query_id")
    probes = probes or index.probes
    n = asked.count() if index.probes else 0
    parts = max(1, -(-n * (index.centres.shape[1] if n else 0) // VALUES))
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow() if n else None
        if not n:
            kind = queries.schema["query_id"].dataType.simpleString()
            return spark.createDataFrame([], f"query_id {kind}, {key} string, score double, rank int")
        q = unit(_numbers(rows.column("vector").combine_chunks()))
        near = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        held = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), q, by_cell))
        cells = index.vectors(spark).where(F.col("cell").isin(list(by_cell)))
        kinds = {c: cells.schema[key].dataType.simpleString() if c == key else queries.schema[c].dataType.simpleString() for c in ("query_id", key)}
        found = cells.select(key, "vector", "scale", "left", "code", "cell").mapInArrow(_scan(held, k, key, counted), f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
        out = found if out is None else out.unionAll(found)
    return top_k(out, k, ["query_id"], tie=key)


def _scan(held: Broadcast, k: int, key: str, counted: object | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = held.value
        floor = np.full(len(ids), -np.inf)  # the k-th best lower bound in this task so far
        lows: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                rows = batch.filter(pa.array(cell == c))
                mine = by_cell[c]
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rows), -1).astype(np.float32)
                about = (q[mine].astype(np.float32) @ code.T) * rows.column("scale").to_numpy()
                left = rows.column("left").to_numpy() + 1e-5  # and float32's error
                for row, at in enumerate(mine.tolist()):
                    low = np.concatenate([lows.get(at, np.zeros(0)), about[row] - left])
                    lows[at] = np.sort(low)[-k:]
                    if len(low) >= k:
                        floor[at] = lows[at][0]
                i, j = np.nonzero(about + left >= floor[mine][:, None])
                if not len(i):
                    continue
                v = unit(_numbers(rows.column("vector")))
                score = np.einsum("ij,ij->i", q[mine[i]], v[j])
                if counted is not None:
                    counted.add(len(i))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[i])), rows.column(key).take(pa.array(j)), pa.array(score.round(12))], names=["query_id", key, "score"])

    return task
