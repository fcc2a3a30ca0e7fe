"""Ranked lexical search: each term's posting list in blocks of similar documents, with exact summaries to skip them by.

A document is a vector of integer impacts, one for each of its terms. Documents are laid out by similarity (the signs of
random projections of their weighted vectors), and each term's posting list is cut along that order into blocks of a few
similar documents. A block's summary is the coordinatewise maximum of its documents' impacts, over every term that some
question holds beside the block's own.

A question's terms are ordered by weight, heaviest first. A document is met in the block of the heaviest of the question's
terms that it holds, so a block's bound sums weight times summary over that term and the lighter ones only. A block is
skipped only if its bound is below the question's tenth best score so far; every other block's documents are scored in
full. Scores from a sixteenth of the tiles give all tasks a first such limit, which is a lower bound of the final one, so
results are exact.

A tile is some hundreds of documents with all their blocks: one row of the index table, which stands in the shared folder.
Each task keeps ten documents a question; those are what the final ranking shuffles. The questions' terms are broadcast in
parts of at most `part_terms` terms, each part with an index of its own, so memory does not grow with the questions.

Null and empty texts have no terms: such documents are not counted and never found, such items have no rows. Items of one
id (null included) count as one item with all their terms. Repeated documents are each ranked; equal scores go by doc_id,
null last. Texts of any length are read whole. Empty tables give no rows. Other columns are not looked at. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmeter.llm.byteops import FOLD, Substrings, frugal, runs, text_slices
from docmeter.llm.shared import forget, small_batches, table, written

TERM = np.zeros(256, np.uint8)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    top: int = 10
    block: int = 32  # documents of a posting block
    cells: int = 4_000_000  # documents times terms of a tile
    bits: int = 16  # of a document's place
    part_terms: int = 100_000  # terms of the questions that are broadcast at once, repeats included
    seeds: int = 16  # one tile in so many gives the first limits


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, hash of every term and its text number, by slices."""
    for i, j, offsets, data in text_slices(column, 1 << 22):
        low = FOLD[data]
        start, end, _, text = runs(low, offsets, TERM)
        yield i, j, Substrings(low)(start, end), text


def question_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> (item_id, term): different terms, as hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, key, text in _terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(text + i)), pa.array(key.view(np.int64))], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(frugal(task), f"item_id {kind}, term long").distinct()


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def counted(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, term, tf) of documents with terms: all terms counted in n, the vocabulary's (by place in it) listed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for batch in batches:
            for i, j, key, text in _terms(batch.column("text")):
                n = np.bincount(text, minlength=j - i).astype(np.int64)
                at = np.minimum(np.searchsorted(vocab, key), len(vocab) - 1)
                hit = vocab[at] == key
                one, tf = np.unique(text[hit] * np.int64(len(vocab)) + at[hit], return_counts=True)
                ends = np.searchsorted(one, np.arange(j - i + 1) * np.int64(len(vocab)))
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(n), _lists(ends, (one % len(vocab)).astype(np.int32)), _lists(ends, tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "term", "tf"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(task), "doc_id long, n long, term array<int>, tf array<long>")


@dataclass
class Asked:
    """A part of the questions, for the tasks. Terms are numbered by weight, the heaviest first; those of weight 0 are left out."""

    number: np.ndarray  # of each place of the vocabulary; -1: weight 0
    weight: np.ndarray  # by number
    beside: list[np.ndarray]  # by number: the numbers from it on that questions hold with it
    terms: list[np.ndarray]  # of each item, ascending


def ask(vocab: np.ndarray, df: dict[int, int], n_docs: int, questions: list[np.ndarray]) -> Asked:
    """questions: places in vocab of each item's terms."""
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) if df.get(k, 0) else 0 for k in range(len(vocab))], np.int64)
    order = np.argsort(-w, kind="stable")
    order = order[w[order] > 0]
    number = np.full(len(vocab), -1, np.int64)
    number[order] = np.arange(len(order))
    beside: list[set] = [set() for _ in order]
    terms = []
    for places in questions:
        mine = np.sort(number[places])
        mine = mine[mine >= 0]
        terms.append(mine)
        for p, t in enumerate(mine.tolist()):
            beside[t].update(mine[p:].tolist())
    return Asked(number, w[order], [np.array(sorted(b), np.int64) for b in beside], terms)


def placed(found: DataFrame, asked: Broadcast, tokens: int, n_docs: int, bits: int) -> DataFrame:
    """counted() -> (doc_id, place, term, impact), laid out by similarity. Equal documents share a place; a hash of the id lets ranges split them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Asked(**asked.value)
        sign = np.random.RandomState(11).choice(np.array([-1.0, 1.0]), (len(a.weight), bits))
        for batch in batches:
            n, lists = batch.column("n").to_numpy(), batch.column("term")
            term, tf = a.number[lists.flatten().to_numpy()], batch.column("tf").flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            kept = term >= 0
            doc, term, tf = doc[kept], term[kept], tf[kept]
            m = 10 + (90 * n * n_docs) // tokens
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            order = np.lexsort((term, doc))
            doc, term, impact = doc[order], term[order], impact[order]
            ends = np.searchsorted(doc, np.arange(len(batch) + 1))
            sums = np.zeros((len(batch), bits))
            for lo in range(0, len(doc), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                np.add.at(sums, doc[part], sign[term[part]] * (a.weight[term[part]] * impact[part] * 1e-6)[:, None])
            place = ((sums > 0) << np.arange(bits)[::-1]).sum(1).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array(place), _lists(ends, term.astype(np.int32)), _lists(ends, impact.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "term", "impact"]).filter(pa.array(np.diff(ends) > 0))

    out = found.where(F.size("term") > 0).mapInArrow(frugal(task), "doc_id long, place int, term array<int>, impact array<int>")
    salted = out.withColumn("salt", F.xxhash64("doc_id"))
    return salted.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("doc_id", "term", "impact")


TILE = "doc array<long>, end array<int>, term array<int>, impact array<int>, b_term array<int>, b_end array<int>, b_doc array<int>, b_max array<int>"


def _dense(end: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((len(end), width), np.int32)
    m[np.repeat(np.arange(len(end)), np.diff(end, prepend=0)), term] = impact
    return m


def _blocks(end: np.ndarray, term: np.ndarray, impact: np.ndarray, a: Asked, size: int) -> list[np.ndarray]:
    """Of a tile's documents: each block's term, the end of its documents, the documents by place in the tile, and the summaries one after another."""
    m = _dense(end, term, impact, len(a.weight))
    doc = np.repeat(np.arange(len(end)), np.diff(end, prepend=0))
    order = np.argsort(term, kind="stable")
    lists, first = np.unique(term[order], return_index=True)
    b_term, b_end, b_max = [], [], []
    for t, lo, hi in zip(lists.tolist(), first.tolist(), [*first[1:].tolist(), len(term)], strict=True):
        starts = np.arange(0, hi - lo, size)
        b_term.append(np.full(len(starts), t))
        b_end.append(lo + np.append(starts[1:], hi - lo))
        b_max.append(np.maximum.reduceat(m[np.ix_(doc[order[lo:hi]], a.beside[t])], starts, axis=0).ravel())
    return [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (b_term, b_end, [doc[order]], b_max)]


def index(laid: DataFrame, asked: Broadcast, s: Settings) -> DataFrame:
    """placed() -> a row a tile."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Asked(**asked.value)
        limit = max(1, s.cells // max(1, len(a.weight)))
        held, n = [], 0

        def tile(rows: pa.Table) -> pa.RecordBatch:
            lists = rows.column("term").combine_chunks()
            ends, term = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[1:], lists.flatten().to_numpy()
            impact = rows.column("impact").combine_chunks().flatten().to_numpy()
            one = [rows.column("doc_id").combine_chunks(), pa.array(ends.astype(np.int32)), pa.array(term), pa.array(impact), *map(pa.array, _blocks(ends, term, impact, a, s.block))]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in one], names=["doc", "end", "term", "impact", "b_term", "b_end", "b_doc", "b_max"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= limit:
                rows = pa.Table.from_batches(held)
                yield tile(rows.slice(0, limit))
                rest = rows.slice(limit)
                held, n = rest.to_batches(), len(rest)
        if n:
            yield tile(pa.Table.from_batches(held))

    return laid.mapInArrow(frugal(task), TILE)


def _better(score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((doc, -score))[:top]


def search(tiles: DataFrame, asked: Broadcast, limits: Broadcast, s: Settings) -> DataFrame:
    """The best `top` documents of each item in each task's tiles: (item, doc_id, score). limits: scores by item that the tenth best reaches at least."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, least = Asked(**asked.value), limits.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(len(batch)):
                doc, end, term, impact, b_term, b_end, b_doc, b_max = (batch.column(c)[row].values for c in range(8))
                doc, (end, term, impact, b_term, b_end, b_doc, b_max) = doc.fill_null(LAST).to_numpy(), (x.to_numpy() for x in (end, term, impact, b_term, b_end, b_doc, b_max))
                m = _dense(end, term, impact, len(a.weight))
                most = m.max(axis=0).astype(np.int64) * a.weight
                lists, first = np.unique(b_term, return_index=True)
                last = np.append(first[1:], len(b_term))
                width = np.array([len(a.beside[t]) for t in lists.tolist()], np.int64)
                summary = np.append(0, np.cumsum((last - first) * width))
                b_start = np.append(0, b_end[:-1])
                at = {t: k for k, t in enumerate(lists.tolist())}
                for item, terms in enumerate(a.terms):
                    score, names = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    limit = max(least.get(item, 1), score[-1] if len(score) == s.top else 1)
                    rest = np.cumsum(most[terms][::-1])[::-1]
                    found = []
                    for p, t in enumerate(terms.tolist()):
                        if rest[p] < limit:
                            break
                        if (k := at.get(t)) is None:
                            continue
                        sums = b_max[summary[k] : summary[k + 1]].reshape(-1, width[k])
                        bound = sums[:, np.searchsorted(a.beside[t], terms[p:])].astype(np.int64) @ a.weight[terms[p:]]
                        found += [b_doc[b_start[b] : b_end[b]] for b in (first[k] + np.flatnonzero(bound >= limit)).tolist()]
                    if not found:
                        continue
                    met = np.unique(np.concatenate(found))
                    new = m[np.ix_(met, terms)].astype(np.int64) @ a.weight[terms]
                    score, names = np.append(score, new[new > 0]), np.append(names, doc[met[new > 0]])
                    keep = _better(score, names, s.top)
                    best[item] = score[keep], names[keep]
        for item, (score, names) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.array(names, mask=names == LAST), pa.array(score)], names=["item", "doc_id", "score"])

    return tiles.mapInArrow(frugal(task), "item int, doc_id long, score long")


def _limits(found: DataFrame, top: int) -> dict[int, int]:
    """The score at place `top` of each item that has so many: a number an item of the part."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return {r["item"]: r["score"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).collect()}


def rank(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score of each item's best documents."""
    spark = docs.sparkSession
    small_batches(spark)
    terms = written(question_terms(items), "ranked-terms")
    parts = max(1, -(-terms.count() // s.part_terms))
    out = None
    for part in range(parts):  # nearly always one: a part is 100,000 terms of questions, and a pass over the texts
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.collect_list("term").alias("term")).collect()
        if not mine and out is not None:
            continue
        vocab = np.unique(np.array([t for r in mine for t in r["term"]], np.int64).view(np.uint64)) if mine else np.zeros(1, np.uint64)
        words = spark.sparkContext.broadcast(vocab)
        found = written(counted(docs, words), "ranked-counted")
        n_docs, tokens = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["n"] for r in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most a part's terms
        places = [np.searchsorted(vocab, np.array(r["term"], np.int64).view(np.uint64)) for r in mine]
        asked = spark.sparkContext.broadcast(vars(ask(vocab, df, n_docs, places)))
        tiles = written(index(placed(found, asked, max(1, tokens), n_docs, s.bits), asked, s), "ranked-index")
        forget(found)
        first = search(tiles.where(F.pmod(F.xxhash64(F.col("doc")[0], F.size("doc")), F.lit(s.seeds)) == 0), asked, spark.sparkContext.broadcast({}), s)
        limits = spark.sparkContext.broadcast(_limits(first, s.top))
        named = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(mine)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = written(search(tiles, asked, limits, s).join(F.broadcast(named), "item").drop("item"), "ranked-found")
        forget(tiles)
        out = best if out is None else out.unionByName(best)
    forget(terms)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= s.top).select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best `documents` of every `benchmark` item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_RUN}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
docs AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_RUN}')) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
score AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
 FROM tf JOIN asked USING (term) JOIN weight USING (term) JOIN docs USING (doc_id), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
