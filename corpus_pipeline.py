"""A corpus in five stages: quality, near-duplicates, repeated passages, benchmark leaks, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and rereads as the
next stage's docs. All but the last return the columns of documents.

- quality: documents that the classifier predicts to be of low quality go.
- near_duplicates: of each group of near copies (five words, similarity 0.8) the smallest doc_id stays, once.
- repeats: bytes that a 50-byte string from a smaller doc_id covers are cut out of the text (a character that is cut in two
  goes whole); n_chars follows; a document of which only white space is left goes.
- decontamination: documents with a 10-word window of a benchmark item go.
- mixing: every document gets `rate`, `n_tokens` and `copies`, the number of times that it stands in the mixture: the rate
  rounded up or down by a hash of its id, so that the expected copies are the rate. Rows with 0 copies stay in the table.

Null texts are empty texts: scored, one group with other empty texts, and gone in `repeats`. Rows without a doc_id cannot
be told apart later and leave in near_duplicates. Columns beyond doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmeter.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from docmeter.llm.shared import forget, joined, scratch, settled, table, written

ROW, NTH = "carried_row", "carried_nth"


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, everything else in one struct), so that no other column's name can clash with a stage's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(None).cast("int").alias("carried_nothing"), *rest).alias(ROW))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score(spark, carried(docs), table(spark, sf_dir, "labels"))
    return restored(scored.where("predicted = 1"), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = settled(spark, lambda: simhash.similar(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct(), "firsts")
    once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    kept = joined(docs, first, "doc_id", "left_semi")
    if once.isEmpty():
        return kept
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.sha2("text", 256)))  # of several texts of one id always the same one
    return kept.withColumn(NTH, nth).where(F.col(NTH) == 1).drop(NTH)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(carried(docs))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    cut = found.withColumn("text", text).where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    kept = restored(cut, docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaked = written(found.where(F.size("spans") > 0).select("doc_id").distinct(), "leaked")
    return joined(docs, leaked, "doc_id", "left_anti")


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id").distinct()
    labelled = joined(docs.where("lang is not null").select("doc_id", F.col("lang").alias("domain")), listed, "doc_id", "left_semi")
    rates = mixing.mix(docs.select("doc_id", "text"), labelled, mixing.TARGETS).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "rate")).alias("mixed"))
    both = docs.join(rates, "doc_id", "left")
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.col("mixed.rate")
    kept = both.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "rate", "copies")), F.col("mixed.n_tokens").alias("n_tokens"), rate.alias("rate"), F.floor(rate + part).cast("long").alias("copies"))
    return kept


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
]

#: The classifier, the sketches and the fit are beyond SQL; tests hold the stages against brute force and literal cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage wrote on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as made:
            last, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*(t for t in made if t is not docs))
        if name != STAGES[0][0]:
            forget(last)
    return docs
