"""Whether answers rest on their sources."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.functions import text

# What is said instead of an answer without grounds.
NO_SOURCE = "根据现有资料无法确定（未检索到可引用的内容）。"
UNSUPPORTED = "根据现有资料无法确定（回答中的论断未能在参考资料中找到依据）。"
CLAIMS, HEAD = 8, 120
MARK = r"\[来源[:：]\s*([^\],，\n]+?)\s*[,，]\s*第?\s*(\d+)\s*页\s*\]"


def source_coverage(sources: DataFrame) -> DataFrame:
    """sources(answer_id, chunk_id, text): usable share rounded to 3, and whether every source has an id."""
    has_id, has_text = F.coalesce("chunk_id", F.lit("")) != "", F.coalesce("text", F.lit("")) != ""
    one = sources.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if(has_id & has_text).alias("usable"), F.count_if(~has_id).alias("without_id"))
    return one.select("answer_id", F.round(F.col("usable") / F.greatest("n", F.lit(1)), 3).alias("coverage"), (F.col("usable") > 0).alias("has_sources"), (F.col("without_id") == 0).alias("stable_ids"))


def guarded(answer: Column, has_sources: Column) -> Column:
    """No source, no claim."""
    return F.when(has_sources, answer).otherwise(F.lit(NO_SOURCE))


def claims(answers: DataFrame, limit: int = CLAIMS) -> DataFrame:
    """answers(answer_id, answer) to at most `limit` sentences each."""
    parts = F.slice(F.transform(text.sentences(F.col("answer")), lambda s: F.trim(F.regexp_replace(s, r"^(?U)\s+|(?U)\s+$", ""))), 1, limit)
    return answers.select("answer_id", F.posexplode(parts).alias("pos", "claim"))


def coverage(claim_rows: DataFrame, verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims against verdicts(answer_id, claim, supported) by mutual containment.

    answers(answer_id, n_sources). No claims or no sources: 0, verified. Nothing matches: unknown, not verified.
    """
    said = F.trim("v_claim")
    met = claim_rows.join(verdicts.select("answer_id", F.col("claim").alias("v_claim"), "supported"), "answer_id").where((said != "") & (F.contains("claim", said) | F.contains(said, F.col("claim"))))
    found = met.groupBy("answer_id").agg(F.count("*").alias("matched"), F.count_distinct(F.when(F.col("supported"), F.col("claim"))).alias("supported"))
    total = claim_rows.groupBy("answer_id").agg(F.count_distinct("pos").alias("total"))
    both = answers.join(total, "answer_id", "left").join(found, "answer_id", "left")
    none = (F.coalesce("total", F.lit(0)) == 0) | (F.coalesce("n_sources", F.lit(0)) == 0)
    seen = F.coalesce("matched", F.lit(0)) > 0
    return both.select("answer_id", F.coalesce("total", F.lit(0)).alias("total"), F.when(none, F.lit(0)).when(seen, F.col("supported")).alias("supported"), F.when(none, F.lit(0.0)).when(seen, F.round(F.col("supported") / F.col("total"), 3)).alias("coverage"), (none | seen).alias("verified"))


def verify(answers: DataFrame, judge: Callable[[list[str], list[str]], list[bool]]) -> DataFrame:
    """A judge on (answer_id, claims, sources): its verdicts; where it fails there are none. It sees 5 sources, 500 characters each."""

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for key, said, sources in b.itertuples(index=False):
                try:
                    rows += [(key, c, bool(v)) for c, v in zip(said, judge(list(said), [s[:500] for s in sources[:5]]), strict=True)]
                except Exception:  # noqa: BLE001, S112  a verdict that was not given is unknown
                    continue
            yield pd.DataFrame(rows, columns=["answer_id", "claim", "supported"])

    kind = answers.schema["answer_id"].dataType.simpleString()
    return answers.select("answer_id", "claims", "sources").mapInPandas(task, f"answer_id {kind}, claim string, supported boolean")


def refused_for_coverage(answer: Column, covered: Column, verified: Column, n_sources: Column, least: float = 0.0) -> Column:
    """The refusal if verified coverage is not above `least` and there are sources."""
    return F.when(verified & (covered <= least) & (n_sources > 0), F.lit(UNSUPPORTED)).otherwise(answer)


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, chunk_id) that an answer names by id, or by document and page."""
    part = lambda k: F.regexp_extract_all(F.col("answer"), F.lit(MARK), F.lit(k))
    marks = answers.select("answer_id", "answer", F.arrays_zip(part(1).alias("doc"), part(2).alias("page")).alias("marks"))
    both = sources.join(marks, "answer_id")
    by_page = F.exists("marks", lambda m: (m["doc"] == F.trim(F.col("doc_name"))) & (m["page"].cast("int") == F.coalesce(F.col("page"), F.lit(0))))
    return both.where((F.col("chunk_id") != "") & (F.contains("answer", F.col("chunk_id")) | ((F.trim("doc_name") != "") & by_page))).select("answer_id", "chunk_id").distinct()


def trimmed(sources: DataFrame, cited_rows: DataFrame, head: int = HEAD) -> DataFrame:
    """Cited sources longer than `head` keep their head; `trimmed` says which."""
    both = sources.join(cited_rows.withColumn("cited", F.lit(True)), ["answer_id", "chunk_id"], "left")
    cut = F.coalesce("cited", F.lit(False)) & (F.length("text") > head)
    return both.select(*(c for c in sources.columns if c != "text"), F.when(cut, text.truncated(F.col("text"), head)).otherwise(F.col("text")).alias("text"), F.coalesce(cut, F.lit(False)).alias("trimmed"))


def self_check(has_sources: Column, tool_grounded: Column, retrieval_ran: Column, skipped: Column) -> Column:
    """What an agent's answer rests on."""
    return F.when(skipped, "skipped").when(has_sources, "passed_with_citation").when(tool_grounded & ~retrieval_ran, "passed_with_tool").otherwise("refused")
