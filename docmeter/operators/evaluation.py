"""Golden sets, retrieval metrics, run comparison and judged scores (M, A11 to A14, W6, W7)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmeter.functions import text
from docmeter.operators.containment import held_needles

#: The lines that a run is held against.
TARGETS = {"fact": 0.80, "grounded": 0.80, "refusal": 0.80, "faithfulness": 0.80}

#: The figures of a judge.
JUDGED = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def rate(hit: Column, of: Column | None = None) -> Column:
    """The share of rows of `of` that hit; null without such rows."""
    of = F.lit(True) if of is None else of
    return F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0))


def gold_chunks(golden: DataFrame, chunks: DataFrame, numerals: bool = True) -> DataFrame:
    """golden(question_id, doc, expect, page) and chunks(chunk_id, doc, page_num, content): the chunks that hold the fact.

    One pass over the chunks, whatever the number of questions of a document.
    """
    want = golden.where("doc is not null").select(F.col("question_id").alias("needle_id"), "doc", F.col("page").cast("int").alias("page_num"), text.normalized(F.col("expect"), numerals).alias("needle"))
    have = chunks.select(F.col("chunk_id").alias("text_id"), "doc", F.col("page_num").cast("int").alias("page_num"), text.normalized(F.col("content"), numerals).alias("text"))
    return held_needles(want, have, ("doc", "page_num"), numeric_edges=True).select(F.col("needle_id").alias("question_id"), F.col("text_id").alias("chunk_id"))


def retrieval_scores(ranks: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """ranks(label, question_id, chunk_id, rank), gold(question_id, chunk_id): hit@k, recall@k and MRR by label.

    Questions with gold count even where a method returned nothing for them.
    """
    asked = gold.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    every = asked.join(F.broadcast(ranks.select("label").distinct()), how="cross")  # a few labels
    hits = ranks.join(gold.withColumn("gold", F.lit(True)), ["question_id", "chunk_id"]).groupBy("label", "question_id").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks))
    per = every.join(hits, ["label", "question_id"], "left").fillna(0, [f"in_{k}" for k in ks])
    figures = [f for k in ks for f in (F.avg((F.col(f"in_{k}") > 0).cast("double")).alias(f"hit_{k}"), F.avg(F.col(f"in_{k}") / F.greatest(F.col("n_gold"), F.lit(1))).alias(f"recall_{k}"))]
    return per.groupBy("label").agg(F.count("*").alias("questions"), *figures, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def without_gold(golden: DataFrame, gold: DataFrame) -> DataFrame:
    """M8: positive questions that no chunk answers."""
    return golden.join(gold.select("question_id").distinct(), "question_id", "left_anti")


def recall_ceilings(gold: DataFrame, k: int) -> DataFrame:
    """M9: the best recall@k that a question with more than k gold chunks can reach."""
    return gold.groupBy("question_id").agg(F.count("*").alias("n_gold")).where(F.col("n_gold") > k).withColumn("ceiling", F.lit(k) / F.col("n_gold"))


def negatives(top: DataFrame, questions: DataFrame, least: float = 0.4) -> DataFrame:
    """Whether the best vector score of a negative question stays below the threshold; unknown is null."""
    best = top.where("rank = 1").select("query_id", F.col("score").alias("top1"))
    return questions.join(best, "query_id", "left").select("query_id", "top1", (F.col("top1") < least).alias("rejected"))


def verdicts(golden: DataFrame, answers: DataFrame, numerals: bool = True) -> DataFrame:
    """M1: golden(item, expect, page, negative, group) with answers(item, answer, sources array<struct<text,page>>, ...)."""
    both = golden.join(answers, "item", "left")
    sources = F.coalesce("sources", F.array().cast("array<struct<text:string,page:int>>"))
    want = text.normalized(F.col("expect"), numerals)
    joined = F.array_join(F.transform(sources, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    found = F.exists(sources, lambda s: F.coalesce(s["page"] == F.col("page"), F.lit(False)))
    return both.select(
        *golden.columns,
        *(c for c in answers.columns if c not in ("item", "sources")),
        F.size(sources).alias("source_count"),
        text.contains_fact(want, text.normalized(F.col("answer"), numerals)).alias("fact_hit"),
        text.contains_fact(want, text.normalized(joined, numerals)).alias("grounded"),
        F.when(F.coalesce("page", F.lit(0)) != 0, found).alias("page_hit"),
        text.is_refusal(F.col("answer")).alias("refused"),
    )


def report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates of verdict rows, of all or by columns such as the group."""
    yes, no = ~F.coalesce("negative", F.lit(False)), F.coalesce("negative", F.lit(False))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("items"),
        F.count_if(no).alias("negatives"),
        rate(F.col("fact_hit"), yes).alias("fact_rate"),
        rate(F.col("grounded"), yes).alias("grounded_rate"),
        rate(F.coalesce("page_hit", F.lit(False)), yes & F.col("page").isNotNull()).alias("page_rate"),
        rate(F.col("refused"), no).alias("refusal_rate"),
        F.count_if(F.col("source_count") == 0).alias("without_sources"),
        F.count_if(yes & (F.coalesce("expect", F.lit("")) == "")).alias("without_expect"),
        F.count_if(yes & F.col("page").isNull()).alias("without_page"),
    )


def judged_means(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows(negative, judged struct<JUDGED...> or null): the means of judged positives, each over the items that have
    the figure, and how many positives there are and were scored. A figure that nobody has is null."""
    yes = ~F.coalesce("negative", F.lit(False))
    mean = lambda m: F.avg(F.when(yes, F.col("judged")[m])).alias(m)
    return rows.groupBy(*(by or [])).agg(F.count_if(yes).alias("positives"), F.count_if(yes & F.col("judged").isNotNull()).alias("scored"), *map(mean, JUDGED))


def token_reduction(rows: DataFrame) -> DataFrame:
    """M4: 1 - after / before over positives with both; a reason where there is none."""
    usable = ~F.coalesce("negative", F.lit(False)) & (F.col("before") > 0) & F.col("after").isNotNull()
    one = rows.agg(F.count_if(usable).alias("n"), F.sum(F.when(usable, F.col("before"))).alias("before"), F.sum(F.when(usable, F.col("after"))).alias("after"), F.count_if(F.col("before").isNotNull()).alias("counted"), F.count("*").alias("items"))
    return one.select("n", (1 - F.col("after") / F.col("before")).alias("reduction"), F.when(F.col("n") > 0, F.lit(None).cast("string")).when(F.col("items") == 0, F.lit("no items")).when(F.col("counted") == 0, F.lit("no token counter")).otherwise(F.lit("nothing compressed")).alias("reason"))


def nearest_rank(values: DataFrame, shares: list[float], by: str = "stage", value: str = "v", accuracy: int = 10_000, rows: int = 1_000_000) -> DataFrame:
    """values(by, value) -> (by, share, n, value): the value at rank ceil(share * n) of each group, nulls left out.

    A mergeable sketch brackets each rank; a pass counts what lies below the bracket and inside it. While a bracket holds
    more than `rows` values it is narrowed by a sketch of its inside. Then the inside's different values, summed before
    they are shuffled, are ranked. No group's values are gathered; where a sketch missed the rank, its bracket is opened.
    """
    known = values.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("x"))
    spark = values.sparkSession
    sizes = [(r[by], r["n"]) for r in known.groupBy(by).agg(F.count("*").alias("n")).collect()]  # a row a group
    kind = known.schema[by].dataType.simpleString()
    wanted = {(g, p): (max(1, math.ceil(round(p * n, 9))), 0, n, None, None) for g, n in sizes for p in shares}  # rank, below, inside, low, high
    schema = f"{by} {kind}, share double, low double, high double, rank long"
    frame = lambda: spark.createDataFrame([(g, p, low, high, rank) for (g, p), (rank, _, _, low, high) in wanted.items()], schema)
    inside = F.coalesce(F.col("x") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("x") <= F.col("high"), F.lit(True))
    for _ in range(8):
        wide = {k: w for k, w in wanted.items() if w[2] > rows and (w[3] is None or w[3] < w[4])}
        if not wide:
            break
        near = known.join(F.broadcast(frame()), by).where(inside).groupBy(by, "share").agg(F.percentile_approx("x", F.array(*(F.lit(k / 200) for k in range(201))), accuracy).alias("marks")).collect()  # 201 numbers a group and share
        for r in near:
            if (k := (r[by], r["share"])) in wide:
                rank, below, n, _, _ = wanted[k]
                at = (rank - below) / n * 200
                wanted[k] = (rank, below, n, r["marks"][max(0, math.floor(at) - 1)], r["marks"][min(200, math.ceil(at) + 1)])
        counts = known.join(F.broadcast(frame()), by).groupBy(by, "share").agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.count_if(inside).alias("inside")).collect()
        for r in counts:
            k = (r[by], r["share"])
            rank, _, _, low, high = wanted[k]
            if k in wide:
                fits = r["below"] < rank <= r["below"] + r["inside"]
                wanted[k] = (rank, r["below"], r["inside"], low, high) if fits else (rank, 0, wanted[k][2], None, None)
    order = Window.partitionBy(by, "share").orderBy("x")
    below = {k: w[1] for k, w in wanted.items()}
    started = spark.createDataFrame([(g, p, b, w[0], n) for (g, p), b in below.items() for w in [wanted[g, p]] for n in [dict(sizes)[g]]], f"{by} {kind}, share double, below long, rank long, n long")
    ranked = known.join(F.broadcast(frame().drop("rank")), by).where(inside).groupBy(by, "share", "x").agg(F.count("*").alias("c")).join(F.broadcast(started), [by, "share"]).withColumn("upto", F.col("below") + F.sum("c").over(order))
    return ranked.where(F.col("upto") >= F.col("rank")).groupBy(by, "share").agg(F.min("x").alias(value), F.max("n").alias("n"))


def latency(samples: DataFrame, stages: list[str]) -> DataFrame:
    """Nearest-rank P50 and P95 of complete samples by stage, with the counts of 429 and degraded runs."""
    ok = samples.where(" and ".join(["status = 200", *(f"{s} is not null" for s in stages)]))
    long = ok.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("v")) for s in stages))).alias("x")).select("x.*")
    counts = samples.agg(F.count_if(F.col("status") == 429).alias("limited"), F.count_if(F.coalesce("degraded", F.lit(False))).alias("degraded"))
    ranks = nearest_rank(long, [0.5, 0.95])
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("v")))
    return ranks.groupBy("stage").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95")).join(F.broadcast(counts), how="cross")


def compare(runs: DataFrame, before: str, after: str, rates: list[str]) -> DataFrame:
    """A row a rate of runs(run, rates...): both values, the change in points, and the verdict of the guardrail."""
    if runs.select("run").distinct().limit(2).count() < 2:
        raise ValueError("a comparison needs two runs")
    long = runs.select("run", F.explode(F.array(*(F.struct(F.lit(r).alias("metric"), F.col(r).cast("double").alias("v")) for r in rates))).alias("x")).select("run", "x.*")
    both = long.groupBy("metric").agg(F.max(F.when(F.col("run") == before, F.col("v"))).alias("before"), F.max(F.when(F.col("run") == after, F.col("v"))).alias("after"))
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull(), "undecidable").when((F.col("before") == 0) & (F.col("after") == 0), "no information").when(F.col("after") < F.col("before"), "fail").otherwise("pass")
    return both.withColumn("points", (F.col("after") - F.col("before")) * 100).withColumn("verdict", verdict)


def moves(before: DataFrame, after: DataFrame, hit: str = "fact_hit") -> DataFrame:
    """Items that lost or gained a hit between two runs (item, hit)."""
    both = before.select("item", F.col(hit).alias("was")).join(after.select("item", F.col(hit).alias("now")), "item")
    return both.where(F.col("was") != F.col("now")).select("item", F.when(F.col("now"), "gained").otherwise("lost").alias("move"))


def memory_guardrail(before: DataFrame, after: DataFrame) -> DataFrame:
    """The guardrail on mean coverage of two runs (item, answer, coverage), and whether all answers are the same."""
    both = before.select("item", F.col("answer").alias("a"), F.col("coverage").alias("ca")).join(after.select("item", F.col("answer").alias("b"), F.col("coverage").alias("cb")), "item")
    one = both.agg(F.avg("ca").alias("before"), F.avg("cb").alias("after"), F.every(F.col("a").eqNullSafe(F.col("b"))).alias("identical"))
    return one.withColumn("verdict", F.when(F.col("before").isNull() | F.col("after").isNull(), "undecidable").when((F.col("before") == 0) & (F.col("after") == 0), "no information").when(F.col("after") < F.col("before"), "fail").otherwise("pass"))


def against_targets(metrics: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """metrics(metric, value) against their lines; an unknown value reaches nothing and stays unknown."""
    lines = metrics.sparkSession.createDataFrame(sorted((targets or TARGETS).items()), "metric string, target double")
    return F.broadcast(lines).join(metrics, "metric", "left").select("metric", "target", "value", (F.col("value") >= F.col("target")).alias("reached"))


def supported_ratio(claims: DataFrame, by: list[str]) -> DataFrame:
    """Supported claims over claims (claim null: the text gave none); none from a text is unavailable."""
    return claims.groupBy(*by).agg((F.count_if(F.col("claim").isNotNull() & F.col("supported")) / F.nullif(F.count("claim"), F.lit(0))).alias("ratio"))


def relevancy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean cosine of the question's vector and those of generated questions."""
    return pairs.groupBy(*by).agg(F.avg(text.cosine(F.col("question_vector"), F.col("generated_vector"))).alias("relevancy"))


def context_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """Average precision of useful contexts (rank, useful); none useful is 0."""
    order = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("at", F.sum(F.col("useful").cast("int")).over(order) / F.count("*").over(order))
    return ranked.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("useful"), F.col("at"))), F.lit(0.0)).alias("precision"))


def judge(rows: DataFrame, key: str, score: Callable[[dict], float]) -> DataFrame:
    """A judge on positives only; a failure is recorded with its item and the others go on."""

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                try:
                    out.append((r[key], float(score(r)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "score", "error"]).astype({"score": "float64"})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(~F.coalesce("negative", F.lit(False))).mapInPandas(task, f"{key} {kind}, score double, error string")
