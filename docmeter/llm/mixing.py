"""Mixing to target weights by soft membership, with DataFrame functions only.

A classifier (multinomial naive Bayes over words, hashed to `cells` cells) is learned from a labelled table of domains and
gives every document a posterior over the domains; log-likelihoods are averaged per word, so long texts stay soft too.

Each document gets a nonnegative rate r. The rates minimise half the squared distance between the expected domain totals
sum_i r_i n_i p_ik (n: tokens) and the targets (shares of the total tokens), relative to all tokens, by projected
gradient steps from r = 1. Steps are scaled by 1 / n_i, so that a document's rate follows from its posteriors and not from
its length, and all steps together are the sum of the residuals so far: after each pass the K residuals alone go to the
driver, and every task computes r_i = max(0, ...) step by step from them. The table of posteriors is written once.
Such steps are slow for a domain that is rare beside the largest, so after `steps` of them the K residuals are scaled by the
inverse of the K x K Gram matrix of the documents with a rate over 0, and such a step is halved until the distance falls.
If the targets are not met within `close` even so (they can be out of reach), a warning names the residual that is left.

Null and empty texts have no tokens: their posterior is the prior, they add nothing to the totals. Labels without a target
are not learned from. A domain with a target and no label is known by its prior alone, so its target is seldom met. With no
labelled row every rate is 1. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.decontaminate import words
from docmeter.llm.shared import forget, joined, small_batches, table, written

#: Target shares of tokens by domain (language).
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


@dataclass(frozen=True)
class Settings:
    cells: int = 4096
    sharpness: float = 6.0  # words of evidence that the average log-likelihood counts for
    steps: int = 60
    scaled_steps: int = 60  # passes at most with steps scaled by the Gram matrix
    rewrite: int = 16  # steps after which the rates are written
    close: float = 1e-4  # relative distance to the targets at which the steps end


def _cell(word: F.Column, s: Settings) -> F.Column:
    return F.pmod(F.xxhash64(word), F.lit(s.cells)).cast("int")


def classifier(documents: DataFrame, labelled: DataFrame, domains: list[str], s: Settings) -> tuple[DataFrame, list[float]]:
    """labelled(doc_id, domain) -> (cell, weights: array of log-probabilities, one a domain) and the domains' prior logs."""
    train = joined(documents.select("doc_id", "text"), labelled, "doc_id")
    per_word = train.select("domain", F.explode(words("text")).alias("word")).select("domain", _cell(F.col("word"), s).alias("cell"))
    count = per_word.groupBy("cell").agg(*(F.sum((F.col("domain") == d).cast("double")).alias(f"d{k}") for k, d in enumerate(domains)))
    rows = count.collect()  # at most `cells` rows
    total = [sum(r[f"d{k}"] for r in rows) for k in range(len(domains))]
    seen = {r["cell"]: r for r in rows}
    weights = [(c, [math.log(((seen[c][f"d{k}"] if c in seen else 0.0) + 0.5) / (total[k] + 0.5 * s.cells)) for k in range(len(domains))]) for c in range(s.cells)]
    size = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    n = sum(size.values())
    prior = [math.log((size.get(d, 0) + 1) / (n + len(domains))) for d in domains]
    return documents.sparkSession.createDataFrame(weights, "cell int, weights array<double>"), prior


def posteriors(documents: DataFrame, weights: DataFrame, prior: list[float], s: Settings) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, hash, n_tokens, times, p): p sums to 1."""
    k = len(prior)
    # the hash is made before the words are parted: beside posexplode Spark would hash the whole text again for each word
    each = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), words("text").alias("words"))
    docs = each.select("doc_id", "hash", F.posexplode_outer("words").alias("nth", "word"))
    # a text's first word, or the null in place of words, stands for the row
    cells = docs.select("doc_id", "hash", (F.coalesce("nth", F.lit(0)) == 0).cast("int").alias("row"), F.when(F.col("word").isNotNull(), _cell(F.col("word"), s)).alias("cell"))
    met = cells.join(F.broadcast(weights.select("cell", *(F.col("weights")[i].alias(f"l{i}") for i in range(k)))), "cell", "left")  # `cells` rows
    summed = met.groupBy("doc_id", "hash").agg(F.count("cell").alias("words"), F.sum("row").alias("times"), *(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(k)))
    # repeated rows: their words were counted together
    scaled = F.array(*(F.lit(prior[i]) + F.lit(s.sharpness) * F.col(f"l{i}") / F.greatest("words", F.lit(1)) for i in range(k)))
    top = F.transform("z", lambda z: F.exp(z - F.array_max("z")))
    p = F.transform("e", lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return summed.select("doc_id", "hash", (F.col("words") / F.col("times")).alias("n_tokens"), "times", scaled.alias("z")).withColumn("e", top).select("doc_id", "hash", "n_tokens", "times", p.alias("p"))


def rated(members: DataFrame, residuals: list[list[float]], step: float) -> DataFrame:
    """members(r, p, ...) with r moved by the steps of the given residuals. The steps are data of one row, not part of the plan: Spark compiles it once."""
    if not residuals:
        return members
    row = members.sparkSession.createDataFrame([([[float(step * x) for x in r] for r in residuals],)], "steps array<array<double>>")
    pull = lambda r: F.aggregate(F.zip_with("p", r, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    moved = F.aggregate("steps", F.col("r"), lambda r, x: F.greatest(F.lit(0.0), r + pull(x)))
    return members.join(F.broadcast(row), how="cross").withColumn("r", moved).drop("steps")


class Fit:
    """Rates of members(n_tokens, times, p) that move towards the targets.

    Steps since the last rewrite are a few residuals (K numbers each); every `rewrite` steps the rates are written beside
    the posteriors, so a pass replays at most that many.
    """

    def __init__(self, members: DataFrame, targets: list[float], s: Settings):
        self.members, self.targets, self.s, self.k = members, np.array(targets), s, len(targets)
        self.residuals: list[list[float]] = []
        self.step, self.total, self.left = 1.0, 0.0, 0.0

    def measured(self, scaled: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """What is missing to the targets, and for scaled steps the Gram matrix of the documents with a rate over 0."""
        n, k = F.col("n_tokens") * F.col("times"), self.k
        kept = F.when(F.col("r") > 0, n).otherwise(0.0)
        grams = [F.sum(kept * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k) if scaled]
        row = rated(self.members, self.residuals, self.step).agg(*(F.sum(F.col("r") * n * F.col("p")[i]).alias(f"t{i}") for i in range(k)), *grams).first()
        off = self.targets - np.array([row[f"t{i}"] for i in range(k)]) / self.total
        return off, np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)]) / self.total if scaled else None

    def rewrite(self, least: int) -> None:
        if len(self.residuals) >= max(1, least):
            before, self.members = self.members, written(rated(self.members, self.residuals, self.step), "members")
            self.residuals = []
            if hasattr(before, "written_to"):
                forget(before)

    def run(self) -> DataFrame:
        """members(..., r) with the fitted rates; `left` is the largest distance to a target, in shares of all tokens."""
        n, k, s = F.col("n_tokens") * F.col("times"), self.k, self.s
        gram = [[F.sum(n * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for j in range(k)] for i in range(k)]
        first = self.members.agg(F.sum(n).alias("n"), *(g for row in gram for g in row)).first()
        self.total = first["n"] or 0.0
        if not self.total:
            return self.members
        # the largest eigenvalue is at most the largest row sum
        self.step = 1.0 / max(sum(first[f"g{i}_{j}"] for j in range(k)) / self.total for i in range(k))
        off, gram_ = self.measured(False)
        for nth in range(s.steps):
            if np.abs(off).max() <= s.close:
                break
            self.residuals.append(off.tolist())
            self.rewrite(s.rewrite)
            off, gram_ = self.measured(nth == s.steps - 1)
        if gram_ is not None:
            off = self.scaled(off, gram_)
        self.left = float(np.abs(off).max())
        if self.left > s.close:
            warnings.warn(f"mixing: the targets are not met; left residuals {[round(float(x), 6) for x in off]} of all tokens", stacklevel=3)
        self.rewrite(1)
        return self.members

    def scaled(self, off: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Further steps, scaled by the Gram matrix and halved until they come nearer."""
        s, share, pull = self.s, 1.0, np.linalg.lstsq(gram, off, rcond=1e-9)[0]
        for _ in range(s.scaled_steps):
            if np.abs(off).max() <= s.close or share < 1e-4:
                break
            self.rewrite(s.rewrite)
            self.residuals.append((share * pull / self.step).tolist())
            new, gram = self.measured(True)
            if new @ new < off @ off:
                off, share, pull = new, min(1.0, 2 * share), np.linalg.lstsq(gram, new, rcond=1e-9)[0]
            else:
                self.residuals.pop()
                share /= 2
        return off


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """documents (doc_id, text) -> (doc_id, n_tokens, p, rate, off_target), a row a document; labelled(doc_id, domain).

    off_target, the same in every row, is the largest distance of an expected share from its target: over `close`, the
    documents cannot meet the targets.
    """
    small_batches(documents.sparkSession)
    domains = sorted(targets)
    known = labelled.where("doc_id is not null").where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    share = sum(targets.values())
    weights, prior = classifier(documents, known, domains, s)
    fit = Fit(written(posteriors(documents, weights, prior, s).withColumn("r", F.lit(1.0)), "members"), [targets[d] / share for d in domains], s)
    members = fit.members if known.isEmpty() else fit.run()
    return members.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "p", F.col("r").alias("rate"), F.lit(fit.left).alias("off_target"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")).drop("one")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the languages' expected shares of tokens to TARGETS.

    The labelled table: the documents that `labels` lists, with their language as domain.
    """
    documents = table(spark, sf_dir, "documents")
    listed = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id").distinct()
    labelled = joined(documents.where("lang is not null").select("doc_id", F.col("lang").alias("domain")), listed, "doc_id", "left_semi")
    found = mix(documents, labelled, TARGETS)
    return found.select("doc_id", "n_tokens", *(F.round(F.col("p")[k], 9).alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))), F.round("rate", 9).alias("rate"))
