"""Rates on a corpus with one dominant and one rare domain, and the warning for targets out of reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmeter.llm import mixing


def members(spark, counts, sharp=0.96):
    k = len(counts)
    rows = [(100.0, 1, [sharp if i == d else (1 - sharp) / (k - 1) for i in range(k)]) for d, n in enumerate(counts) for _ in range(n)]
    return spark.createDataFrame(rows, "n_tokens double, times int, p array<double>")


def left(df, targets):
    fit = mixing.Fit(df.withColumn("r", F.lit(1.0)), targets, mixing.Settings())
    got = fit.run().toPandas()
    p, n, r = np.stack(got["p"]), got["n_tokens"].to_numpy(), got["r"].to_numpy()
    off = np.abs((p * (n * r)[:, None]).sum(0) / n.sum() - targets).max()
    assert abs(off - fit.left) < 1e-9
    return off


def test_a_domain_with_a_hundredth_of_the_largest_meets_its_target(spark):
    assert left(members(spark, [1000, 300, 10], 0.995), [0.4, 0.3, 0.3]) <= 1e-4


def test_targets_out_of_reach_are_reported(spark):
    with pytest.warns(UserWarning, match="targets are not met"):
        assert left(members(spark, [300, 30, 10], 0.6), [0.98, 0.01, 0.01]) > 1e-4


def test_texts_are_not_carried_beside_their_words(spark, capsys):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, None)], "doc_id long, text string")
    weights = spark.createDataFrame([(c, [-8.0, -9.0]) for c in range(4096)], "cell int, weights array<double>")
    found = mixing.posteriors(docs, weights, [-0.7, -0.7], mixing.Settings())
    assert [(r["doc_id"], r["n_tokens"], r["times"]) for r in found.orderBy("doc_id").collect()] == [(1, 2.0, 2), (2, 0.0, 1)]
    found.explain()
    generate = next(line for line in capsys.readouterr().out.splitlines() if "Generate posexplode" in line)
    assert "text#" not in generate.split("),", 1)[1]
