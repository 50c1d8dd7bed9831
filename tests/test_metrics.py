"""AUC and classification metrics against brute force and MLlib."""

from __future__ import annotations


import numpy as np
import pytest
from cohortwise.operators import metrics, profiling
from cohortwise.plans.results import verdict
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F


def pair_auc(pos, neg):
    pos, neg = np.array(pos)[:, None], np.array(neg)[None, :]
    return ((pos > neg).sum() + 0.5 * (pos == neg).sum()) / (pos.size * neg.size)


def scored(spark, n=4000):
    """Half of the rows in one group, tied scores."""
    k = F.col("id")
    return spark.range(n).select(
        F.when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 7).cast("string"))).alias("grp"),
        ((k * 7919) % 211 / 211.0).alias("prob"),
        ((k * 104729) % 10 + (k * 7919) % 211 / 40.0 > 7).cast("int").alias("label"),
    )


def test_auc_equals_all_pairs(spark):
    df = scored(spark).cache()
    rows = df.collect()
    whole = pair_auc([r["prob"] for r in rows if r["label"]], [r["prob"] for r in rows if not r["label"]])
    assert metrics.auc(df).first()["auc"] == pytest.approx(whole, abs=1e-12)
    for parts in (1, 11):
        got = {r["grp"]: r for r in metrics.auc(df.repartition(parts), by=["grp"]).collect()}
        for grp in {r["grp"] for r in rows}:
            pos = [r["prob"] for r in rows if r["grp"] == grp and r["label"]]
            neg = [r["prob"] for r in rows if r["grp"] == grp and not r["label"]]
            assert got[grp]["auc"] == pytest.approx(pair_auc(pos, neg), abs=1e-12)
            assert (got[grp]["n_pos"], got[grp]["n_neg"]) == (len(pos), len(neg))
    df.unpersist()


def test_auc_edges(spark):
    df = spark.createDataFrame(
        [("same", 0.3, 1), ("same", 0.3, 0), ("same", 0.3, 0), ("one", 0.1, 1), ("one", 0.2, 1)],
        "grp string, prob double, label int",
    )
    got = {r["grp"]: r["auc"] for r in metrics.auc(df, by=["grp"]).collect()}
    assert got == {"same": 0.5, "one": None}


def test_zero_denominators_and_degenerate_groups(spark):
    df = spark.createDataFrame(
        [("none", 0.1, 1, 0), ("none", 0.2, 0, 0), ("one", 0.9, 1, 1), ("one", 0.8, 1, 1)],
        "grp string, prob double, label int, pred int",
    )
    got = {r["grp"]: r for r in metrics.evaluate_by_client(df, ["grp"]).collect()}
    none, one = got["none"], got["one"]
    assert (none["precision"], none["f1"], none["recall"], none["accuracy"], none["auc"], none["loss"]) == (0, 0, 0, 0.5, 0, 1)
    assert [one[m] for m in metrics.METRICS] == [0.0] * 5 and one["loss"] == 1.0 and one["n_samples"] == 2
    assert metrics.evaluate_by_client(df, ["grp"], exclude_degenerate=True).count() == 1
    mean = metrics.weighted_round_mean(metrics.evaluate_by_client(df, ["grp"]), []).first()
    assert mean["n_clients"] == 2 and mean["accuracy"] == 0.25


@pytest.mark.parametrize("average", ["binary", "weighted"])
def test_metrics_agree_with_the_evaluator(spark, average):
    df = scored(spark).withColumn("pred", (F.col("prob") > 0.5).cast("int")).cache()
    got = metrics.evaluate(df, average=average).first()
    assert got["tn"] + got["fp"] + got["fn"] + got["tp"] == 4000
    cells = metrics.confusion(df).first()
    assert [got[c] for c in ("tn", "fp", "fn", "tp")] == list(cells)
    evaluator = MulticlassClassificationEvaluator(predictionCol="p", labelCol="l", metricLabel=1.0)
    names = {
        "binary": ("accuracy", "fMeasureByLabel", "precisionByLabel", "recallByLabel"),
        "weighted": ("accuracy", "f1", "weightedPrecision", "weightedRecall"),
    }[average]
    as_double = df.select(F.col("label").cast("double").alias("l"), F.col("pred").cast("double").alias("p"))
    for mine, theirs in zip(("accuracy", "f1", "precision", "recall"), names):
        assert got[mine] == pytest.approx(evaluator.setMetricName(theirs).evaluate(as_double), abs=1e-12)
    if average == "weighted":
        assert got["recall"] == pytest.approx(got["accuracy"], abs=1e-12)
    df.unpersist()


def test_profiles(spark):
    df = spark.createDataFrame([(1, 4.0, "a"), (1, 6.0, "b"), (0, 0.0, "b"), (0, 0.0, "c")], "label int, x double, k string")
    got = {r["metric"]: tuple(r)[1:] for r in profiling.profile_by_label(df, {"x": ("x", 1)}).collect()}
    assert got == {"count": (2.0, 2.0, 0.0, 1.0), "percent": (50.0, 50.0, 0.0, 1.0), "x": (5.0, 0.0, 5.0, 0.0)}
    assert [r["label"] for r in profiling.label_profile(df, {"x": ("x", 1)}).collect()] == [1, 0]
    shares = {r["class"]: r["pct"] for r in profiling.class_distribution(df, "k").collect()}
    assert shares == {"a": 25.0, "b": 50.0, "c": 25.0}


def test_top_k_ties_by_name_and_heterogeneity(spark):
    df = spark.createDataFrame([(n, int(n != "z")) for n in "cabz"], "k string, label int")
    rates = profiling.rate_by_group(df, "k")
    assert [r["k"] for r in profiling.top_k(rates, [F.desc("rate")], 2, ["k"]).collect()] == ["a", "b"]
    got = profiling.heterogeneity(df, "k").first()
    assert got["rate"] == 0.75 and got["cv"] == pytest.approx(np.std([1, 1, 1, 0], ddof=1) / 0.75)


def test_verdict_bounds(spark):
    diffs = [0.0051, 0.005, -0.01, -0.0099]
    df = spark.createDataFrame([(d,) for d in diffs], "d double")
    assert [r[0] for r in df.select(verdict("d")).collect()] == ["better", "comparable", "worse", "comparable"]
