"""Grouped regression, combination rules, rounds and result tables."""

from __future__ import annotations

import threading
from types import SimpleNamespace

import numpy as np
import pytest
from cohortwise.operators import combining, grouped_lr, pooled
from cohortwise.plans import catalog, prepare, results, rounds
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Observation
from pyspark.sql import functions as F

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def train(spark):
    """Half of the rows in one group; `one` has a single class."""
    k = F.col("id")
    noise = [((k * p) % 1009 / 1009.0 - 0.5) for p in (7919, 104729, 1299709, 15485863)]
    df = spark.range(1200).select(
        k.alias("id"),
        F.when(k < 20, "one").when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 6).cast("string"))).alias("client_id"),
        *[(2 * n).alias(c) for n, c in zip(noise, COLS)],
        F.when(k < 20, 1).otherwise((noise[0] - noise[1] + noise[3] > 0.1).cast("int")).alias("label"),
    )
    df = df.cache()
    yield df
    df.unpersist()


def arrays(df, client):
    rows = df.filter(F.col("client_id") == client).orderBy("id").collect()
    return np.array([[r[c] for c in COLS] for r in rows]), np.array([r["label"] for r in rows], dtype=float)


def gradient(x, y, coef, intercept, l2):
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    r = w * (1 / (1 + np.exp(-(x @ coef + intercept))) - y)
    return np.append(x.T @ r + l2 * coef, r.sum())


@pytest.fixture(scope="module")
def models(train):
    return grouped_lr.fit_grouped_lr(train, "client_id", COLS, mus=(0.0, 0.1, 1.0)).collect()


def test_optimality(train, models):
    assert len(models) == 3 * 5
    for m in models:
        if m["client_id"] == "one":
            assert not m["trainable"] and m["coef"] == [0.0] * 3 and m["intercept"] == 0.0 and m["n_train"] == 20
            continue
        x, y = arrays(train, m["client_id"])
        assert m["converged"] and m["n_train"] == len(y)
        assert np.abs(gradient(x, y, np.array(m["coef"]), m["intercept"], 1 + m["mu"])).max() < 1e-6


def test_equals_mllib(train, models):
    mine = next(m for m in models if m["client_id"] == "hot" and m["mu"] == 0.1)
    rows = pooled.assemble(train.filter("client_id = 'hot'"), COLS)
    n = rows.count()
    pos = rows.filter("label = 1").count()
    rows = rows.withColumn("w", F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    lr = LogisticRegression(regParam=1.1 / n, standardization=False, weightCol="w", tol=1e-12, maxIter=500).fit(rows)
    assert np.allclose(mine["coef"], lr.coefficients.toArray(), atol=1e-5)
    assert mine["intercept"] == pytest.approx(lr.intercept, abs=1e-5)


def test_separable_without_penalty_stops(spark):
    df = spark.createDataFrame([("a", float(i), int(i > 4)) for i in range(10)], "client_id string, x double, label int")
    m = grouped_lr.fit_grouped_lr(df, "client_id", ["x"], l2=0.0, balanced=False, max_iter=10).first()
    assert np.isfinite(m["coef"][0]) and m["coef"][0] > 1 and m["n_iter"] == 10


def model_frame(spark, rows):
    return spark.createDataFrame(
        rows, "client_id string, mu double, coef array<double>, intercept double, n_train long, trainable boolean"
    )


def vector(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_combination_rules(spark):
    one = model_frame(spark, [("a", 0.0, [1.0, -2.0], 3.0, 7, True)])
    assert vector(combining.combine_mean(one)) == [1.0, -2.0, 3.0]
    data = [("c", 0.0, [1.0, 2.0], 3.0, 10, True), ("b", 0.0, [3.0, 9.0], 0.0, 30, True), ("d", 0.0, [8.0, 4.0], 6.0, 10, True)]
    many = model_frame(spark, data)
    assert vector(combining.combine_mean(many)) == pytest.approx([3.6, 6.6, 1.8])
    assert vector(combining.combine_median(many)) == [3.0, 4.0, 3.0]
    assert vector(combining.combine_median(model_frame(spark, data[:2]))) == [2.0, 5.5, 1.5]
    assert vector(combining.initial_model(many)) == [3.0, 9.0, 0.0]
    wide = combining.resize_coef(many, 3).filter("client_id = 'b'").first()["coef"]
    narrow = combining.resize_coef(many, 1).filter("client_id = 'b'").first()["coef"]
    assert (wide, narrow) == ([3.0, 9.0, 0.0], [3.0])


@pytest.mark.parametrize("bias", [False, True])
def test_paths_with_idle_groups(spark, bias):
    """Idle groups return the model they were given; simulate every round."""
    data = [("a", 0.0, [1.0], -1.0, 10, True), ("b", 0.0, [4.0], 2.0, 30, True), ("c", 0.0, [0.0], 0.0, 20, False)]
    paths = rounds.model_paths(model_frame(spark, data), rounds=4, strategies=("FedAvg", "FedAdam", "FedMedian"), bias_correction=bias)
    got = {(r["strategy"], r["round"], r["pos"]): r["value"] for r in paths.collect()}
    start = np.array([1.0, -1.0])
    local = [(np.array([*c, b]), n, t) for _, _, c, b, n, t in data]

    def answers(now):
        return [w if t else now for w, _, t in local]

    def mean(now):
        return sum(n * w for w, (_, n, _) in zip(answers(now), local)) / 60

    avg, med, x, m, v = start, start, start, 0.0, 0.0
    for t in range(1, 5):
        avg, med = mean(avg), np.median(answers(med), axis=0)
        delta = mean(x) - x
        m, v = 0.9 * m + 0.1 * delta, 0.99 * v + 0.01 * delta**2
        rate = 1e-3 * (np.sqrt(1 - 0.99 ** (t + 1)) / (1 - 0.9 ** (t + 1)) if bias else 1.0)
        x = x + rate * m / (np.sqrt(v) + 1e-9)
        for name, want in (("FedAvg", avg), ("FedMedian", med), ("FedAdam", x)):
            assert [got[(name, t, p)] for p in (0, 1)] == pytest.approx(list(want), abs=1e-12)


@pytest.fixture(scope="module")
def history(train):
    rows = prepare.client_rows(train, COLS, id_col="id")
    return rounds.run_rounds(rows, COLS, rounds=3, sweep=(0.1, 1.0)).cache()


def test_rounds(train, history):
    got = {(r["strategy"], r["mu"], r["round"]): r for r in history.collect()}
    assert len(got) == 5 * 3 and all(r["n_clients"] == 5 for r in got.values())
    assert 0.5 < got[("FedAvg", 0.0, 3)]["auc"] < 1
    assert results.best_strategy(results.strategy_finals(results.final_rounds(history, by=["strategy", "mu"])), by=[]).first()["strategy"] in rounds.STRATEGIES
    status = {r["strategy"]: r["status"] for r in rounds.round_completeness(history, 4, by=[]).collect()}
    assert set(status.values()) == {"incomplete"}
    assert rounds.client_status(train, min_rows=21).first()["n_clients"] == 4


def test_rounds_without_groups_are_empty(train):
    rows = prepare.client_rows(train, COLS, id_col="id", min_rows=10_000)
    assert rounds.run_rounds(rows, COLS, rounds=2, strategies=("FedAvg",)).count() == 0
    single = prepare.client_rows(train.filter("client_id = 'hot'"), COLS, id_col="id")
    assert rounds.run_rounds(single, COLS, rounds=2).count() == 0
    assert rounds.client_status(train, min_rows=10_000).first()["status"] == "insufficient_clients"


def finals(spark, rows):
    return spark.createDataFrame(rows, "dataset string, strategy string, mu double, auc double")


def test_best_strategy_and_mu(spark):
    zero = finals(spark, [("d", s, 0.0, 0.0) for s in rounds.STRATEGIES])
    assert tuple(results.best_strategy(zero).first()) == ("d", "N/A", 0.0)
    tie = finals(spark, [("d", "FedMedian", 0.0, 0.7), ("d", "FedProx", 0.1, 0.7), ("d", "FedAvg", 0.0, 0.6)])
    assert tuple(results.best_strategy(tie).first()) == ("d", "FedProx", 0.7)
    sweep = finals(spark, [("d", "x", 0.0, 0.9), ("d", "x", 0.1, 0.8), ("d", "x", 0.01, 0.8)])
    assert tuple(results.best_mu(sweep, by=[]).first()) == (0.01, 0.8)
    marks = {r["mu"]: r["note"] for r in results.mu_table(sweep, by=[]).collect()}
    assert marks == {0.0: "reference", 0.01: "best", 0.1: ""}
    assert {r["mu"]: r["is_best"] for r in results.series_mu(sweep, by=[]).collect()} == {0.0: 1, 0.01: 0, 0.1: 0}


def test_round_notes(spark):
    df = spark.createDataFrame([("a", 0.0, r, v) for r, v in ((1, 0.7), (2, 0.70005), (3, 0.72), (4, 0.71))], "strategy string, mu double, round int, auc double")
    notes = [r["note"] for r in results.round_deltas(df, by=["strategy", "mu"]).orderBy("round").collect()]
    assert notes == ["first round", "converged", "+0.0200", "-0.0100"]


def test_compare_models_guard_and_best(spark, train):
    few = train.filter("client_id = 'one'").withColumn("is_test", (F.col("id") % 5 == 0).cast("int"))
    assert pooled.compare_models(few, COLS, pooled.SCALED_MODELS).count() == 0
    df = train.withColumn("is_test", (F.col("id") % 5 == 0).cast("int"))
    small = {k: {**v, **({"numTrees": 3} if k == "RF" else {})} for k, v in pooled.SCALED_MODELS.items() if k != "GBT"}
    rows = pooled.compare_models(df, COLS, small).collect()
    assert [r["model"] for r in rows] == ["LR", "RF"] and sum(r["is_best"] for r in rows) == 1
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n_test"] == 240 for r in rows)


def test_reports_of_two_datasets_stay_apart(spark):
    pooled = spark.createDataFrame(
        [(d, "LR", a, a, a, a, a, True) for d, a in (("one", 0.7), ("two", 0.9))],
        "dataset string, model string, auc double, accuracy double, f1 double, precision double, recall double, is_best boolean",
    )
    finals = spark.createDataFrame(
        [(d, s, a, a, a, a, a) for d, s, a in (("one", "FedAvg", 0.6), ("one", "FedProx", 0.5), ("two", "FedAvg", 0.8), ("two", "FedProx", 0.85))],
        "dataset string, strategy string, auc double, accuracy double, f1 double, precision double, recall double",
    )
    both = results.compare_pooled(pooled, finals, by=["dataset"])
    assert both.count() == 10 and {round(r["diff"], 6) for r in both.collect()} == {-0.1}
    table = results.strategy_table(finals, pooled, by=["dataset"])
    assert {(r["dataset"], r["strategy"], round(r["diff_vs_lr"], 6), r["note"]) for r in table.collect()} == {
        ("one", "FedAvg", -0.1, "best"), ("one", "FedProx", -0.2, ""), ("two", "FedAvg", -0.1, ""), ("two", "FedProx", -0.05, "best"),
    }


def test_default_features_where_none_is_there(spark):
    rows = spark.range(60).select(
        (F.col("id") % 2).cast("string").alias("client_id"), F.col("id").alias("id_student"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.col("id").alias("total_clicks"), (F.col("id") % 7).alias("days_active"),
    )
    got = prepare.client_rows(rows, ["raisedhands"])
    assert {"total_clicks", "days_active"} <= set(got.columns) and "raisedhands" not in got.columns and got.count() == 60
    some = prepare.client_rows(rows, ["days_active", "raisedhands"])
    assert "days_active" in some.columns and "total_clicks" not in some.columns


def test_unconverged_models_are_named(spark):
    models = spark.createDataFrame([("a", True, False), ("b", False, False)], "client_id string, trainable boolean, converged boolean")
    with pytest.warns(UserWarning, match="1 local models"):
        rounds._check_converged(models, "warn")
    with pytest.raises(RuntimeError, match="did not converge"):
        rounds._check_converged(models, "raise")
    rounds._check_converged(models.filter("client_id = 'b'"), "raise")


@pytest.mark.parametrize("kind", ["LR", "RF", "GBT"])
def test_models_score_in_a_session_with_observations(spark, train, kind):
    seen = Observation()
    train.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 1200
    rows = pooled.assemble(train, COLS)
    params = {"LR": {}, "RF": {"numTrees": 3}, "GBT": {"maxIter": 2}}[kind]
    assert pooled.fit_pooled(rows, rows, kind, params).agg(F.count("prob")).first()[0] == 1200


def test_candidates_are_fitted_at_once(spark, train, monkeypatch):
    """Each fit waits until the others have begun."""
    meet, fit = threading.Barrier(3, timeout=60), pooled.fit_pooled
    monkeypatch.setattr(pooled, "fit_pooled", lambda *args: meet.wait() is not None and fit(*args))
    candidates = {"GBT": {"maxIter": 2, "seed": 42}, "LR": {"weighted": True}, "RF": {"numTrees": 3, "seed": 42}}
    df = train.withColumn("is_test", (F.col("id") % 5 == 0).cast("int"))
    rows = pooled.compare_models(df, COLS, candidates).collect()
    assert [r["model"] for r in rows] == ["GBT", "LR", "RF"] and sum(r["is_best"] for r in rows) == 1


def test_reports_train_datasets_and_kinds_at_once(spark, monkeypatch, tmp_path):
    """Rounds and pooled models of both datasets wait until the others have begun; each lands under its dataset."""
    meet, empty = threading.Barrier(4, timeout=60), spark.range(3).withColumn("client_id", F.lit("a"))

    def begun(kind):
        def run(rows, cols, *args, **options):
            meet.wait()
            return spark.range(1).select(F.lit(kind).alias("kind"), F.lit(len(cols)).alias("n_cols"))

        return run

    monkeypatch.setattr(catalog, "_STORED", {})
    monkeypatch.setattr(catalog.features, "engagement_features", lambda df: df)
    monkeypatch.setattr(catalog.prepare, "client_rows", lambda df, cols, **options: df)
    monkeypatch.setattr(catalog.rounds, "run_rounds", begun("rounds"))
    monkeypatch.setattr(catalog, "_pooled", begun("pooled"))
    source = SimpleNamespace(spark=spark, root=str(tmp_path), learners=lambda: empty, xapi=lambda: empty)
    paths = catalog._stored_results(source, full=True)
    for name, kind in (("history", "rounds"), ("pooled", "pooled")):
        rows = spark.read.json(paths[name]).collect()
        assert sorted((r["dataset"], r["kind"], r["n_cols"]) for r in rows) == [("courses", kind, 9), ("engagement", kind, 8)]
