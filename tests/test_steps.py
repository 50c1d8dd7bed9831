"""Proximal rounds, budgeted quasi-Newton steps and binned areas against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from cohortwise.operators import grouped_lbfgs, metrics, score_histogram
from cohortwise.plans import proximal, rounds
from pyspark.sql import functions as F

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def train(spark):
    """Half of the rows in one group; `one` has a single class."""
    k = F.col("id")
    noise = [((k * p) % 1009 / 1009.0 - 0.5) for p in (7919, 104729, 1299709, 15485863)]
    df = spark.range(600).select(
        k.alias("id"),
        F.when(k < 20, "one").when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 6).cast("string"))).alias("client_id"),
        *[(2 * n).alias(c) for n, c in zip(noise, COLS, strict=False)],
        F.when(k < 20, 1).otherwise((noise[0] - noise[1] + noise[3] > 0.1).cast("int")).alias("label"),
    )
    df = df.cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def groups(train):
    out = {}
    for r in train.orderBy("id").collect():
        x, y = out.setdefault(r.client_id, ([], []))
        x.append([r[c] for c in COLS] + [1.0])
        y.append(float(r.label))
    return {c: (np.array(x), np.array(y)) for c, (x, y) in out.items()}


def objective(x, y, beta, l2, balanced=True):
    """Loss and gradient; the intercept is the last number."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    z, ridge = x @ beta, np.array([l2] * (len(beta) - 1) + [0.0])
    loss = (w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() + 0.5 * (ridge * beta**2).sum()
    return loss, x.T @ (w * (1 / (1 + np.exp(-z)) - y)) + ridge * beta


@pytest.mark.parametrize("mu", [0.1, 5.0])
def test_local_models_are_optimal_for_their_round(train, groups, mu):
    for center, models, combined in proximal.proximal_models(train, COLS, rounds=3, mu=mu):
        found, total = {}, 0
        for m in models.collect():
            x, y = groups[m.client_id]
            total += len(y)
            beta = np.array([*m.coef, m.intercept]) if m.trainable else np.array(center)
            found[m.client_id] = (len(y), beta)
            if m.trainable:
                _, grad = objective(x, y, beta, 1.0)
                assert np.abs(grad + mu * (beta - np.array(center))).max() < 1e-6
        assert not any(m.trainable for m in models.collect() if m.client_id == "one")
        mean = sum(n * b for n, b in found.values()) / total
        assert np.abs(mean - np.array(combined)).max() < 1e-9


def test_without_pull_the_rounds_are_plain_averages(train):
    path = {(r["round"], r.pos): r.value for r in proximal.proximal_path(train, COLS, rounds=3, mu=0.0).collect()}
    models = rounds.fit_grouped_lr(train, "client_id", COLS)
    plain = rounds.model_paths(models, rounds=3, strategies=("FedAvg",))
    for r in plain.collect():
        assert path[(r["round"], r.pos)] == pytest.approx(r.value, abs=1e-8)
    assert proximal.proximal_path(train.limit(0), COLS).count() == 0


def by_numpy(x, y, start, budget, l2, balanced):
    """The same steps for one group, spelled out with the inverse Hessian as a matrix."""
    beta, trial, moves, turns, steps = start, start, [], [], 0
    loss = grad = move = None
    step = 1.0
    while True:
        new_loss, new_grad = objective(x, y, trial, l2, balanced)
        if loss is None or new_loss <= loss + 1e-4 * step * (grad @ move):
            if loss is not None:
                steps += 1
                s, t = trial - beta, new_grad - grad
                if s @ t > 1e-10 * (s @ s):
                    moves, turns = [*moves, s][-10:], [*turns, t][-10:]
            beta, loss, grad = trial, new_loss, new_grad
            n = len(beta)
            inverse = np.eye(n) * ((moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if moves else 1.0)
            for s, t in zip(moves, turns, strict=True):
                rho = 1 / (t @ s)
                left = np.eye(n) - rho * np.outer(s, t)
                inverse = left @ inverse @ left.T + rho * np.outer(s, s)
            move = -inverse @ grad
            step = 1.0 if moves else min(1.0, 1 / np.linalg.norm(grad))
            if np.abs(grad).max() < 1e-8 or steps >= budget:
                return beta, loss, steps
        else:
            step /= 2
        trial = beta + step * move


@pytest.mark.parametrize(("budget", "l2", "balanced"), [(10, 1.0, True), (4, 0.0, False)])
def test_steps_equal_those_of_each_group_alone(spark, train, groups, budget, l2, balanced):
    start = spark.createDataFrame([("g1", [0.3, -0.2], 0.1), ("hot", [0.1, 0.2, 0.3, 0.4], -0.5)], "client_id string, coef array<double>, intercept double")
    begin = {"g1": [0.3, -0.2, 0.0, 0.1], "hot": [0.1, 0.2, 0.3, -0.5]}
    got = grouped_lbfgs.fit_grouped_lbfgs(train, "client_id", COLS, budget=budget, l2=l2, balanced=balanced, start=start)
    rows = got.collect()
    assert len(rows) == len(groups)
    for m in rows:
        x, y = groups[m.client_id]
        assert m.n_train == len(y)
        if m.client_id == "one":
            assert (m.trainable, m.n_steps, m.coef, m.intercept) == (False, 0, [0.0] * 3, 0.0)
            continue
        beta, loss, steps = by_numpy(x, y, np.array(begin.get(m.client_id, [0.0] * 4)), budget, l2, balanced)
        assert np.abs(np.array([*m.coef, m.intercept]) - beta).max() < 1e-8
        assert (m.n_steps, m.loss) == (steps, pytest.approx(loss))
        assert m.n_steps <= budget
    assert grouped_lbfgs.fit_grouped_lbfgs(train.limit(0), "client_id", COLS).count() == 0


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_binned_area_is_within_its_bound(spark, bins):
    rng = np.random.default_rng(4)
    rows = [(f"g{k % 3}", int(rng.random() < 0.4), float(rng.normal(0.5, 0.4))) for k in range(3_000)]
    rows += [("odd", 1, 0.5), ("odd", 0, None), ("odd", 0, float("nan")), ("flat", 0, 0.3), ("flat", 1, 0.3)]
    df = spark.createDataFrame(rows, "g string, label int, prob double")
    got = {r.g: r for r in score_histogram.binned_auc(df, by=["g"], bins=bins).collect()}
    exact = {r.g: r.auc for r in metrics.auc(df.filter("prob IS NOT NULL AND NOT isnan(prob)"), by=["g"]).collect()}
    assert got["odd"].auc is None
    assert (got["flat"].auc, got["flat"].error_bound) == (0.5, 0.5)
    for g in ("g0", "g1", "g2"):
        assert abs(got[g].auc - exact[g]) <= got[g].error_bound + 1e-12
    if bins == 1000:
        assert got["g0"].error_bound < 0.2
    parts = [score_histogram.score_histogram(df.filter(F.col("label") == k), by=["g"], bins=bins) for k in (0, 1)]
    merged = score_histogram.merge_histograms(parts[0].union(parts[1]), ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, score_histogram.score_histogram(df, by=["g"], bins=bins).collect()))
    assert merged.count() <= 5 * bins


def test_features_are_worked_out_once(spark, tmp_path, monkeypatch):
    """Of all tables that the course models and the reports write, one reads the activity rows."""
    from pyspark.sql import DataFrameWriter

    from cohortwise.plans import catalog

    people = spark.range(240)
    tables = {
        "nation": spark.range(2).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id AS n_regionkey"),
        "customer": people.selectExpr(
            "id AS c_custkey", "id % 2 AS c_nationkey", "'AUTOMOBILE' AS c_mktsegment", "cast(id * 40 AS double) AS c_acctbal"
        ),
        "orders": spark.range(1_200).selectExpr(
            "id AS o_orderkey", "id % 240 AS o_custkey", "if(hash(id) % 2 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority"
        ),
        "lineitem": spark.range(4_800).selectExpr(
            "id % 1200 AS l_orderkey", "id % 17 AS l_partkey", "date_add(date'1995-01-01', cast(pmod(hash(id), 90) AS int)) AS l_shipdate",
            "cast(pmod(hash(id, 1), 50) AS double) AS l_quantity",
        ),
        "events": spark.range(9_600).selectExpr(
            "pmod(hash(id, 2), 240) AS user_id", "element_at(array('click', 'view', 'signup', 'purchase', 'error'), cast(1 + pmod(hash(id), 5) AS int)) AS event_type"
        ),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    read, write = [], DataFrameWriter.parquet

    def counted(self, path, *args, **options):
        read.extend(t for t in ("lineitem", "events") if any(f"/{t}.parquet" in f for f in self._df.inputFiles()))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    monkeypatch.setattr(catalog, "_STORED", {})
    for name, expected in {"course_logit": ["lineitem"], "course_steps": ["lineitem"], "result_long": ["events", "lineitem"]}.items():
        read.clear()
        assert catalog.QUERIES[name](spark, str(tmp_path)).count()
        assert sorted(read) == expected, name
