"""Rows bucketed by group: the same models, and steps that leave the rows where they are."""

from __future__ import annotations

import re

import pytest
from cohortwise.operators import grouped_lbfgs, grouped_lr, layout
from cohortwise.session import materialise
from pyspark.sql import functions as F

COLS = ["x0", "x1"]


@pytest.fixture(scope="module")
def train(spark):
    """Group `hot` has half of the rows; `one` has a single class."""
    k = F.col("id")
    noise = [((k * p) % 1009 / 1009.0 - 0.5) for p in (7919, 104729, 1299709)]
    rows = spark.range(4_000).select(
        F.when(k < 20, "one").when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 30).cast("string"))).alias("client_id"),
        *[(2 * n).alias(c) for n, c in zip(noise, COLS)],
        F.when(k < 20, 1).otherwise((noise[0] - noise[1] + noise[2] > 0.1).cast("int")).alias("label"),
    )
    return materialise(rows, "train")


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def laid_out(train):
    sizes = materialise(train.groupBy("client_id").agg(F.count("*").alias("n_train")), "sizes")
    return layout.by_group(train, "client_id", sizes, 1, 3)


def table_of_groups(train):
    return materialise(train.select("client_id").distinct().withColumn("v", F.length("client_id")), "table")


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()  # adaptive plans are final only after a run
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_not_laid_out(train):
    assert laid_out(train).rows is train


def test_no_row_is_lost_or_repeated(spark, train, no_broadcast):
    got = laid_out(train)
    assert got.salts is not None and got.rows.count() == train.count()
    spread = got.salts.filter("client_id = 'hot'").first()["__n_salts"]
    assert spread >= 4 and got.salts.filter("client_id = 'one'").first()["__n_salts"] == 1
    joined = got.with_groups(table_of_groups(train))
    assert joined.columns == [*train.columns, "v"]
    assert joined.select(train.columns).exceptAll(train).isEmpty() and joined.count() == train.count()
    assert joined.filter(F.col("v") != F.length("client_id")).isEmpty()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cohortwise_")]


def test_buckets_are_even(train, no_broadcast):
    got = laid_out(train).rows
    files = got.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert files[1] == 4_000 and files[0] < 2_000  # the hot group alone has 1,990


def test_a_step_does_not_move_the_rows(train, no_broadcast):
    joined = laid_out(train).with_groups(table_of_groups(train))
    plan = final_plan(joined)
    assert "ShuffledHashJoin" in plan
    # the scan with the features is read bucketed, and nothing between it and the join exchanges
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "x0#" in line)
    assert "Bucketed: true" in scan
    depth = len(re.match(r"[ :+\-|*()\d]*", scan)[0])
    above = []
    for line in reversed(plan.splitlines()[: plan.splitlines().index(scan)]):
        own = len(re.match(r"[ :+\-|*()\d]*", line)[0])
        if own < depth:
            depth = own
            above.append(line)
    assert above and not any("Exchange" in line for line in above)


def test_models_are_the_same(spark, train, no_broadcast):
    laid = grouped_lr.fit_grouped_lr(train, "client_id", COLS, mus=(0.0, 0.5)).collect()
    steps = grouped_lbfgs.fit_grouped_lbfgs(train, "client_id", COLS, budget=5).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    plain = grouped_lr.fit_grouped_lr(train, "client_id", COLS, mus=(0.0, 0.5)).collect()
    plain_steps = grouped_lbfgs.fit_grouped_lbfgs(train, "client_id", COLS, budget=5).collect()
    assert len(laid) == len(plain) > 4 and len(steps) == len(plain_steps)
    for got, want in ((laid, plain), (steps, plain_steps)):
        known = {(r["client_id"], r.asDict().get("mu")): r for r in want}
        for r in got:
            other = known[r["client_id"], r.asDict().get("mu")]
            assert r["coef"] == pytest.approx(other["coef"], abs=1e-9) and r["n_train"] == other["n_train"]
            assert r["intercept"] == pytest.approx(other["intercept"], abs=1e-9)
