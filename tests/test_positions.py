"""Consecutive ids by position against a sort."""

from __future__ import annotations

import random

from cohortwise.operators.positions import with_positions
from pyspark.sql import functions as F


def test_positions_are_places_in_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, k) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "v long, k long").repartition(7)
    got = [tuple(r) for r in with_positions(frame, [F.col("v").desc(), "k"], "at").collect()]
    wanted = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(wanted)]


def test_equal_rows_are_spread_and_numbered_once(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("v")).repartition(6)
    placed = with_positions(frame, ["v"])
    assert sorted(r.position for r in placed.collect()) == list(range(20_000))
    assert placed.collect() == placed.collect()
    sizes = with_positions(frame.withColumn("part", F.spark_partition_id()), ["v"])
    assert sizes.columns == ["v", "part", "position"]


def test_no_rows(spark):
    assert with_positions(spark.createDataFrame([], "v long"), ["v"]).count() == 0
