"""Order statistics, splits and scaling against brute force, with a group that holds most of the rows."""

from __future__ import annotations

import hashlib
import math
import statistics

import numpy as np
import pytest
from cohortwise.operators import scaling, splitting
from cohortwise.operators.selection import exact_median, order_statistics
from pyspark.sql import functions as F


def skewed(spark, n=6000):
    """Group `hot` has half of the rows; `one` has a single class; `tiny` has four rows."""
    k = F.col("id")
    group = (
        F.when(k < 4, "tiny").when(k < 30, "one").when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 9).cast("string")))
    )
    label = F.when(group == "one", 1).otherwise(((k * 7919) % 10 < 3).cast("int"))
    return spark.range(n).select(k.alias("id"), group.alias("grp"), label.alias("label"))


def by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["grp"], []).append(r)
    return out


def half_up(num, den):
    return (2 * num + den) // (2 * den)


def expected_test(rows, fallback):
    """Ids of the test rows by sorting the whole group."""
    n = len(rows)
    n_test = math.ceil(0.2 * n)
    key = {r["id"]: hashlib.md5(f"42|{r['id']}".encode()).hexdigest() for r in rows}
    classes = {c: [r["id"] for r in rows if r["label"] == c] for c in (0, 1)}
    take1 = len(classes[1]) - half_up(len(classes[1]) * (n - n_test), n)
    take = {1: take1, 0: n_test - take1}
    if fallback and (not classes[0] or not classes[1] or n < 5):
        return set(sorted(key)[math.floor(0.8 * n):])
    if fallback and any(len(classes[c]) < 2 or not 1 <= take[c] < len(classes[c]) for c in (0, 1)):
        return set(sorted(key, key=key.get)[:n_test])
    return {i for c in (0, 1) for i in sorted(classes[c], key=key.get)[: take[c]]}


@pytest.mark.parametrize("parts, cell", [(1, 8_192), (13, 8_192), (13, 50), (13, 1)])
def test_stratified_split_equals_a_full_sort(spark, monkeypatch, parts, cell):
    monkeypatch.setattr(splitting, "CELL_ROWS", cell)  # 50: most strata are divided; 1: down to single rows
    df = skewed(spark).repartition(parts).cache()
    got = by_group(splitting.stratified_split(df, "id", by=["grp"], fallback=True))
    assert sum(map(len, got.values())) == 6000
    for rows in got.values():
        assert {r["id"] for r in rows if r["is_test"] == 1} == expected_test(rows, True)
    df.unpersist()


@pytest.mark.parametrize("cell, digits", [(8_192, 3), (50, 1)])
def test_pooled_split_and_sizes(spark, monkeypatch, cell, digits):
    monkeypatch.setattr(splitting, "CELL_ROWS", cell)
    monkeypatch.setattr(splitting, "PASS_DIGITS", digits)  # 1: several passes
    df = skewed(spark)
    rows = splitting.stratified_split(df, "id").collect()
    assert {r["id"] for r in rows if r["is_test"] == 1} == expected_test(rows, False)
    assert sum(r["is_test"] for r in rows) == 1200


@pytest.mark.parametrize("cell", [8_192, 1])
def test_random_fallback_for_a_class_of_one(spark, monkeypatch, cell):
    monkeypatch.setattr(splitting, "CELL_ROWS", cell)
    df = spark.createDataFrame([(i, "a", int(i == 0)) for i in range(10)], "id long, grp string, label int")
    rows = splitting.stratified_split(df, "id", by=["grp"], fallback=True).collect()
    assert {r["id"] for r in rows if r["is_test"] == 1} == expected_test(rows, True) and len(rows) == 10


def test_head_tail_split(spark):
    got = by_group(splitting.head_tail_split(skewed(spark).repartition(7), "id", by=["grp"]))
    for rows in got.values():
        ids = sorted(r["id"] for r in rows)
        assert {r["id"] for r in rows if r["is_test"] == 0} == set(ids[: math.floor(0.8 * len(ids))])
    single = spark.createDataFrame([(1,)], "id long")
    assert splitting.head_tail_split(single, "id").first()["is_test"] == 1


def test_hashed_split_is_stable(spark):
    df = skewed(spark)
    a = {r["id"] for r in splitting.hashed_split(df.repartition(1), "id").filter("is_test = 1").collect()}
    b = {r["id"] for r in splitting.hashed_split(df.repartition(9), "id").filter("is_test = 1").collect()}
    assert a == b and 1000 < len(a) < 1400


def test_order_statistics_with_bracket_and_ties(spark):
    df = skewed(spark).withColumn("v", (F.col("id") * 7919) % 977)
    ranks = {"q": lambda n: F.greatest(F.floor(n * 0.8), F.lit(1))}
    # accuracy far below the group size, so the bracket cuts
    got = {r["grp"]: r for r in order_statistics(df, ["grp"], "v", ranks).collect()}
    medians = {r["grp"]: r for r in exact_median(df, ["grp"], "v").collect()}
    for grp, rows in by_group(df).items():
        values = sorted(r["v"] for r in rows)
        assert got[grp]["q"] == values[max(math.floor(0.8 * len(values)), 1) - 1]
        assert medians[grp]["median"] == statistics.median(values)
    whole = exact_median(df, [], "v").first()
    assert whole["median"] == statistics.median(r["v"] for r in df.collect())


def test_standardise_uses_training_rows(spark):
    data = [("a", 1.0, 5.0, 0), ("a", 3.0, 5.0, 0), ("a", 9.0, 5.0, 1), ("b", 4.0, 0.1, 0), ("b", 4.0, 0.1, 0), ("c", 1.0, 1.0, 1)]
    df = spark.createDataFrame(data, "grp string, x double, y double, is_test int")
    out = scaling.standardise(df, ["x", "y"], by=["grp"])
    got = sorted((r["grp"], r["x"], r["y"]) for r in out.collect())
    assert got == [("a", -1.0, 0.0), ("a", 1.0, 0.0), ("a", 7.0, 0.0), ("b", 0.0, 0.0), ("b", 0.0, 0.0)]
    x = np.array([row[1] for row in data])
    both = [r["x"] for r in scaling.standardise(df, ["x"], fit_on="all").collect()]
    assert np.allclose(sorted(both), sorted((x - x.mean()) / x.std()))


def test_constant_column_spread_over_partitions_stays_zero(spark):
    df = spark.range(1000).select(F.lit("a").alias("grp"), F.lit(0.1).alias("x"), F.lit(0).alias("is_test")).repartition(13)
    top = scaling.standardise(df, ["x"], by=["grp"]).agg(F.max(F.abs("x"))).first()[0]
    assert top < 1e-9


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 1)], "grp string, label int")
    got = {r["grp"]: r for r in scaling.class_weights(df, by=["grp"]).collect()}
    assert (got["a"]["w_pos"], got["a"]["w_neg"]) == (0.75, 1.5)
    assert (got["b"]["w_pos"], got["b"]["w_neg"]) == (0.5, None)
    weighted = scaling.with_class_weight(df)
    assert weighted.agg(F.sum("class_weight")).first()[0] == pytest.approx(4.0)


def test_order_statistics_beyond_doubles(spark):
    """64-bit integers that no double tells apart, in one hot group and small ones, keyed and not."""
    top = 2**60
    df = spark.range(50_000).select((F.col("id") + top).alias("v"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"))
    assert exact_median(df, [], "v").first()["median"] == top + 24_999.5
    got = splitting.head_tail_split(df, "v")
    assert got.filter("is_test = 1").agg(F.count("*"), F.min("v")).first() == (10_000, top + 40_000)
    hot = splitting.head_tail_split(df, "v", ["g"]).filter("g = 0 AND is_test = 0").agg(F.max("v"), F.count("*")).first()
    values = [top + i for i in range(50_000) if i % 3 or i == 0]
    assert hot == (values[int(len(values) * 0.8) - 1], int(len(values) * 0.8))


def test_rows_without_key_or_label_are_in_no_part(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, None if i % 7 == 0 else "g") for i in range(1_000)]
    df = spark.createDataFrame(rows, "id long, label int, g string")
    got = splitting.stratified_split(df, "id", "label", ["g"]).toPandas()
    assert len(got) == 1_000
    outside = got.label.isna() | got.g.isna()
    assert got[outside].is_test.isna().all() and got[~outside].is_test.notna().all()
    for _, part in got[~outside].groupby("label"):
        assert abs(part.is_test.mean() - 0.2) < 0.01


def test_a_hot_class_is_cut_inside_a_small_cell(spark):
    """Ten million rows of one class: under ten thousand of them are sorted."""
    hashed = spark.range(10_000_000).select(F.lit(1).alias("__label"), F.md5(F.col("id").cast("string")).alias("__h"))
    strata = spark.createDataFrame([(1, 10_000_000, 2_000_000)], "__s int, __n_s long, __k long")
    cell = splitting.cut_cells(hashed, strata, []).first()
    assert 0 < cell["__need"] <= cell["__size"] <= splitting.CELL_ROWS and cell["__prefix"]
    below = hashed.filter(F.substring("__h", 1, len(cell["__prefix"])) < cell["__prefix"]).count()
    assert below + cell["__need"] == 2_000_000


def test_copies_of_one_row_end_at_its_full_hash(spark, monkeypatch):
    """A cell of equal hashes cannot be divided: all copies fall on the same side."""
    monkeypatch.setattr(splitting, "CELL_ROWS", 10)
    df = spark.range(300).select(F.greatest(F.col("id"), F.lit(199)).alias("id"), (F.col("id") % 2).cast("int").alias("label"))
    got = splitting.stratified_split(df, "id").groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("is_test").alias("sides"))
    assert got.agg(F.max("sides"), F.sum("n")).first() == (1, 300)
    same = df.withColumn("id", F.lit(7))
    assert splitting.stratified_split(same, "id").agg(F.sum("is_test")).first()[0] == 300
