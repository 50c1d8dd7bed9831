"""Outcome profiles, class tables, group rates and selection of the best rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import scalar
from cohortwise.operators.attach import attach


def label_profile(df: DataFrame, metrics: Mapping[str, tuple[str, int]], label: str = "label") -> DataFrame:
    """Row count and rounded means per label, positive label first. `metrics`: output name -> (column, digits)."""
    means = [F.round(F.avg(c), digits).alias(name) for name, (c, digits) in metrics.items()]
    return df.groupBy(label).agg(F.count("*").alias("count"), *means).orderBy(F.desc(label))


def profile_by_label(
    df: DataFrame,
    metrics: Mapping[str, tuple[str, int]],
    by: Sequence[str] = (),
    label: str = "label",
) -> DataFrame:
    """Rows (by..., metric, pos, neg, diff, ratio): rounded group means of each metric and their contrast.

    The metric `count` holds the class sizes and `percent` the class shares. One conditional
    aggregate over the data; the unpivot runs on its few result rows.
    """
    positive, negative = F.col(label) == 1, F.col(label) == 0
    aggs = [F.count_if(positive).alias("__n1"), F.count_if(negative).alias("__n0"), F.count("*").alias("__n")]
    for name, (c, digits) in metrics.items():
        aggs.append(F.round(F.avg(F.when(positive, F.col(c))), digits).alias(f"{name}__1"))
        aggs.append(F.round(F.avg(F.when(negative, F.col(c))), digits).alias(f"{name}__0"))
    wide = df.groupBy(*by).agg(*aggs)

    def line(name: str, pos: Column, neg: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), pos.cast("double").alias("pos"), neg.cast("double").alias("neg"))

    share = F.lit(100.0) / F.col("__n")
    lines = [
        line("count", F.col("__n1"), F.col("__n0")),
        line("percent", F.col("__n1") * share, F.col("__n0") * share),
        *[line(name, F.col(f"{name}__1"), F.col(f"{name}__0")) for name in metrics],
    ]
    return wide.select(*by, F.inline(F.array(*lines))).withColumns(
        {"diff": F.col("pos") - F.col("neg"), "ratio": scalar.safe_ratio("pos", "neg")}
    )


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows (class, n, pct)."""
    counts = df.groupBy(F.col(col).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # an empty table has no class, so its NULL total meets no row
    return attach(counts, total).select("class", "n", (100.0 * F.col("n") / F.col("__total")).alias("pct"))


def rate_by_group(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def heterogeneity(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """One row: number of groups, overall positive rate, and coefficient of variation of the group rates."""
    groups = df.groupBy(key).agg(F.count("*").alias("__n"), F.sum(label).alias("__pos"))
    rate = F.col("__pos") / F.col("__n")
    return groups.agg(
        F.count("*").alias("n_groups"),
        (F.sum("__pos") / F.sum("__n")).alias("rate"),
        (F.stddev_samp(rate) / F.avg(rate)).alias("cv"),
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """First `k` rows of the order, ties by name."""
    return df.orderBy(*order, *[F.asc(c) for c in tiebreak]).limit(k)


def best_by(df: DataFrame, by: Sequence[str], score: str, tiebreak: str) -> DataFrame:
    """The row with the largest score per group; among equal scores the smallest `tiebreak` wins."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tiebreak))).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")
