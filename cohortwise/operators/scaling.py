"""Class weights and standardisation with statistics fitted per group or over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.attach import attach

MACHINE_EPSILON = 2.220446049250313e-16


def class_weights(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., n, n_pos, n_neg, w_pos, w_neg) with weights n / (2 * n_class); NULL for an absent class."""
    n, pos, neg = F.col("n"), F.col("n_pos"), F.col("n_neg")
    return (
        df.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(label) == 1).alias("n_pos"),
            F.count_if(F.col(label) == 0).alias("n_neg"),
        )
        .withColumn("w_pos", F.when(pos > 0, n / (2.0 * pos)))
        .withColumn("w_neg", F.when(neg > 0, n / (2.0 * neg)))
    )


def with_class_weight(
    df: DataFrame, label: str = "label", by: Sequence[str] = (), fit_on: DataFrame | None = None, name: str = "class_weight"
) -> DataFrame:
    """Add the balanced weight of each row's class, counted over `fit_on` (default: all rows)."""
    weights = class_weights(df if fit_on is None else fit_on, label, by).select(
        *by, F.col("w_pos").alias("__w1"), F.col("w_neg").alias("__w0")
    )
    weight = F.when(F.col(label) == 1, F.col("__w1")).otherwise(F.col("__w0"))
    return attach(df, weights, by).withColumn(name, weight).drop("__w1", "__w0")


def scaled(value: Column, mean: Column, std: Column, n: Column) -> Column:
    """(value - mean) / std; a spread no larger than rounding noise counts as 1."""
    noise = n * F.abs(mean) * F.lit(MACHINE_EPSILON)
    return (value.cast("double") - mean) / F.when(std <= noise, F.lit(1.0)).otherwise(std)


def standardise(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit_on: str = "train", is_test: str = "is_test"
) -> DataFrame:
    """Replace the columns by their standardised values (population deviation).

    `fit_on="train"` takes the statistics from rows with `is_test` = 0, `"all"` from every row.
    Groups without training rows are dropped.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on {fit_on!r}")
    base = df.filter(F.col(is_test) == 0) if fit_on == "train" else df
    aggs = [F.count("*").alias("__n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}")]
    stats = base.groupBy(*by).agg(*aggs)
    out = {c: scaled(F.col(c), F.col(f"__m_{c}"), F.col(f"__s_{c}"), F.col("__n")) for c in cols}
    return attach(df, stats, by).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])
