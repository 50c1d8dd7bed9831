"""Combine the models of many groups into one, and iterate the combination over rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.selection import exact_median

# Server optimiser settings and the default proximal strength.
ADAM = {"eta": 1e-3, "beta1": 0.9, "beta2": 0.99, "tau": 1e-9}
PROX_MU = 0.1


def resize_coef(models: DataFrame, p: int, col: str = "coef") -> DataFrame:
    """Cut the coefficients to `p` entries or pad them with zeros."""
    at = F.transform(
        F.sequence(F.lit(1), F.lit(p)), lambda i: F.coalesce(F.try_element_at(F.col(col), i), F.lit(0.0))
    )
    return models.withColumn(col, at)


def entries(models: DataFrame, by: Sequence[str] = ("mu",)) -> DataFrame:
    """Rows (by..., n_train, trainable, pos, value): one per coefficient; the intercept has the last position."""
    keep = [c for c in ("n_train", "trainable") if c in models.columns]
    return models.select(
        *by, *keep, F.posexplode(F.concat("coef", F.array("intercept"))).alias("pos", "value")
    )


def combine_mean(models: DataFrame, by: Sequence[str] = ("mu",)) -> DataFrame:
    """Rows (by..., pos, value): mean of the models weighted by their training rows."""
    return (
        entries(models, by)
        .groupBy(*by, "pos")
        .agg((F.sum(F.col("n_train") * F.col("value")) / F.sum("n_train")).alias("value"))
    )


def combine_median(models: DataFrame, by: Sequence[str] = ("mu",)) -> DataFrame:
    """Rows (by..., pos, value): coordinate-wise median, every model counting once."""
    return exact_median(entries(models, by), [*by, "pos"], "value", "value").select(*by, "pos", "value")


def initial_model(models: DataFrame, key: str = "client_id", by: Sequence[str] = ("mu",)) -> DataFrame:
    """Rows (by..., pos, value): the model of the first group in key order."""
    first = models.groupBy(*by).agg(F.min_by(F.struct("coef", "intercept"), key).alias("__m"))
    return entries(first.select(*by, "__m.*"), by)


def mean_rounds(targets: DataFrame, start: DataFrame, rounds: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., round, pos, value) of repeated averaging.

    `targets` has the mean of the trainable groups (`value`) and the share of training rows held by
    the others (`idle`), which return the model they were given.
    """
    joined = targets.join(start.withColumnRenamed("value", "start"), [*by, "pos"])
    gap = F.col("start") - F.col("value")
    return joined.select(*by, "pos", "value", gap.alias("gap"), "idle", round_numbers(rounds)).select(
        *by, "round", "pos", (F.col("value") + F.pow(F.col("idle"), F.col("round")) * F.col("gap")).alias("value")
    )


def round_numbers(rounds: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")


def combine_adam(
    targets: DataFrame,
    start: DataFrame,
    rounds: int,
    by: Sequence[str] = (),
    eta: float = ADAM["eta"],
    beta1: float = ADAM["beta1"],
    beta2: float = ADAM["beta2"],
    tau: float = ADAM["tau"],
    bias_correction: bool = False,
) -> DataFrame:
    """Rows (by..., round, pos, value): adaptive server steps from `start` towards the mean model.

    Every coordinate follows its own recurrence, folded over the rounds inside one expression.
    Idle groups (see `mean_rounds`) pull towards the current model, which shortens the difference.
    """
    joined = targets.join(start.withColumnRenamed("value", "start"), [*by, "pos"])
    zero = F.lit(0.0)
    begin = F.struct(
        F.col("start").alias("x"), zero.alias("m"), zero.alias("v"), F.array().cast("array<double>").alias("path")
    )

    def step(acc: Column, r: Column) -> Column:
        delta = (1 - F.col("idle")) * (F.col("value") - acc["x"])
        m = beta1 * acc["m"] + (1 - beta1) * delta
        v = beta2 * acc["v"] + (1 - beta2) * delta * delta
        rate: Column = F.lit(eta)
        if bias_correction:
            t = r.cast("double") + 1
            rate = rate * F.sqrt(1 - F.pow(F.lit(beta2), t)) / (1 - F.pow(F.lit(beta1), t))
        x = acc["x"] + rate * m / (F.sqrt(v) + tau)
        return F.struct(x.alias("x"), m.alias("m"), v.alias("v"), F.concat(acc["path"], F.array(x)).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda acc: acc["path"])
    return joined.select(*by, "pos", F.posexplode(path).alias("r", "value")).select(
        *by, (F.col("r") + 1).alias("round"), "pos", "value"
    )


def mean_targets(models: DataFrame, by: Sequence[str] = ("mu",)) -> DataFrame:
    """Rows (by..., pos, value, idle): mean of the trainable groups and the idle share of the training rows."""
    rows = entries(models, by)
    active = F.when(F.col("trainable"), F.col("n_train")).otherwise(0)
    return (
        rows.groupBy(*by, "pos")
        .agg(F.sum(active * F.col("value")).alias("s"), F.sum(active).alias("a"), F.sum("n_train").alias("n"))
        .select(
            *by,
            "pos",
            F.when(F.col("a") > 0, F.col("s") / F.col("a")).otherwise(F.lit(0.0)).alias("value"),
            F.when(F.col("n") > 0, 1 - F.col("a") / F.col("n")).otherwise(F.lit(1.0)).alias("idle"),
        )
    )


def median_round(models: DataFrame, current: Sequence[float] | None = None, by: Sequence[str] = ("mu",)) -> DataFrame:
    """One round of the median; idle groups answer with the `current` model (p + 1 values)."""
    rows = entries(models, by)
    if current is not None:
        echo = F.lit([float(v) for v in current])[F.col("pos")]
        rows = rows.withColumn("value", F.when(F.col("trainable"), F.col("value")).otherwise(echo))
    return exact_median(rows, [*by, "pos"], "value", "value").select(*by, "pos", "value")


def as_models(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by..., beta): coefficients in position order, intercept last. A model has p + 1 entries."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return values.groupBy(*by).agg(F.transform(pairs, lambda e: e["value"]).alias("beta"))
