"""Exact ranking and classification metrics, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("auc", "accuracy", "f1", "precision", "recall")


def _ranking(df: DataFrame, label: str, score: str, by: list[str], pred: str | None = None) -> DataFrame:
    """Rows (by..., n_pos, n_neg, tp, fp, auc) in one pass; tp and fp are 0 without `pred`.

    Rows collapse to one per distinct score before the first shuffle. A range partitioning on
    (group, score) spreads even one huge group over all tasks; every slice reports its totals and the
    pairs within it, and pairs across slices follow from the totals of the earlier slices.
    """
    hit = F.col(pred) == 1 if pred else F.lit(False)
    counts = df.groupBy(*by, F.col(score).alias("__score")).agg(
        F.count_if(F.col(label) == 1).alias("__pos"),
        F.count_if(F.col(label) == 0).alias("__neg"),
        F.count_if((F.col(label) == 1) & hit).alias("__tp"),
        F.count_if((F.col(label) == 0) & hit).alias("__fp"),
    )
    sliced = counts.repartitionByRange(*by, "__score").withColumn("__slice", F.spark_partition_id())
    before = Window.partitionBy(*by, "__slice").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__neg").over(before), F.lit(0))
    totals = ["__pos", "__neg", "__tp", "__fp"]
    slices = (
        sliced.withColumn("__pairs", F.col("__pos") * (below.cast("double") + F.col("__neg") / F.lit(2.0)))
        .groupBy(*by, "__slice")
        .agg(*[F.sum(c).alias(c) for c in [*totals, "__pairs"]])
    )
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__neg").over(earlier), F.lit(0)).cast("double")
    out = (
        slices.withColumn("__pairs", F.col("__pairs") + F.col("__pos") * offset)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in [*totals, "__pairs"]])
    )
    pos, neg = F.col("__pos"), F.col("__neg")
    area = F.when((pos > 0) & (neg > 0), F.col("__pairs") / (pos.cast("double") * neg))
    return out.select(
        *by,
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        F.col("__tp").alias("tp"),
        F.col("__fp").alias("fp"),
        area.alias("auc"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., n_pos, n_neg, auc): exact area under the ROC curve, ties counting one half.

    NULL for a group with a single class.
    """
    return _ranking(df, label, score, list(by)).select(*by, "n_pos", "n_neg", "auc")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., tn, fp, fn, tp)."""

    def cell(actual: int, predicted: int):
        return F.count_if((F.col(label) == actual) & (F.col(pred) == predicted))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def classification_metrics(cells: DataFrame, average: str = "binary") -> DataFrame:
    """Add accuracy, precision, recall, f1, sensitivity and specificity to a confusion table.

    `binary` scores the positive class; `weighted` averages both classes by their frequency.
    A zero denominator gives 0.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    n, pos, neg = tn + fp + fn + tp, tp + fn, tn + fp
    sensitivity, specificity = ratio(tp, pos), ratio(tn, neg)
    p1, p0 = ratio(tp, tp + fp), ratio(tn, tn + fn)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    if average == "binary":
        precision, recall, f = p1, sensitivity, f1
    elif average == "weighted":
        precision = ratio(p1 * pos + p0 * neg, n)
        recall = ratio(sensitivity * pos + specificity * neg, n)
        f = ratio(f1 * pos + f0 * neg, n)
    else:
        raise ValueError(f"unknown average {average!r}")
    return cells.withColumns(
        {
            "accuracy": ratio(tp + tn, n),
            "precision": precision,
            "recall": recall,
            "f1": f,
            "sensitivity": sensitivity,
            "specificity": specificity,
        }
    )


def evaluate(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "prob", pred: str = "pred", average: str = "binary"
) -> DataFrame:
    """Rows (by..., tn, fp, fn, tp, metrics..., auc): AUC and classification metrics per group."""
    cells = _ranking(df, label, score, list(by), pred).select(
        *by,
        (F.col("n_neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("n_pos") - F.col("tp")).alias("fn"),
        "tp",
        "auc",
    )
    return classification_metrics(cells, average)


def evaluate_by_client(
    scored: DataFrame, by: Sequence[str], label: str = "label", exclude_degenerate: bool = False
) -> DataFrame:
    """Rows (by..., loss, n_samples, auc, accuracy, f1, precision, recall) of scored test rows.

    A group whose test rows hold a single class gets loss 1 and zero metrics, or is left out.
    """
    table = evaluate(scored, by, label).withColumn("n_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    valid = F.col("auc").isNotNull()
    if exclude_degenerate:
        table = table.filter(valid)
    values = [F.when(valid, F.col(m)).otherwise(F.lit(0.0)).alias(m) for m in METRICS]
    loss = F.when(valid, 1 - F.col("auc")).otherwise(F.lit(1.0)).alias("loss")
    return table.select(*by, loss, "n_samples", *values)


def weighted_round_mean(client_metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the client metrics weighted by their test rows, with the number of clients."""
    n = F.sum("n_samples")
    means = [
        F.when(n > 0, F.sum(F.col(m) * F.col("n_samples")) / n).otherwise(F.lit(0.0)).alias(m) for m in METRICS
    ]
    return client_metrics.groupBy(*by).agg(F.count("*").alias("n_clients"), *means)
