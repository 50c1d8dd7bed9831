"""Area under the ROC curve from a histogram of scores: bounded size, mergeable, with an error bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1000


def score_histogram(
    df: DataFrame,
    label: str = "label",
    score: str = "prob",
    by: Sequence[str] = (),
    bins: int = BINS,
    low: float = 0.0,
    high: float = 1.0,
) -> DataFrame:
    """Rows (by..., bin, n_pos, n_neg): labels counted in `bins` equal bins of [low, high] per group.

    Scores outside belong to the first and the last bin; NULL and NaN scores take no part. Every task
    sends at most `bins` rows a group, whatever its number of rows.
    """
    value = F.col(score).cast("double")
    place = F.floor((value - low) / (high - low) * bins)
    rows = df.filter(value.isNotNull() & ~F.isnan(value))
    return rows.groupBy(*by, F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def merge_histograms(histograms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histograms over parts of the rows, stacked, as one over all of them."""
    return histograms.groupBy(*by, "bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def auc_of_histogram(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., n_pos, n_neg, auc, error_bound).

    Pairs in one bin count one half. The exact area differs by at most `error_bound`, half the share of
    such pairs. Both are NULL for a group with a single class. A group is folded from its bins alone.
    """
    bins = F.array_sort(F.collect_list(F.struct("bin", F.col("n_pos").cast("double"), F.col("n_neg").cast("double"))))
    folded = F.expr(
        """aggregate(bins, named_struct('below', 0.0D, 'pairs', 0.0D, 'ties', 0.0D),
           (acc, x) -> named_struct('below', acc.below + x.n_neg, 'pairs', acc.pairs + x.n_pos * (acc.below + x.n_neg / 2.0D),
                                    'ties', acc.ties + x.n_pos * x.n_neg))"""
    )
    groups = histogram.groupBy(*by).agg(
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        bins.cast("array<struct<bin:int,n_pos:double,n_neg:double>>").alias("bins"),
    )
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    return groups.withColumn("__f", folded).select(
        *by,
        "n_pos",
        "n_neg",
        F.when(both > 0, F.col("__f.pairs") / both).alias("auc"),
        F.when(both > 0, F.col("__f.ties") / (2 * both)).alias("error_bound"),
    )


def binned_auc(
    df: DataFrame,
    label: str = "label",
    score: str = "prob",
    by: Sequence[str] = (),
    bins: int = BINS,
    low: float = 0.0,
    high: float = 1.0,
) -> DataFrame:
    """Rows (by..., n_pos, n_neg, auc, error_bound) from one histogram; no row is exchanged, only bin counts."""
    return auc_of_histogram(score_histogram(df, label, score, by, bins, low, high), by)
