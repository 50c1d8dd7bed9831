"""Result tables: final scores, comparisons with the pooled models, verdicts and chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.operators.attach import join_small
from cohortwise.operators.cleaning import union_all
from cohortwise.operators.combining import PROX_MU
from cohortwise.operators.metrics import METRICS
from cohortwise.plans.rounds import STRATEGIES

# Thresholds of the verdict and of the convergence note.
BETTER_ABOVE = 0.005
WORSE_UPTO = -0.01
CONVERGED_BELOW = 1e-4
# AUCs that agree to so many digits are equal: sums of floats differ behind that by their order.
TIE_DIGITS = 9

RESULT_COLUMNS = (
    "kind",
    "dataset",
    "n_clients",
    "strategy",
    "auc",
    "f1",
    "precision",
    "recall",
    "n_rounds",
    "diff_vs_lr",
    "mu",
    "note",
)


def _position(c: str, names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))


def final_rounds(history: DataFrame, by: Sequence[str] = ("dataset", "strategy", "mu")) -> DataFrame:
    """The last round of every run, with the number of rounds."""
    rest = [c for c in history.columns if c not in by]
    last = history.groupBy(*by).agg(
        F.max_by(F.struct(*rest), "round").alias("__last"), F.count("*").alias("n_rounds")
    )
    return last.select(*by, *[F.col("__last")[c].alias(c) for c in rest if c != "round"], "n_rounds")


def strategy_finals(finals: DataFrame, prox_mu: float = PROX_MU) -> DataFrame:
    """The runs of the strategy comparison: every strategy at its own strength, without the sweep."""
    return finals.filter((F.col("strategy") != "FedProx") | (F.col("mu") == prox_mu))


def best_strategy(finals: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., strategy, auc): largest final AUC, the earlier strategy on ties; N/A if none is above 0."""
    rank = F.struct(F.round("auc", TIE_DIGITS), -_position("strategy", STRATEGIES))
    pick = F.max_by(F.when(F.col("auc") > 0, F.col("strategy")), F.when(F.col("auc") > 0, rank))
    return finals.groupBy(*by).agg(
        F.coalesce(pick, F.lit("N/A")).alias("strategy"),
        F.coalesce(F.max(F.when(F.col("auc") > 0, F.col("auc"))), F.lit(0.0)).alias("auc"),
    )


def best_mu(sweep: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., mu, auc): largest AUC among the strengths above 0, the smaller one on ties; (0, 0) if none scores."""
    hit = (F.col("mu") > 0) & (F.col("auc") > 0)
    pick = F.max_by(F.when(hit, F.col("mu")), F.when(hit, F.struct(F.round("auc", TIE_DIGITS), -F.col("mu"))))
    return sweep.groupBy(*by).agg(
        F.coalesce(pick, F.lit(0.0)).alias("mu"),
        F.coalesce(F.max(F.when(hit, F.col("auc"))), F.lit(0.0)).alias("auc"),
    )


def round_deltas(
    history: DataFrame, by: Sequence[str] = ("dataset", "strategy", "mu"), eps: float = CONVERGED_BELOW
) -> DataFrame:
    """Rows (by..., round, auc, delta, note): change against the round before. A window holds one run's rounds."""
    change = F.col("auc") - F.lag("auc").over(Window.partitionBy(*by).orderBy("round"))
    delta = F.col("delta")
    note = (
        F.when(delta.isNull(), "first round")
        .when(F.abs(delta) < eps, "converged")
        .otherwise(F.format_string("%+.4f", delta))
    )
    return history.select(*by, "round", "auc", change.alias("delta")).withColumn("note", note)


def verdict(diff: str | Column) -> Column:
    diff = F.col(diff) if isinstance(diff, str) else diff
    return F.when(diff > BETTER_ABOVE, "better").when(diff > WORSE_UPTO, "comparable").otherwise("worse")


def compare_pooled(
    pooled: DataFrame, finals: DataFrame, strategy: str = "FedAvg", by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Rows (by..., metric, pooled, combined, diff) of the best pooled model against one strategy, per group of `by`."""
    by = list(by)

    def long(df: DataFrame, name: str) -> DataFrame:
        ids = [*by, "one"]
        wide = df.select(*by, F.lit(1).alias("one"), *METRICS)
        return wide.unpivot(ids, list(METRICS), "metric", name).drop("one")

    best = long(pooled.filter("is_best"), "pooled")
    combined = long(finals.filter(F.col("strategy") == strategy), "combined")
    return best.join(combined, [*by, "metric"]).withColumn("diff", F.col("combined") - F.col("pooled"))


def strategy_table(finals: DataFrame, pooled: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., strategy, auc, f1, precision, recall, diff_vs_lr, note) against the group's pooled regression."""
    by = list(by)
    lr = pooled.filter(F.col("model") == "LR").groupBy(*by).agg(F.max("auc").alias("lr_auc"))
    top = best_strategy(finals, by=by).select(*by, F.col("strategy").alias("top"))
    note = F.when(F.col("auc") == 0, "degenerate").when(F.col("strategy") == F.col("top"), "best").otherwise("")
    diff = F.when(F.col("lr_auc") > 0, F.col("auc") - F.col("lr_auc")).otherwise(F.lit(0.0))
    rows = join_small(join_small(finals, lr, by, "left"), top, by, "left")
    return rows.select(*by, "strategy", "auc", "f1", "precision", "recall", diff.alias("diff_vs_lr"), note.alias("note"))


def mu_table(sweep: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., mu, auc, note): mu = 0 is the reference, the best strength is marked."""
    top = best_mu(sweep, by).select(*by, F.col("mu").alias("top"))
    note = F.when(F.col("mu") == 0, "reference").when(F.col("mu") == F.col("top"), "best").otherwise("")
    return join_small(sweep, top, by).select(*by, "mu", "auc", note.alias("note"))


def pooled_table(pooled: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., n_samples, LR, RF, GBT, best): AUC of every pooled model side by side."""

    def area(model: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("model") == model, F.col("auc"))), F.lit(0.0)).alias(model)

    return pooled.groupBy(*by).agg(
        F.max(F.col("n_train") + F.col("n_test")).alias("n_samples"),
        *[area(m) for m in ("LR", "RF", "GBT")],
        F.max(F.when(F.col("is_best"), F.col("model"))).alias("best"),
    )


def dataset_summary(pooled: DataFrame, finals: DataFrame, strategy: str = "FedAvg") -> DataFrame:
    """Rows (dataset, n_clients, pooled_auc, combined_auc, diff, verdict)."""
    best = pooled.filter("is_best").select("dataset", F.col("auc").alias("pooled_auc"))
    combined = finals.filter(F.col("strategy") == strategy).select("dataset", "n_clients", F.col("auc").alias("combined_auc"))
    diff = F.col("combined_auc") - F.col("pooled_auc")
    return (
        combined.join(best, "dataset")
        .withColumn("diff", diff)
        .withColumn("verdict", verdict("diff"))
        .select("dataset", "n_clients", "pooled_auc", "combined_auc", "diff", "verdict")
    )


def _result_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    kinds = {
        "n_clients": "bigint",
        "n_rounds": "bigint",
        "auc": "double",
        "f1": "double",
        "precision": "double",
        "recall": "double",
        "diff_vs_lr": "double",
        "mu": "double",
    }
    return df.select(
        *[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RESULT_COLUMNS]
    )


def result_table(pooled: DataFrame, finals: DataFrame, sweep: DataFrame, digits: int = 4) -> DataFrame:
    """The long result table: pooled models, combination strategies and the sweep of every dataset.

    Pooled rows carry f1, precision and recall for the best model only. Each note marks the best row
    of its dataset or a degenerate one; differences are taken from the dataset's own regression.
    """
    by = ["dataset"]
    clients = finals.groupBy(*by).agg(F.max("n_clients").alias("n_clients"))
    lr = pooled.filter(F.col("model") == "LR").groupBy(*by).agg(F.max("auc").alias("lr_auc"))
    top = best_strategy(finals, by).select(*by, F.col("strategy").alias("top"))

    def rounded(c: str) -> Column:
        return F.round(c, digits)

    def if_best(c: str) -> Column:
        return F.when(F.col("is_best"), rounded(c))

    part_pooled = _result_rows(
        join_small(pooled, clients, by, "left"),
        {
            "kind": F.lit("pooled"),
            "dataset": F.col("dataset"),
            "n_clients": F.col("n_clients"),
            "strategy": F.col("model"),
            "auc": rounded("auc"),
            "f1": if_best("f1"),
            "precision": if_best("precision"),
            "recall": if_best("recall"),
            "note": F.when(F.col("is_best"), "best").otherwise(""),
        },
    )
    differs = (F.col("lr_auc") != 0) & (F.col("auc") != 0)
    part_combined = _result_rows(
        join_small(join_small(finals, lr, by, "left"), top, by, "left"),
        {
            "kind": F.lit("combined"),
            "dataset": F.col("dataset"),
            "n_clients": F.col("n_clients"),
            "strategy": F.col("strategy"),
            "auc": rounded("auc"),
            "f1": rounded("f1"),
            "precision": rounded("precision"),
            "recall": rounded("recall"),
            "n_rounds": F.col("n_rounds"),
            "diff_vs_lr": F.when(differs, F.round(F.col("auc") - F.col("lr_auc"), digits)),
            "mu": F.when(F.col("strategy") == "FedProx", F.col("mu")),
            "note": F.when(F.col("strategy") == F.col("top"), "best").when(F.col("auc") == 0, "degenerate").otherwise(""),
        },
    )
    part_sweep = _result_rows(
        sweep,
        {
            "kind": F.lit("mu_sweep"),
            "dataset": F.col("dataset"),
            "strategy": F.lit("FedProx"),
            "auc": rounded("auc"),
            "mu": F.col("mu"),
            "note": F.when(F.col("mu") == 0, "reference").otherwise(""),
        },
    )
    return union_all([part_pooled, part_combined, part_sweep])


def series_rounds(history: DataFrame, pooled: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """AUC by round and strategy, with the group's pooled regression as reference line."""
    lr = pooled.filter(F.col("model") == "LR").groupBy(*by).agg(F.max("auc").alias("lr_auc"))
    return join_small(history, lr, by, "left").select(*by, "strategy", "round", "auc", "lr_auc")


def series_bars(pooled: DataFrame, finals: DataFrame) -> DataFrame:
    """Final AUC of every pooled model and strategy per dataset."""
    return union_all(
        [
            pooled.select("dataset", F.lit("pooled").alias("kind"), F.col("model").alias("name"), "auc"),
            finals.select("dataset", F.lit("combined").alias("kind"), F.col("strategy").alias("name"), "auc"),
        ]
    )


def series_mu(sweep: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """AUC by strength, mu = 0 included; the first maximum is marked."""
    top = sweep.groupBy(*by).agg(F.max_by("mu", F.struct(F.round("auc", TIE_DIGITS), -F.col("mu"))).alias("top"))
    return join_small(sweep, top, by).select(*by, "mu", "auc", (F.col("mu") == F.col("top")).cast("int").alias("is_best"))


def series_strategies(finals: DataFrame) -> DataFrame:
    """Final AUC by strategy and dataset."""
    return finals.select("dataset", "strategy", "auc")
