"""Per-group models combined over rounds by several strategies, and the sweep over the proximal strength.

A local fit runs to convergence, so it does not depend on the model a round starts from: every group
is solved once per strength, and rounds become recurrences on vectors of p + 1 numbers.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.cleaning import min_group, union_all
from cohortwise.operators.combining import (
    PROX_MU,
    as_models,
    combine_adam,
    initial_model,
    mean_rounds,
    mean_targets,
    median_round,
    round_numbers,
)
from cohortwise.operators.grouped_lr import fit_grouped_lr, with_probability
from cohortwise.operators.metrics import METRICS, evaluate_by_client, weighted_round_mean
from cohortwise.session import materialise

STRATEGIES = ("FedAvg", "FedProx", "FedAdam", "FedMedian")
SWEEP = (0.01, 0.1, 1.0)
ROUNDS = 10


def client_status(df: DataFrame, key: str = "client_id", min_rows: int = 20) -> DataFrame:
    """One row (n_clients, status): fewer than two eligible groups cannot be combined."""
    counts = min_group(df, key, min_rows).agg(F.count_distinct(key).alias("n_clients"))
    return counts.withColumn(
        "status", F.when(F.col("n_clients") < 2, "insufficient_clients").otherwise("ok")
    )


def model_paths(
    models: DataFrame,
    key: str = "client_id",
    rounds: int = ROUNDS,
    strategies: Sequence[str] = STRATEGIES,
    prox_mu: float = PROX_MU,
    sweep: Sequence[float] = (),
    bias_correction: bool = False,
) -> DataFrame:
    """Rows (strategy, mu, round, pos, value): the combined model after every round."""
    by_mu = mean_targets(models)
    plain = models.filter(F.col("mu") == 0.0)
    start = initial_model(plain, key).select("pos", "value")
    base = by_mu.filter(F.col("mu") == 0.0).drop("mu")

    def named(path: DataFrame, strategy: str, mu: float) -> DataFrame:
        return path.select(
            F.lit(strategy).alias("strategy"), F.lit(float(mu)).alias("mu"), "round", "pos", "value"
        )

    parts = []
    if "FedAvg" in strategies:
        parts.append(named(mean_rounds(base, start, rounds), "FedAvg", 0.0))
    mus = [prox_mu] if "FedProx" in strategies else []
    for mu in [*mus, *[m for m in sweep if m not in mus]]:
        targets = by_mu.filter(F.col("mu") == mu).drop("mu")
        parts.append(named(mean_rounds(targets, start, rounds), "FedProx", mu))
    if "FedAdam" in strategies:
        parts.append(named(combine_adam(base, start, rounds, bias_correction=bias_correction), "FedAdam", 0.0))
    if "FedMedian" in strategies:
        parts.append(named(_median_path(plain, start, rounds), "FedMedian", 0.0))
    return union_all(parts)


def _median_path(plain: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """Rows (round, pos, value) of the median. It stays as it is unless idle groups echo the round before.

    Only the p + 1 numbers of the combined model come to the driver, and only where groups are idle.
    """
    if plain.filter(~F.col("trainable")).isEmpty():
        return median_round(plain).select(round_numbers(rounds), "pos", "value")
    now = [r["value"] for r in start.orderBy("pos").collect()]
    path = []
    settled = False
    for r in range(1, rounds + 1):
        if not settled:
            found = [row["value"] for row in median_round(plain, now).orderBy("pos").collect()]
            settled, now = found == now, found
        path += [(r, pos, value) for pos, value in enumerate(now)]
    return plain.sparkSession.createDataFrame(path, "round int, pos int, value double")


def evaluate_paths(
    test: DataFrame,
    paths: DataFrame,
    features: Sequence[str],
    key: str = "client_id",
    exclude_degenerate: bool = False,
) -> DataFrame:
    """Rows (strategy, mu, round, key, loss, n_samples, metrics...): every combined model on every group's test rows.

    The combined models are strategies x rounds vectors of p + 1 numbers, whatever the data size.
    Equal ones are scored once: they ride along with each test row as an array that is exploded.
    """
    spark = test.sparkSession
    by = ["strategy", "mu", "round"]
    ids: dict[tuple[float, ...], int] = {}
    index = []
    for row in as_models(paths, by).collect():
        model = ids.setdefault(tuple(row["beta"]), len(ids))
        index.append((row["strategy"], row["mu"], row["round"], model))
    offers = F.array(*[F.struct(F.lit(i).alias("model"), F.lit(list(beta)).alias("beta")) for beta, i in ids.items()])
    offers = offers.cast("array<struct<model:int,beta:array<double>>>")  # no eligible group, no model
    scored = test.select(key, "label", *features, F.explode(offers).alias("__offer"))
    scored = scored.select(key, "label", *features, "__offer.model", F.col("__offer.beta").alias("__beta"))
    scored = with_probability(scored, features).select("model", key, "label", "prob", "pred")
    per_client = evaluate_by_client(scored, ["model", key], exclude_degenerate=exclude_degenerate)
    names = spark.createDataFrame(index, "strategy string, mu double, round int, model int")
    return names.join(per_client, "model").drop("model")


def run_rounds(
    rows: DataFrame,
    features: Sequence[str],
    key: str = "client_id",
    rounds: int = ROUNDS,
    strategies: Sequence[str] = STRATEGIES,
    prox_mu: float = PROX_MU,
    sweep: Sequence[float] = (),
    exclude_degenerate: bool = False,
    bias_correction: bool = False,
    unconverged: str = "warn",
) -> DataFrame:
    """Rows (strategy, mu, round, n_clients, auc, accuracy, f1, precision, recall).

    Local models that did not converge are combined with a warning; `unconverged="raise"` refuses them.
    `rows` come from `client_rows`. With `sweep` the proximal strategy is also run for those strengths.
    Fewer than two groups cannot be combined and give an empty history (see `client_status`).
    """
    if rows.select(key).distinct().limit(2).count() < 2:
        rows = rows.limit(0)
    mus = sorted({0.0, *([prox_mu] if "FedProx" in strategies else []), *sweep})
    train, test = rows.filter(F.col("is_test") == 0), rows.filter(F.col("is_test") == 1)
    models = materialise(fit_grouped_lr(train, key, features, mus=mus), "models")
    _check_converged(models, unconverged)
    paths = model_paths(models, key, rounds, strategies, prox_mu, sweep, bias_correction)
    scored = evaluate_paths(test, paths, features, key, exclude_degenerate)
    return weighted_round_mean(scored, ["strategy", "mu", "round"])


def _check_converged(models: DataFrame, unconverged: str) -> None:
    open_ones = models.filter("trainable AND NOT converged").count()
    if open_ones:
        message = f"{open_ones} local models did not converge"
        if unconverged == "raise":
            raise RuntimeError(message)
        warnings.warn(message, stacklevel=3)


def mu_sweep(
    rows: DataFrame, features: Sequence[str], mus: Sequence[float] = SWEEP, key: str = "client_id", rounds: int = ROUNDS
) -> DataFrame:
    """Rows (mu, metrics...) after the last round; mu = 0 is plain averaging."""
    history = run_rounds(rows, features, key, rounds, strategies=("FedAvg",), sweep=mus)
    return history.filter(F.col("round") == rounds).select("mu", *METRICS)


def round_completeness(history: DataFrame, rounds: int = ROUNDS, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (by..., strategy, n_rounds, status): did every strategy run all its rounds."""
    done = history.groupBy(*by, "strategy").agg(F.count_distinct("round").alias("n_rounds"))
    return done.withColumn("status", F.when(F.col("n_rounds") < rounds, "incomplete").otherwise("ok"))
