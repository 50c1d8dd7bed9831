"""Rounds whose local fits are pulled towards the round's combined model.

Unlike the recurrences of `rounds`, a local fit here depends on the model it starts from: it minimises
the local objective plus mu / 2 * |w - w_round|^2 over all p + 1 numbers. All groups of a round are
solved together by Newton steps that start from the group's solution of the round before, which leaves
few steps once the rounds settle. Between rounds only the p + 1 numbers of the combined model come to
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.combining import PROX_MU, initial_model, mean_targets
from cohortwise.operators.grouped_lr import fit_grouped_lr
from cohortwise.operators.metrics import weighted_round_mean
from cohortwise.plans.rounds import ROUNDS, evaluate_paths
from cohortwise.session import materialise

STRATEGY = "FedProxTerm"


def proximal_models(
    train: DataFrame,
    features: Sequence[str],
    key: str = "client_id",
    rounds: int = ROUNDS,
    mu: float = PROX_MU,
    l2: float = 1.0,
    tol: float = 1e-7,
) -> list[tuple[list[float], DataFrame, list[float]]]:
    """Per round: the model it starts from, the local models, and their combination.

    Round 1 starts from the local model of the first group in key order. Groups that cannot be trained
    return the model they are given. An empty table gives no rounds.
    """
    if train.isEmpty():
        return []
    local = materialise(fit_grouped_lr(train, key, features, l2=l2, tol=tol), "local_models")
    first = initial_model(local, key).orderBy("pos").collect()
    now, out = [r["value"] for r in first], []
    for _ in range(rounds):
        local = fit_grouped_lr(train, key, features, l2=l2, tol=tol, prox=mu, center=now, start=local)
        local = materialise(local, "local_models")
        target = mean_targets(local).orderBy("pos").collect()
        combined = [r["value"] + r["idle"] * (w - r["value"]) for r, w in zip(target, now, strict=True)]
        out.append((now, local, combined))
        now = combined
    return out


def proximal_path(
    train: DataFrame, features: Sequence[str], key: str = "client_id", rounds: int = ROUNDS, mu: float = PROX_MU, l2: float = 1.0
) -> DataFrame:
    """Rows (round, pos, value): the combined model after every round."""
    models = proximal_models(train, features, key, rounds, mu, l2)
    path = [(r + 1, pos, v) for r, (_, _, combined) in enumerate(models) for pos, v in enumerate(combined)]
    return train.sparkSession.createDataFrame(path, "round int, pos int, value double")


def proximal_rounds(
    rows: DataFrame, features: Sequence[str], key: str = "client_id", rounds: int = ROUNDS, mu: float = PROX_MU, l2: float = 1.0
) -> DataFrame:
    """Rows (strategy, mu, round, n_clients, metrics...) on the test rows; `rows` come from `client_rows`."""
    train, test = rows.filter(F.col("is_test") == 0), rows.filter(F.col("is_test") == 1)
    path = proximal_path(train, features, key, rounds, mu, l2)
    named = path.select(F.lit(STRATEGY).alias("strategy"), F.lit(float(mu)).alias("mu"), "round", "pos", "value")
    return weighted_round_mean(evaluate_paths(test, named, features, key), ["strategy", "mu", "round"])
