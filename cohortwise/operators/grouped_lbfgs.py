"""One logistic regression per group by a limited number of quasi-Newton steps, all groups together.

Where `grouped_lr` solves every group to the end, this stops after a budget of steps, like a solver
that is given few iterations. An evaluation joins the rows to the (group, coefficients) table and sums
loss and gradient with map-side partials, p + 2 numbers a group. The state of a group, with the last
steps and gradient differences of its limited memory, is a row that is updated where the sums land.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.cleaning import union_all
from cohortwise.operators.combining import resize_coef
from cohortwise.operators.grouped_lr import NewtonSums
from cohortwise.operators.layout import by_group
from cohortwise.operators.scaling import class_weights
from cohortwise.session import materialise

MEMORY = 10
ARMIJO = 1e-4
CURVATURE = 1e-10
SMALLEST_STEP = 2.0**-20
STATE = (
    "w_pos double, w_neg double, beta array<double>, trial array<double>, grad array<double>, move array<double>, "
    "loss double, step double, moves array<array<double>>, turns array<array<double>>, n_steps int, done boolean, converged boolean"
)


def direction(grad: np.ndarray, moves: Sequence[np.ndarray], turns: Sequence[np.ndarray]) -> np.ndarray:
    """Minus the inverse Hessian approximation of the remembered moves and gradient differences, times `grad`."""
    out, shares = grad.copy(), []
    for s, y in zip(reversed(moves), reversed(turns), strict=True):
        share = (s @ out) / (y @ s)
        shares.append(share)
        out = out - share * y
    if moves:
        out = out * (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
    for s, y, share in zip(moves, turns, reversed(shares), strict=True):
        out = out + (share - (y @ out) / (y @ s)) * s
    return -out


def advance(state: dict, loss: float, grad: np.ndarray, budget: int, tol: float) -> dict:
    """The state after the loss and the gradient at its trial point are known: a step is taken or halved."""
    trial, moves, turns = state["trial"], list(state["moves"]), list(state["turns"])
    new = dict(state)
    first = np.isnan(state["loss"])
    if first or loss <= state["loss"] + ARMIJO * state["step"] * float(state["grad"] @ state["move"]):
        if not first:
            s, y = trial - state["beta"], grad - state["grad"]
            if s @ y > CURVATURE * (s @ s):
                moves, turns = [*moves, s][-MEMORY:], [*turns, y][-MEMORY:]
        move = direction(grad, moves, turns)
        new |= {"beta": trial, "grad": grad, "loss": loss, "moves": moves, "turns": turns, "move": move}
        new["step"] = 1.0 if moves else min(1.0, 1.0 / max(float(np.sqrt(grad @ grad)), 1e-300))
        new["n_steps"] = state["n_steps"] + (not first)
        new["converged"] = bool(np.abs(grad).max() < tol)
        new["done"] = new["converged"] or new["n_steps"] >= budget
    else:
        new["step"] = state["step"] / 2
        new["done"] = new["step"] < SMALLEST_STEP
    new["trial"] = new["beta"] + new["step"] * new["move"]
    return new


def _update(key: str, p: int, l2: float, budget: int, tol: float):
    ridge = np.array([l2] * p + [0.0])
    names = [f.split()[0] for f in STATE.split(", ")]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            sums = b[[f"g_{i}" for i in range(p + 1)]].to_numpy(float)
            for at, row in enumerate(b[names].to_dict("records")):
                state = row | {c: np.array(row[c], float) for c in ("beta", "trial", "grad", "move")}
                state |= {c: [np.array(v, float) for v in row[c]] for c in ("moves", "turns")}
                loss = float(b["sum_loss"].iloc[at]) + 0.5 * float(ridge @ state["trial"] ** 2)
                rows.append(advance(state, loss, sums[at] + ridge * state["trial"], budget, tol))
            if rows:
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, key, b[key].to_numpy())
                yield out

    return step


def fit_grouped_lbfgs(
    train: DataFrame,
    key: str,
    features: Sequence[str],
    label: str = "label",
    budget: int = 10,
    l2: float = 1.0,
    balanced: bool = True,
    start: DataFrame | None = None,
    tol: float = 1e-8,
) -> DataFrame:
    """Rows (key, coef, intercept, n_train, trainable, converged, n_steps, loss) after at most `budget` steps.

    Minimises the log loss plus l2 / 2 * |coef|^2 per group by limited-memory quasi-Newton steps with
    halving; `loss` is the value reached. `start` (key, coef, intercept) gives models to start from, cut
    or padded to the features; groups without one start from zero. Groups with one class keep their
    start and trainable = false. `train` holds scaled, complete rows and is scanned once an evaluation.
    """
    p = len(features)
    rows = train.select(key, label, *features)
    groups = class_weights(rows, label, [key]).select(
        key,
        *[F.col(w) if balanced else F.lit(1.0).alias(w) for w in ("w_pos", "w_neg")],
        F.col("n").alias("n_train"),
        ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("trainable"),
    )
    zeros = F.array(*[F.lit(0.0)] * (p + 1))
    if start is not None:
        given = resize_coef(start.select(key, "coef", "intercept"), p)
        groups = groups.join(given.select(key, F.concat("coef", F.array("intercept")).alias("begin")), key, "left")
        groups = groups.withColumn("begin", F.coalesce("begin", zeros))
    else:
        groups = groups.withColumn("begin", zeros)
    groups = materialise(groups, "groups")
    none = F.array().cast("array<array<double>>")
    schema = f"`{key}` {groups.schema[key].dataType.simpleString()}, {STATE}"
    state = groups.filter("trainable").select(
        key, "w_pos", "w_neg", F.col("begin").alias("beta"), F.col("begin").alias("trial"), zeros.alias("grad"), zeros.alias("move"),
        F.lit(float("nan")).alias("loss"), F.lit(1.0).alias("step"), none.alias("moves"), none.alias("turns"),
        F.lit(0).alias("n_steps"), F.lit(False).alias("done"), F.lit(False).alias("converged"),
    )
    laid_out = by_group(rows, key, groups.select(key, "n_train"), 1, p + 1)
    sums = NewtonSums(key, features, label, "trial", hessian=False)
    update = _update(key, p, l2, budget, tol)
    solved: list[DataFrame] = []
    evaluation = 0
    while True:
        offered = state.select(key, F.lit(0.0).alias("mu"), "w_pos", "w_neg", "trial")
        moved = state.join(sums(laid_out.with_groups(offered)).drop("mu"), key).mapInPandas(update, schema)
        moved = materialise(moved, f"evaluation_{evaluation}")
        evaluation += 1
        solved.append(moved.filter("done"))
        state = moved.filter("NOT done")
        if state.isEmpty():
            break
    result = union_all(solved).select(key, "beta", "converged", "n_steps", "loss")
    beta = F.coalesce("beta", "begin")
    return groups.join(result, key, "left").select(
        key,
        F.slice(beta, 1, p).alias("coef"),
        F.element_at(beta, p + 1).alias("intercept"),
        "n_train",
        "trainable",
        F.coalesce("converged", F.lit(False)).alias("converged"),
        F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        "loss",
    )
