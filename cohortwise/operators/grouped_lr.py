"""One logistic regression per group, all groups and penalties solved together by Newton steps.

Rows stay distributed and are never collected per group. An iteration joins them to the
(group, mu, coefficients) table, which moves to the rows (`layout`), and sums the loss, the gradient and the upper Hessian triangle per
(group, mu) with map-side partial sums, so a group holding a third of the rows adds a few partial
rows per task. The p x p systems are solved in batches where the sums land. The coefficient table
is written between iterations; solved groups drop out of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.cleaning import union_all
from cohortwise.operators.layout import by_group
from cohortwise.operators.scaling import class_weights
from cohortwise.session import materialise

ACCEPT_SLACK = 1e-12
SMALLEST_SCALE = 1e-6


def _linear(features: Sequence[str], beta: str) -> Column:
    """Intercept plus the weighted features; the intercept is the last element of `beta`."""
    z = F.col(beta)[len(features)]
    for i, name in enumerate(features):
        z = z + F.col(name) * F.col(beta)[i]
    return z


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class NewtonSums:
    """Per (key, mu): weighted log loss `sum_loss`, gradient `g_i` and, unless left out, Hessian triangle `h_i_j`.

    The expressions are built once and applied in every iteration.
    """

    def __init__(self, key: str, features: Sequence[str], label: str, beta: str, hessian: bool = True):
        p = len(features)
        x = [f"`{name}`" for name in features] + ["1.0D"]
        self.key, self.linear = key, _linear(features, beta)
        # log(1 + exp(z)) - y * z without overflow
        loss = f"log1p(exp(-abs(__z))) + greatest(__z, 0.0D) - `{label}` * __z"
        self.weight = F.expr(f"if(`{label}` = 1, w_pos, w_neg)")
        self.prob = logistic(F.col("__z"))
        self.row = {"__r": F.expr(f"__w * (__p - `{label}`)"), "__c": F.expr("__w * __p * (1.0D - __p)")}
        self.sums = [
            F.expr(f"sum(__w * ({loss})) AS sum_loss"),
            *[F.expr(f"sum(__r * {x[i]}) AS g_{i}") for i in range(p + 1)],
            *[F.expr(f"sum(__c * {x[i]} * {x[j]}) AS h_{i}_{j}") for i in range(p + 1) for j in range(i, p + 1) if hessian],
        ]

    def __call__(self, rows: DataFrame) -> DataFrame:
        at = rows.withColumns({"__z": self.linear, "__w": self.weight}).withColumn("__p", self.prob)
        at = at.withColumns(self.row)
        return at.groupBy(self.key, "mu").agg(*self.sums)


def _update(p: int, l2: float, tol: float, prox: float, center: Sequence[float]):
    """Batch function: one accepted Newton step, or a halved one where the loss rose."""
    pull = np.array(center, float)
    ij = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]

    def stack(values: pd.Series) -> np.ndarray:
        return np.array(values.tolist(), dtype=float).reshape(len(values), p + 1)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = len(b)
            if m == 0:
                continue
            beta, trial, move = stack(b["beta"]), stack(b["trial"]), stack(b["move"])
            ridge = np.zeros((m, p + 1))
            ridge[:, :p] = l2 * (1.0 + b["mu"].to_numpy(float))[:, None]
            away = trial - pull
            loss = b["sum_loss"].to_numpy(float) + 0.5 * (ridge * trial**2 + prox * away**2).sum(axis=1)
            grad = b[[f"g_{i}" for i in range(p + 1)]].to_numpy(float) + ridge * trial + prox * away
            hess = np.empty((m, p + 1, p + 1))
            for i, j in ij:
                hess[:, i, j] = hess[:, j, i] = b[f"h_{i}_{j}"].to_numpy(float)
            hess[:, np.arange(p + 1), np.arange(p + 1)] += ridge + prox
            # separable groups without a penalty have a vanishing Hessian: keep it invertible
            floor = 1e-10 * (1e-6 + np.trace(hess, axis1=1, axis2=2))
            hess[:, np.arange(p + 1), np.arange(p + 1)] += np.where(ridge[:, :1] + prox > 0, 0.0, floor[:, None])
            previous = b["loss"].to_numpy(float)
            scale = b["scale"].to_numpy(float)
            ok = np.isnan(previous) | (loss <= previous + ACCEPT_SLACK * (1.0 + np.abs(previous)))
            stuck = ~ok & (scale < SMALLEST_SCALE)
            newton = np.linalg.solve(hess, -grad[:, :, None])[:, :, 0]
            small = ok & (np.abs(newton).max(axis=1) < tol)
            out_beta = np.where(ok[:, None], trial, beta)
            out_beta = np.where(small[:, None], trial + newton, out_beta)
            out_move = np.where(ok[:, None], newton, move)
            out_scale = np.where(ok, 1.0, scale / 2.0)
            yield pd.DataFrame(
                {
                    **{c: b[c] for c in b.columns[:4]},
                    "beta": list(out_beta),
                    "trial": list(out_beta + out_scale[:, None] * out_move),
                    "move": list(out_move),
                    "scale": out_scale,
                    "loss": np.where(ok, loss, previous),
                    "n_iter": b["n_iter"] + 1,
                    "done": small | stuck,
                    "converged": small,
                }
            )

    return step


def fit_grouped_lr(
    train: DataFrame,
    key: str,
    features: Sequence[str],
    label: str = "label",
    mus: Sequence[float] = (0.0,),
    l2: float = 1.0,
    balanced: bool = True,
    max_iter: int = 50,
    tol: float = 1e-6,
    prox: float = 0.0,
    center: Sequence[float] | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """Rows (key, mu, coef, intercept, n_train, trainable, converged, n_iter).

    Minimises the class-balanced log loss plus l2 * (1 + mu) / 2 * |coef|^2 per group; the intercept
    is free. With `prox`, prox / 2 times the squared distance of all p + 1 numbers from `center` is added.
    `start` (key, mu, coef, intercept) gives the models from which the steps begin, zero where it has none.
    Groups with one class or fewer than two rows get a zero model and trainable = false.
    A group is solved once a Newton step is shorter than `tol`; that step is still taken, which
    leaves an error of the order of its square.
    `train` holds scaled, complete rows and is scanned in every iteration: pass a written or cached table.
    """
    p = len(features)
    rows = train.select(key, label, *features)
    zeros = F.array(*[F.lit(0.0)] * (p + 1))
    groups = class_weights(rows, label, [key]).select(
        key,
        F.explode(F.array(*[F.lit(float(m)) for m in mus])).alias("mu"),
        *[F.col(w) if balanced else F.lit(1.0).alias(w) for w in ("w_pos", "w_neg")],
        F.col("n").alias("n_train"),
        ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("trainable"),
    )
    groups = materialise(groups, "groups")
    begun = groups.filter("trainable").withColumn("__begin", zeros)
    if start is not None:
        given = start.select(key, "mu", F.concat("coef", F.array("intercept")).alias("__given"))
        begun = begun.join(given, [key, "mu"], "left").withColumn("__begin", F.coalesce("__given", "__begin"))
    state = begun.select(
        key,
        "mu",
        "w_pos",
        "w_neg",
        F.col("__begin").alias("beta"),
        F.col("__begin").alias("trial"),
        zeros.alias("move"),
        F.lit(1.0).alias("scale"),
        F.lit(float("nan")).alias("loss"),
        F.lit(0).alias("n_iter"),
        F.lit(False).alias("done"),
        F.lit(False).alias("converged"),
    )
    schema = state.schema
    laid_out = by_group(rows, key, groups.select(key, "n_train").distinct(), len(mus), p + 1)
    sums = NewtonSums(key, features, label, "trial")
    update = _update(p, l2, tol, prox, center if center is not None else [0.0] * (p + 1))
    solved: list[DataFrame] = []
    for iteration in range(max_iter):
        at_trial = sums(laid_out.with_groups(state.select(key, "mu", "w_pos", "w_neg", "trial")))
        moved = materialise(state.join(at_trial, [key, "mu"]).mapInPandas(update, schema), f"step_{iteration}")
        state = moved.filter(~F.col("done"))
        last = iteration == max_iter - 1 or state.isEmpty()
        solved.append(moved if last else moved.filter("done"))
        if last:
            break
    result = union_all(solved).select(key, "mu", "beta", "converged", "n_iter")
    beta = F.coalesce("beta", zeros)
    return groups.join(result, [key, "mu"], "left").select(
        key,
        "mu",
        F.slice(beta, 1, p).alias("coef"),
        F.element_at(beta, p + 1).alias("intercept"),
        "n_train",
        "trainable",
        F.coalesce("converged", F.lit(False)).alias("converged"),
        F.coalesce("n_iter", F.lit(0)).alias("n_iter"),
    )


def gradient_at_zero(train: DataFrame, key: str, features: Sequence[str], label: str = "label") -> DataFrame:
    """Rows (key, loss, g_0.., g_p): balanced loss and gradient at the zero model; g_p is the intercept's."""
    weights = class_weights(train, label, [key]).select(key, "w_pos", "w_neg")
    zeros = F.array(*[F.lit(0.0)] * (len(features) + 1))
    rows = train.select(key, label, *features, F.lit(0.0).alias("mu"), zeros.alias("__beta")).join(weights, key)
    sums = NewtonSums(key, features, label, "__beta")(rows)
    return sums.select(
        key, F.col("sum_loss").alias("loss"), *[f"g_{i}" for i in range(len(features) + 1)]
    )


def residuals(
    train: DataFrame, models: DataFrame, key: str, features: Sequence[str], label: str = "label", l2: float = 1.0
) -> DataFrame:
    """Rows (key, mu, residual): the largest entry of the balanced objective's gradient at each trainable model."""
    p = len(features)
    fitted = models.filter("trainable").select(key, "mu", F.concat("coef", F.array("intercept")).alias("__beta"))
    weights = class_weights(train, label, [key]).select(key, "w_pos", "w_neg")
    rows = train.select(key, label, *features).join(fitted.join(weights, key), key)
    sums = NewtonSums(key, features, label, "__beta", hessian=False)(rows).join(fitted, [key, "mu"])
    ridge = F.lit(l2) * (1 + F.col("mu"))
    entries = [F.abs(F.col(f"g_{i}") + (ridge * F.col("__beta")[i] if i < p else F.lit(0.0))) for i in range(p + 1)]
    return sums.select(key, "mu", F.greatest(*entries).alias("residual"))


def score(df: DataFrame, models: DataFrame, features: Sequence[str], on: Sequence[str] = ("client_id",)) -> DataFrame:
    """Add `prob` and `pred` of each row under its group's model (coef, intercept)."""
    out = df.join(models.select(*on, F.concat("coef", F.array("intercept")).alias("__beta")), list(on))
    return with_probability(out, features).drop("__beta")


def with_probability(df: DataFrame, features: Sequence[str], beta: str = "__beta") -> DataFrame:
    prob = logistic(_linear(features, beta))
    return df.withColumn("prob", prob).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


