"""Projection, null handling, deduplication, keys, labels and group-size filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import scalar
from cohortwise.operators.attach import attach
from cohortwise.sources.specs import DEFAULT_FEATURES, NEGATIVE_RESULTS, DatasetSpec


def project_required(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the requested columns that exist, in the requested order."""
    return df.select(*[c for c in cols if c in df.columns])


def available_features(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """Requested features that exist; if none does, the default ones that exist."""
    found = [c for c in cols if c in df.columns]
    return found or [c for c in DEFAULT_FEATURES if c in df.columns]


def drop_incomplete(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.dropna(subset=[c for c in cols if c in df.columns])


def dedup(df: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the largest by `prefer`, remaining columns breaking ties.

    An aggregate rather than a window: copies of one key collapse before the shuffle, so a key
    held by a third of the rows costs one row per task.
    """
    keys = [k for k in keys if k in df.columns]
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in prefer if c in rest] + [c for c in rest if c not in prefer]
    if not order:
        out = df.distinct()
    elif len(order) == 1:
        out = df.groupBy(*keys).agg(F.max(order[0]).alias(order[0]))
    else:
        kept = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__row"))
        out = kept.select(*keys, *[F.col("__row")[c].alias(c) for c in order])
    return out.select(*df.columns)


def with_client_id(df: DataFrame, parts: Sequence[str], sep: str = "_", prefix: str = "", clean: bool = False) -> DataFrame:
    return df.withColumn("client_id", scalar.client_key(parts, sep, prefix, clean))


def with_label(
    df: DataFrame, source: str, negatives: Iterable[str] | None = None, threshold: float | None = None
) -> DataFrame:
    if (negatives is None) == (threshold is None):
        raise ValueError("give either negatives or threshold")
    if threshold is not None:
        return df.withColumn("label", scalar.label_from_threshold(source, threshold))
    return df.withColumn("label", scalar.label_from_value(source, negatives))


def complete_features(df: DataFrame, cols: Sequence[str], how: str = "skip") -> DataFrame:
    """`zero`: NULL becomes 0. `skip`: rows with NULL or NaN in any of the columns are dropped."""
    if how == "zero":
        return df.fillna(0, subset=list(cols))
    if how != "skip":
        raise ValueError(f"unknown mode {how!r}")
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    out = df.dropna(subset=list(cols))
    for c in cols:
        if c in floating:
            out = out.filter(~F.isnan(c))
    return out


def min_group(df: DataFrame, key: str, n: int, strict: bool = False) -> DataFrame:
    """Rows whose group has at least `n` rows (more than `n` if strict), NULLs inside included."""
    size = F.col("__n") > n if strict else F.col("__n") >= n
    kept = df.groupBy(key).agg(F.count("*").alias("__n")).filter(size).select(key)
    return attach(df, kept, [key], "left_semi")


def group_status(df: DataFrame, key: str, n: int, features: Sequence[str], strict: bool = True) -> DataFrame:
    """Per group: rows, rows without NULL, and whether a model is trained, skipped (too small) or failed (no rows left)."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    big = F.col("n_rows") > n if strict else F.col("n_rows") >= n
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("n_complete"))
        .withColumn(
            "status", F.when(~big, "skipped").when(F.col("n_complete") == 0, "failed").otherwise("trained")
        )
    )


def range_rules(
    df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], mode: str = "flag"
) -> DataFrame:
    """Range checks on the columns present: `flag` adds `in_range` (0/1), `filter` keeps rows in range."""
    tests: list[Column] = []
    for name, (low, high) in rules.items():
        if name not in df.columns:
            continue
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    ok = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    ok = F.coalesce(ok, F.lit(False))
    if mode == "filter":
        return df.filter(ok)
    if mode != "flag":
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("in_range", ok.cast("int"))


def with_defaults(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are missing."""
    return df.withColumns({name: e for name, e in exprs.items() if name not in df.columns})


def with_row_id(df: DataFrame, name: str = "id_student") -> DataFrame:
    """A unique id per row without a shuffle. Ids have gaps and follow the partitions; `with_positions` numbers rows in an order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def union_all(dfs: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def clean_table(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Required columns, complete rows, one row per key, then the client key and the label."""
    out = dedup(drop_incomplete(project_required(df, spec.required), spec.required), spec.keys, spec.prefer)
    if {"code_module", "code_presentation"} <= set(out.columns):
        out = with_client_id(out, ["code_module", "code_presentation"])
    if "final_result" in out.columns:
        out = with_label(out, "final_result", negatives=NEGATIVE_RESULTS)
    return out
