"""Bring aggregated values back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.session import materialise


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Add the columns of `stats` to every row of `df`.

    With keys, `stats` is written first. Its true size is then known when the join is planned: a
    small table is broadcast and the rows stay where they are; a large one is shuffled, both sides
    straight from an exchange, so that skewed partitions can be split.

    Without keys `stats` holds a single row and becomes a scalar subquery, so no join is needed.
    """
    if keys:
        return df.join(materialise(stats, "stats"), list(keys), how)
    return with_single_row(df, stats)


def with_single_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    row = stats.select(F.struct(*stats.columns).alias("__row")).scalar()
    return df.select("*", row.alias("__row")).select(
        *df.columns, *[F.col("__row")[c].alias(c) for c in stats.columns]
    )


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """The same for two tables of group statistics: a plain join, nothing is written."""
    return left.join(right, list(keys), how) if keys else with_single_row(left, right)
