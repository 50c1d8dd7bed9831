"""Null counts per table in a single pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, dataset: str, cols: Sequence[str], cap: int | None = None) -> DataFrame:
    """Rows (dataset, check, value): the row count and the NULL count of every column of `cols`, or of the first `cap`."""
    checked = [c for c in cols if c in df.columns][:cap]
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in checked]
    )
    return counts.select(F.lit(dataset).alias("dataset"), "*").unpivot(
        "dataset", counts.columns, "check", "value"
    )
