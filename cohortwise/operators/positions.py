"""Consecutive row ids in a given order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import materialise


def with_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """`df` with the place of every row in the order of `order`, from 0 to n - 1.

    Rows are range-partitioned on `order` and sorted inside their partition; a row's place is its
    place there plus the sizes of the partitions before, of which only one number each is summed.
    The partitions are written, so ids do not change when a result is computed again. Rows that are
    equal in `order` follow each other in no particular order; they are spread over partitions too,
    so a value that a third of all rows have is not one task. NULLs come where `order` puts them.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    keys = [*order, "__salt"]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt")
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    placed = materialise(dealt.withColumns({"__part": part, "__at": local}), "positions")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, "__part").withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)
