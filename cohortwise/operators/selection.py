"""Exact order statistics of large groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import materialise


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per group, the values at the given 1-based ranks, in the value's own type.

    `ranks` maps output names to functions of n, the number of non-NULL values of the group. A rank
    outside 1..n gives NULL; every other rank is found, whatever the type or the size of the group.

    Distinct values with their counts are range-partitioned on (group, value) and written, so a group
    of any size is spread over slices. Totals of the slices tell in which one a rank lies; only those
    slices are ordered, each within itself.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    sliced = counts.repartitionByRange(*keys, "__v").withColumn("__slice", F.spark_partition_id())
    sliced = materialise(sliced, "slices")
    upto = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = sliced.groupBy(*keys, "__slice").agg(F.sum("__c").alias("__c"))
    totals = totals.withColumn("__upto", F.sum("__c").over(upto))
    totals = totals.withColumn("__n", F.max("__upto").over(Window.partitionBy(*keys)))
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank(F.col("__n")).cast("bigint").alias("k")) for name, rank in ranks.items()]
    )
    before = F.col("__upto") - F.col("__c")
    held = (
        totals.select(*keys, "__slice", "__upto", before.alias("__before"), F.explode(wanted).alias("__w"))
        .filter((F.col("__w.k") > F.col("__before")) & (F.col("__w.k") <= F.col("__upto")))
        .select(*keys, "__slice", F.col("__w.name").alias("__name"), (F.col("__w.k") - F.col("__before")).alias("__k"))
    )
    inside = Window.partitionBy(*keys, "__slice", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.join(held, [*keys, "__slice"]).withColumn("__upto", F.sum("__c").over(inside))
    hits = running.filter((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__c") < F.col("__k")))
    picks = [F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks]
    # groups of which no rank is inside 1..n keep a row of NULLs
    none = totals.select(*keys).distinct().withColumns({"__name": F.lit(None).cast("string"), "__v": F.lit(None)})
    return hits.select(*keys, "__name", "__v").unionByName(none).groupBy(*keys).agg(*picks)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    ranks = {"__lo": lambda n: F.floor((n + 1) / 2), "__hi": lambda n: F.floor(n / 2) + 1}
    out = order_statistics(df, keys, value, ranks)
    return out.select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) / 2).alias(name))
