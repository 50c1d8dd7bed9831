"""Rows laid out by group, so that steps which bring a table of groups to all rows move only that table.

While the table of groups fits Spark's broadcast threshold the rows stay where they are anyway. Beyond
it every step would shuffle all rows again. They are then written once, bucketed on (group, salt): a
group's salts grow with its rows, so a group with a third of the rows has a third of the buckets. A
step repeats each group's row once per salt and shuffles those to the buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.session import materialise, scratch_path

SALT = "__salt"
MAX_BUCKETS = 100_000
# rows of a bucket when tables are large; small ones have as many buckets as a shuffle has partitions
BUCKET_ROWS = 2_000_000


@dataclass
class Layout:
    """`rows` and how to bring a table with one or more rows per group to them."""

    rows: DataFrame
    key: str
    salts: DataFrame | None = None

    def with_groups(self, table: DataFrame) -> DataFrame:
        """Every row with the columns of each of its group's rows in `table`."""
        if self.salts is None:
            return self.rows.join(table, self.key)
        spread = table.join(self.salts, self.key).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col("__n_salts") - 1)))
        # hashed by bucket, so that the rows are not sorted in every step
        return self.rows.join(spread.drop("__n_salts").hint("shuffle_hash"), [self.key, SALT]).drop(SALT)


def fits_broadcast(spark: SparkSession, n_rows: int, width: int) -> bool:
    """Whether Spark would broadcast `n_rows` rows of `width` bytes under its own threshold."""
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return n_rows * width <= threshold


def _buckets(spark: SparkSession, n_rows: int) -> int:
    # a side with fewer partitions than a shuffle has is shuffled again
    conf = spark._jsparkSession.sessionState().conf()
    return min(max(conf.defaultNumShufflePartitions(), -(-n_rows // BUCKET_ROWS)), MAX_BUCKETS)


def by_group(rows: DataFrame, key: str, sizes: DataFrame, states: int, numbers: int) -> Layout:
    """A layout of `rows` for steps that join `states` rows per group, each of some `numbers` doubles.

    `rows` and `sizes` (key, n_train) are written tables. The files live in the shared scratch folder.
    """
    spark = rows.sparkSession
    found = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("rows")).first()
    if fits_broadcast(spark, found["groups"] * states, 8 * (numbers + 8)):
        return Layout(rows, key)
    buckets = _buckets(spark, found["rows"])
    per_salt = max(1, found["rows"] // buckets)
    n_salts = F.greatest(F.lit(1), F.ceil(F.col("n_train") / per_salt)).cast("int")
    salts = materialise(sizes.select(key, n_salts.alias("__n_salts")), "salts")
    # numbered where they are read, before any shuffle, so that a task that runs again deals the same salts
    numbered = rows.withColumn("__at", F.monotonically_increasing_id()).join(salts, key)
    dealt = numbered.withColumn(SALT, F.pmod("__at", "__n_salts").cast("int")).drop("__at", "__n_salts")
    return Layout(_write_bucketed(dealt, [key, SALT], buckets), key, salts)


def _write_bucketed(df: DataFrame, on: Sequence[str], buckets: int) -> DataFrame:
    """Written as one file per bucket and read back; the catalogue keeps no entry."""
    spark, name = df.sparkSession, f"cohortwise_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *on).sortWithinPartitions(*on)
    placed.write.bucketBy(buckets, *on).sortBy(*on).option("path", scratch_path(spark, "by_group")).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
