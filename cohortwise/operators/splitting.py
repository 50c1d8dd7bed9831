"""Train/test splits that give the same rows on any partitioning.

Rows are ordered by an md5 of their key. A stratum's cut is found by refining hash prefixes: the leading
hex digits, as many as the stratum's count asks for, make even cells, whose counts tell which one holds
the cut; that cell is divided in the same way until it is small, and only its rows are sorted. Every row
then compares its hash with the cut-off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.scalar import row_hash
from cohortwise.operators.attach import attach, join_small
from cohortwise.operators.selection import order_statistics
from cohortwise.session import materialise

# rows of one stratum that a task sorts
CELL_ROWS = 8_192
# hex digits of the hash, and of them in one pass: 4,096 counts a stratum
HASH_DIGITS = 32
PASS_DIGITS = 3
# cut-off column of each stratum: a class, or -1 for both classes together
CUTS = {"__cut_neg": 0, "__cut_pos": 1, "__cut_any": -1}


def _half_up(num: Column, den: Column) -> Column:
    """round(num / den) of non-negative integers, halves up, in integer arithmetic."""
    return F.floor((2 * num + den) / (2 * den)).cast("bigint")


def with_split_plan(counts: DataFrame, by: Sequence[str], test: float, fallback: bool) -> DataFrame:
    """Per group: rows of each class, how it is split, and the test rows of each stratum.

    The test part holds ceil(test * n) rows, spread over the classes in proportion. With `fallback`
    a group with one class or fewer than five rows is cut by position, and a group with a class too
    small to appear on both sides is drawn without regard to the class.
    """
    n, n1 = F.col("__n"), F.col("__n1")
    plan = counts.groupBy(*by).agg(
        F.sum("__c").alias("__n"), F.sum(F.when(F.col("__label") == 1, F.col("__c")).otherwise(0)).alias("__n1")
    )
    plan = plan.withColumn("__n_test", F.ceil(n * F.lit(test)).cast("bigint"))
    plan = plan.withColumn("__test1", n1 - _half_up(n1 * (n - F.col("__n_test")), n))
    plan = plan.withColumn("__test0", F.col("__n_test") - F.col("__test1"))
    n0 = n - n1
    both = (
        (F.least(n0, n1) >= 2)
        & (F.col("__test1") >= 1)
        & (F.col("__test0") >= 1)
        & (F.col("__test1") < n1)
        & (F.col("__test0") < n0)
    )
    if fallback:
        mode = F.when((n0 == 0) | (n1 == 0) | (n < 5), "positional").when(both, "stratified").otherwise("random")
    else:
        mode = F.lit("stratified")
    return plan.withColumn("__split_mode", mode).select(*by, "__n_test", "__test1", "__test0", "__split_mode")


def stratified_split(
    df: DataFrame,
    id_cols: str | Sequence[str],
    label: str = "label",
    by: Sequence[str] = (),
    test: float = 0.2,
    seed: int = 42,
    fallback: bool = False,
) -> DataFrame:
    """Add `is_test` (0/1): an exact split by label, within each group of `by`.

    `id_cols` identify a row within its group. Positional groups are ordered by the first of them.
    Rows with a NULL label or group key belong to no stratum: they stay, with a NULL `is_test`.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    by = list(by)
    rows = df.withColumns({"__h": row_hash(ids, seed), "__label": F.col(label).cast("int")})
    known = _all_known([*by, "__label"])
    counts = rows.filter(known).groupBy(*by, "__label").agg(F.count("*").alias("__c"))
    strata = materialise(_strata(counts, by, test, fallback), "strata")
    cuts = _cut_offs(rows.filter(known).select(*by, "__label", "__h"), strata.filter("__k > 0"), by)
    # one row per group; a stratum without a cut has no test rows
    rules = join_small(strata.select(*by, "__split_mode").distinct(), cuts, by, "left")
    of_class = F.when(F.col("__label") == 1, F.col("__cut_pos")).otherwise(F.col("__cut_neg"))
    cut = F.when(F.col("__split_mode") == "random", F.col("__cut_any")).otherwise(of_class)
    chosen = F.coalesce(F.col("__h") <= cut, F.lit(False))
    positional = strata.filter(F.col("__split_mode") == "positional")
    if fallback and not positional.isEmpty():
        some = rows.join(positional.select(*by).distinct(), by, "left_semi") if by else rows
        heads = order_statistics(some, by, ids[0], {"__head": lambda n: F.floor(n * F.lit(1 - test))})
        rules = join_small(rules, heads, by, "left")
        behind = F.coalesce(F.col(ids[0]) > F.col("__head"), F.lit(True))
        chosen = F.when(F.col("__split_mode") == "positional", behind).otherwise(chosen)
    marked = F.when(known, chosen.cast("int")).alias("is_test")
    return attach(rows, rules, by, "left").select(*df.columns, marked)


def _strata(counts: DataFrame, by: Sequence[str], test: float, fallback: bool) -> DataFrame:
    """Rows (by..., mode, stratum, size, test rows); stratum 1 or 0 is a class, -1 both together."""
    drawn = join_small(counts, with_split_plan(counts, by, test, fallback), by)
    stratum = F.when(F.col("__split_mode") == "random", F.lit(-1)).otherwise(F.col("__label"))
    wanted = (
        F.when(F.col("__split_mode") == "positional", F.lit(0))
        .when(F.col("__s") == 1, F.col("__test1"))
        .when(F.col("__s") == 0, F.col("__test0"))
        .otherwise(F.col("__n_test"))
    )
    sized = drawn.withColumn("__s", stratum).groupBy(*by, "__split_mode", "__s")
    return sized.agg(F.sum("__c").alias("__n_s"), F.max(wanted).alias("__k"))


def _per_class(strata: DataFrame) -> DataFrame:
    """Repeat a stratum of both classes for each class, so rows can be matched on theirs."""
    labels = F.when(F.col("__s") == -1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("__s"))
    return strata.drop("__label").withColumn("__label", F.explode(labels))


def _cut_offs(hashed: DataFrame, strata: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by..., cut-off per stratum): the hash of each stratum's last test row."""
    cells = cut_cells(hashed, strata, by)
    # rows of one full hash are equal: there is nothing to sort
    alike = F.length("__prefix") == HASH_DIGITS
    inside = _in_cells(hashed, cells.filter(~alike), by)
    rank = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h"))
    last = inside.withColumn("__rank", rank).filter(F.col("__rank") == F.col("__need"))
    found = last.select(*by, "__s", "__h").unionByName(cells.filter(alike).select(*by, "__s", F.col("__prefix").alias("__h")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__s") == s, F.col("__h"))).alias(n) for n, s in CUTS.items()])


def cut_cells(hashed: DataFrame, strata: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by..., stratum, prefix, size, need): the cell with the last test row of each stratum, and its rank in there.

    A cell holds the rows of its stratum whose hash starts with `prefix`: at most CELL_ROWS, unless all
    of them share one hash. Every pass counts the rows of the cells that are still too large, with
    partial counts before the shuffle, so n rows take about log(n / CELL_ROWS) / log(4,096) passes.
    """
    cells = strata.select(*by, "__s", F.lit("").alias("__prefix"), F.col("__n_s").alias("__size"), F.col("__k").alias("__need"))
    large = (F.col("__size") > CELL_ROWS) & (F.length("__prefix") < HASH_DIGITS)
    while not cells.filter(large).isEmpty():
        divided = _divide(_in_cells(hashed, cells.filter(large), by), by)
        cells = materialise(cells.filter(~large).unionByName(divided), "cells")
    return cells


def _in_cells(hashed: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return hashed.join(_per_class(cells), [*by, "__label"]).filter(F.col("__h").startswith(F.col("__prefix")))


def _divide(inside: DataFrame, by: Sequence[str]) -> DataFrame:
    """The part of each cell that holds its last test row, by as many further digits as half-full parts need."""
    digits = F.ceil(F.log(16.0, 2.0 * F.col("__size") / F.lit(CELL_ROWS))).cast("int")
    length = F.least(F.length("__prefix") + F.greatest(F.lit(1), F.least(digits, F.lit(PASS_DIGITS))), F.lit(HASH_DIGITS))
    upto = Window.partitionBy(*by, "__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    counts = inside.groupBy(*by, "__s", F.substring("__h", F.lit(1), length).alias("__part"), "__need")
    parts = counts.agg(F.count("*").alias("__c")).withColumn("__upto", F.sum("__c").over(upto))
    before = F.col("__upto") - F.col("__c")
    held = parts.filter((F.col("__upto") >= F.col("__need")) & (before < F.col("__need")))
    return held.select(
        *by, "__s", F.col("__part").alias("__prefix"), F.col("__c").alias("__size"), (F.col("__need") - before).alias("__need")
    )


def hashed_split(
    df: DataFrame, id_cols: str | Sequence[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test` by an independent draw per row, so the test share is approximate. Needs no shuffle."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    draw = F.conv(F.substring(row_hash(ids, seed), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))
    return df.withColumn("is_test", (draw < test).cast("int"))


def head_tail_split(df: DataFrame, order_by: str, by: Sequence[str] = (), train: float = 0.8) -> DataFrame:
    """Add `is_test`: the first floor(train * n) rows by the unique `order_by` are for training.

    Rows with a NULL `order_by` or group key stay, with a NULL `is_test`.
    """
    heads = order_statistics(df, by, order_by, {"__head": lambda n: F.floor(n * F.lit(train))})
    # no training rows at all leaves no last one; without an order or a group a row is in neither part
    behind = F.coalesce(F.col(order_by) > F.col("__head"), F.lit(True)).cast("int")
    known = _all_known([*by, order_by])
    return attach(df, heads, by, "left").select(*df.columns, F.when(known, behind).alias("is_test"))


def _all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for name in columns:
        known = known & F.col(name).isNotNull()
    return known
