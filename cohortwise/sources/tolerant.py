"""Typed scans that survive bad tokens, and writes and reads that report on themselves in the same pass.

A token that does not fit its column's type becomes NULL and is kept beside the row as (column, token),
so one bad cell neither ends a job nor disappears. Counts of rows, NULLs and rejects come from
`observe` on the write that is done anyway; nothing is scanned a second time for a report.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.sources.specs import DatasetSpec

REJECTS = "rejects"
_REJECT_TYPE = "array<struct<column:string,token:string>>"
_FILE = re.compile(r"(?:reading|read) file:? ?'?([^\s'\"]+?)[.'\"]?(?:\s|$)", re.IGNORECASE)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` that `raw` has, in its types, and `rejects`: the tokens that fit none.

    Blanks around a token are no part of it; an empty token is NULL and no reject.
    """
    known = [f for f in schema.fields if f.name in raw.columns]
    tokens = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`").cast("string")), F.lit("")) for f in known}
    plain = [f for f in known if isinstance(f.dataType, T.StringType)]
    values = {f.name: F.col(f"`{f.name}`") if f in plain else tokens[f.name].try_cast(f.dataType) for f in known}
    bad = [
        F.when(tokens[f.name].isNotNull() & values[f.name].isNull(), F.struct(F.lit(f.name).alias("column"), tokens[f.name].alias("token")))
        for f in known
        if f not in plain
    ]
    found = F.filter(F.array(*bad), lambda r: r.isNotNull()) if bad else F.array()
    return raw.select(*[values[f.name].alias(f.name) for f in known], found.cast(_REJECT_TYPE).alias(REJECTS))


def scan(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """Header CSV scan of a declared dataset in its separator and types, with `rejects`."""
    raw = spark.read.option("header", True).option("sep", spec.sep).csv(path)
    return typed(raw, spec.schema)


def rejected_tokens(scanned: DataFrame) -> DataFrame:
    """Rows (column, token, n_rows): the side output of a scan, one row per different bad token."""
    each = scanned.select(F.explode(REJECTS).alias("r")).select("r.column", "r.token")
    return each.groupBy("column", "token").agg(F.count("*").alias("n_rows"))


def checks(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Aggregates of a validation report: rows, NULLs of `cols`, and rejects of `cols` where there are any to count."""
    known = [c for c in cols if c in df.columns]
    out = {"rows": F.count(F.lit(1))} | {f"null {c}": F.count_if(F.col(c).isNull()) for c in known}
    if REJECTS in df.columns:
        out |= {f"reject {c}": F.count_if(F.array_contains(F.col(REJECTS)["column"], c)) for c in known}
    return out


def write_checked(df: DataFrame, path: str, dataset: str, cols: Sequence[str]) -> DataFrame:
    """Write `df` without its rejects as Parquet; rows (dataset, check, value) counted by the same pass."""
    wanted, seen = checks(df, cols), Observation()
    observed = df.observe(seen, *[c.alias(name) for name, c in wanted.items()])
    observed.drop(REJECTS).write.mode("overwrite").parquet(path)
    values = seen.get
    rows = [(dataset, name, int(values[name])) for name in wanted]
    return df.sparkSession.createDataFrame(rows, "dataset string, check string, value bigint")


def damaged_file(message: str) -> str | None:
    """The file that a read error names."""
    found = _FILE.search(message)
    return found[1] if found else None


def source_status(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """One row per source: (dataset, status, n_rows, file, message).

    Every column of every row is read once, in a pass that keeps nothing, so damaged data pages are found
    as well as damaged footers; `file` names the file that cannot be read. A source that is missing or
    has no file is `unreadable` too.
    """
    rows = []
    for name, path in paths.items():
        seen = Observation()
        try:
            df = spark.read.format(fmt).option("header", True).load(path)
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            rows.append((name, "ok", int(seen.get["n"]), None, ""))
        except (PySparkException, Py4JJavaError) as error:
            rows.append((name, "unreadable", None, damaged_file(str(error)), str(error)))
    return spark.createDataFrame(rows, "dataset string, status string, n_rows bigint, file string, message string")
