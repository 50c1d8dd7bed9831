"""Readers and writers: delimited text, Parquet zone tables, results, source status."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.sources.specs import DatasetSpec

# Encodings tried for delimited files and the separators. The strictest encoding comes
# first: UTF-8 refuses most other bytes, windows-1252 five of them, and ISO-8859-1 none.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
SEPARATORS = (";", ",")
# what stands for bytes that an encoding cannot read
REPLACEMENT = "\ufffd"
# Spark has no windows-1252: it is ISO-8859-1 with other characters in place of the upper control codes
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_IN_WINDOWS = _CONTROLS.encode("latin-1").decode("cp1252", "replace")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Header CSV scan. With a schema, columns are matched to the header by name; without, types are inferred.

    A token that does not fit its type is NULL; `tolerant.scan` also reports it.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    raw = reader.csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType) for f in schema.fields if f.name in raw.columns])


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    must_have: str,
    seps: Iterable[str] = SEPARATORS,
    encodings: Iterable[str] = ENCODINGS,
    min_rows: int = 10,
) -> DataFrame:
    """First (encoding, separator) reading of the file that has column `must_have`, more than `min_rows` rows
    and no byte that the encoding cannot read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for encoding in encodings:
        for sep in seps:
            probe = _read_encoded(spark, paths, encoding, sep)
            accepted = must_have in probe.columns and probe.limit(min_rows + 1).count() > min_rows
            if accepted and _readable(probe):
                return _read_encoded(spark, paths, encoding, sep, infer=True)
    raise ValueError(f"no candidate encoding and separator gives column {must_have!r} in {paths}")


def _read_encoded(spark: SparkSession, paths: Sequence[str], encoding: str, sep: str, infer: bool = False) -> DataFrame:
    windows = encoding == "windows-1252"
    options = {"header": True, "sep": sep, "encoding": "ISO-8859-1" if windows else encoding, "inferSchema": infer}
    df = spark.read.options(**options).csv(list(paths))
    if not windows:
        return df
    names = [name.translate(str.maketrans(_CONTROLS, _IN_WINDOWS)) for name in df.columns]
    values = [F.translate(f"`{c}`", _CONTROLS, _IN_WINDOWS) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*[value.alias(name) for value, name in zip(values, names, strict=True)])


def _readable(probe: DataFrame) -> bool:
    if any(REPLACEMENT in name for name in probe.columns):
        return False
    whole = F.concat_ws("", *[F.col(f"`{name}`") for name in probe.columns])
    return probe.filter(F.contains(whole, F.lit(REPLACEMENT))).isEmpty()


def read_semicolon(spark: SparkSession, paths: str | Sequence[str], must_have: str = "G3") -> DataFrame:
    """A `;` file of any length in the first encoding that reads it."""
    return read_delimited(spark, paths, must_have, seps=(";",), min_rows=0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet zone table.

    With `partition_by`, rows are rebalanced by the partition keys first: adaptive execution splits a
    hot key by size over as many tasks as it needs and merges small ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def with_ingest_time(df: DataFrame, col: str = "ingest_timestamp") -> DataFrame:
    return df.withColumn(col, F.current_timestamp())


def run_all(
    specs: Mapping[str, DatasetSpec], op: Callable[[DatasetSpec], DataFrame]
) -> dict[str, DataFrame]:
    """Apply one operator to every declared dataset; the results stay lazy."""
    return {name: op(spec) for name, spec in specs.items()}


def register(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite a result table as json, csv, parquet or text.

    A text line holds a row as `column: value, ...`; the value of a NULL is empty.
    """
    if fmt == "text":
        line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)
