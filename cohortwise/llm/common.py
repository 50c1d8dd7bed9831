"""Helpers the operators of this package share."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortwise.session import materialise, tune

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

__all__ = ["arrow_map", "drop_between_operators", "hash_words", "materialise", "settle", "split_words", "table", "take_turn"]

BATCH_ROWS = "500"
"""Rows of one Arrow batch: texts are long, so a batch is kept to a few megabytes."""

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

WORD_CACHE = 600_000
"""Entries a per-process word cache takes; words met after that are worked out each time."""

_DROPS: list[Callable[[], object]] = []
_operator: str | None = None


def settle(spark: SparkSession, batch_rows: str = BATCH_ROWS) -> SparkSession:
    """Session settings for queries over long texts: skew splitting and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:  # Python workers import this package by name
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_between_operators(drop: Callable[[], object]) -> None:
    """Have `drop` empty a per-process cache when a Python worker goes on to the tasks of another operator."""
    _DROPS.append(drop)


def take_turn(operator: str) -> None:
    """Called as a task of `operator` (a module's name) begins: what tasks of another one kept is dropped.

    Python workers outlive tasks and stages. Without this they hold the caches of all operators that they
    ever worked for.
    """
    global _operator
    if operator != _operator:
        for drop in _DROPS:
            drop()
        gc.collect()  # what a cache held may refer to itself
        give_back()
        _operator = operator


def give_back() -> None:
    """Return free memory to the system, of Arrow's pool and of the C library; both keep it else, worker by worker."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def arrow_map(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict | pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """`mapInArrow` for functions that yield dictionaries of columns, in the order of `schema`."""
    types, operator = arrow_schema(schema), work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(operator)
        for out in work(batches):
            yield out if isinstance(out, pa.RecordBatch) else record_batch(out, types)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def record_batch(columns: dict, types: pa.Schema) -> pa.RecordBatch:
    arrays = [
        columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type, from_pandas=False)
        for f in types
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=types)


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words between runs of the six ASCII white-space characters; none for NULL."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash. A bounded cache in front of xxhash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


_HASHES = WordHashes()
drop_between_operators(_HASHES.clear)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
