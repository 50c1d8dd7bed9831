from __future__ import annotations

import pytest

from cohortwise.llm.common import settle

SMALL = "/root/testdata/sf0.001"
CLASHES = ("shard", "rep", "class", "keys", "band", "length", "tile", "url", "micro", "toxic", "phrase", "__rank")


@pytest.fixture(scope="session")
def small(spark) -> str:
    settle(spark)
    return SMALL


@pytest.fixture(scope="session")
def rows(spark, small) -> list[tuple]:
    """(doc_id, text) of the small table and of edge cases; only the edge cases repeat an id or have none."""
    found = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    top = max(i for i, _ in found)
    long = " ".join(f"w{k * k % 9973}" for k in range(30_000))
    edges = [None, "", " \t\n", "one", "a b c d", "..., | |", long, long, found[0][1], found[0][1], "\u4e2d\u6587 \u00a0x\u2003y \U0001f600"]
    edges += ["  two  spaces\n\nand lines ", "tab\tand\r\nreturn", "<|endoftext|> it's", "x" * 50_000]
    return found + [(top + 1 + k, t) for k, t in enumerate(edges)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns of clashing names, a NULL id and a row that is there twice."""
    more = [*rows, (None, rows[1][1]), (None, None), rows[2]]
    frame = spark.createDataFrame(more, "doc_id long, text string").repartition(5)
    for name in CLASHES:
        frame = frame.withColumn(name, frame["doc_id"])
    return frame


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
