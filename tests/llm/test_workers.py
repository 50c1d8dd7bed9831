"""What Python workers keep from task to task."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pytest

from cohortwise.llm import common, encoding, near_dups, packing
from cohortwise.llm.common import arrow_map, settle


@pytest.fixture
def texts(spark):
    settle(spark)
    rows = [(k, " ".join(f"w{(k * 7 + i * i) % 997}" for i in range(40))) for k in range(640)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(32)


def kept(df) -> list[tuple[int, int]]:
    """(word hashes, vocabularies) that the workers of another operator's tasks hold, as these begin."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = sum(batch.num_rows for batch in batches)
        yield {"rows": [n], "hashes": [len(common._HASHES)], "vocabularies": [encoding.encoder.cache_info().currsize]}

    found = arrow_map(df, work, "rows long, hashes long, vocabularies long").collect()
    assert sum(r["rows"] for r in found) == 640
    return [(r["hashes"], r["vocabularies"]) for r in found]


def test_workers_drop_the_word_hashes_of_another_operator(texts):
    near_dups._signatures(texts, near_dups.idf_of({}, 640)).collect()
    assert set(kept(texts)) == {(0, 0)}


def test_workers_drop_the_vocabulary_of_another_operator(texts):
    packing.token_pieces(texts, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert set(kept(texts)) == {(0, 0)}


def test_caches_last_while_the_operator_does(monkeypatch):
    dropped = []
    monkeypatch.setattr(common, "_DROPS", [lambda: dropped.append(1)])
    monkeypatch.setattr(common, "_operator", None)
    for operator in ("one", "one", "two", "two", "one"):
        common.take_turn(operator)
    assert len(dropped) == 3
