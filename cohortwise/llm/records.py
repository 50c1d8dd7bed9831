"""Token ids in files of length-delimited binary records, with an index for shuffled reads.

A record is framed as

    length of the payload      8 bytes, little-endian
    masked checksum of these   4 bytes
    payload
    masked checksum of it      4 bytes
    line feed                  1 byte

and a payload holds a flag (1: `doc_id` is not NULL), the width of an id in bytes, the document's
id (8 bytes, signed) and its token ids, all little-endian. Ids take two bytes where the vocabulary
allows. The mask rotates a CRC-32 right by 15 bits and adds 0xa282ead8, so that a checksum of data
that holds checksums stays strong. Records are written through Spark's file writer, which commits
each task's file as a whole and works on any shared store; the line feed is that writer's row end.

The index (Parquet) comes from reading the files back and checking every frame. It has a row per
record with file name, byte offset, byte length, the numbers and checksum of its ids, and the number of
ids in all records before it; the folder may be moved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map
from cohortwise.llm.encoding import encoder

FILE_CHARACTERS = 24 * 2**20
"""Characters of text behind one file, about 20 MB of records."""

_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")
FRAME = _LENGTH.size + 2 * _SUM.size + 1


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload)), b"\n"))


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def read_frame(content: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, offset of the next record); a ValueError for a damaged record."""
    if at + FRAME > len(content):
        raise ValueError(f"record at {at} is cut off")
    length = content[at : at + 8]
    (size,), (check,) = _LENGTH.unpack(length), _SUM.unpack(content[at + 8 : at + 12])
    end = at + FRAME + size
    if check != masked(length) or end > len(content):
        raise ValueError(f"record at {at} has a damaged length")
    payload = content[at + 12 : at + 12 + size]
    if _SUM.unpack(content[end - 5 : end - 1])[0] != masked(payload):
        raise ValueError(f"record at {at} has a damaged payload")
    known, width, doc_id = _HEAD.unpack(payload[: _HEAD.size])
    return doc_id if known else None, np.frombuffer(payload[_HEAD.size :], f"<u{width}"), end


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every whole text (NULL: empty), append `end_id` and write records in ascending doc_id order.

    The numbers in file names ascend with doc_id, records in a file too; NULL ids come first, and rows
    with equal ids, in no particular order, are spread over files if they are many. The text is
    shuffled, not the ids, which are larger. A record is one text however long; an empty table gives no
    records.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    salted = docs.withColumn("__salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(1 + size // FILE_CHARACTERS, "doc_id", "__salt")
    ordered = dealt.sortWithinPartitions("doc_id", "__salt").drop("__salt")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer_path)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 2**16 else 4
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield {
                "record": [
                    frame(payload_of(doc, np.frombuffer(encode.ids(text) + end, "<u4"), width))[:-1]
                    for doc, text in rows
                ]
            }

    records = arrow_map(ordered, work, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(path)  # bytes as they are


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def scan_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read all record files front to back and check every frame.

    (file, byte_offset, byte_length, ids_before, doc_id, n_tokens, ids_crc32, ids); `ids_before`
    counts within the file, `ids` (little-endian, 32 bits) is NULL unless `with_ids`.
    """
    names = ("file", "byte_offset", "byte_length", "ids_before", "doc_id", "n_tokens", "ids_crc32", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(view):
                    doc, short, end = read_frame(view, at)
                    ids = short.astype("<u4").tobytes()
                    kept = ids if with_ids else None
                    rows.append((file, at, end - at, before, doc, len(short), zlib.crc32(ids), kept))
                    at, before = end, before + len(short)
                    if len(rows) == 1_000 or at >= len(view):
                        yield dict(zip(names, zip(*rows, strict=True), strict=True))
                        rows = []

    schema = (
        "file string, byte_offset long, byte_length long, ids_before long, "
        "doc_id long, n_tokens long, ids_crc32 long, ids binary"
    )
    return arrow_map(_files(spark, path), work, schema)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Scan the record files, check every frame and write the offset index."""
    scan_records(spark, path, with_ids=False).drop("ids").write.parquet(index_path)


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The index with `start`: ids of all records before. Only one row per file is summed in order."""
    index = spark.read.parquet(index_path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        index.groupBy("file")
        .agg(F.sum("n_tokens").alias("__n"))
        .withColumn("__part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))  # 100000 follows 99999
        .select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return index.join(files, "file").withColumn("start", F.col("__before") + F.col("ids_before")).drop("__before")


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the records that `index` names, read by offset in the index's row order per file.

    `index` may be any selection or shuffling of `read_index`; ids are little-endian 32-bit integers.
    """
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("byte_offset", "start")).alias("__at"))
    files = _files(spark, path).join(wanted, "file").select("content", "__at.byte_offset", "__at.start")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for content, offsets, starts in zip(*batch.columns, strict=True):
                view = memoryview(content.as_buffer())
                rows = list(zip(offsets.values.to_pylist(), starts.values.to_pylist(), strict=True))
                for k in range(0, len(rows), 1_000):
                    found = [(*read_frame(view, at)[:2], start) for at, start in rows[k : k + 1_000]]
                    yield {
                        "doc_id": [doc for doc, _, _ in found],
                        "start": [start for _, _, start in found],
                        "ids": [ids.astype("<u4").tobytes() for _, ids, _ in found],
                    }

    return arrow_map(files, work, "doc_id long, start long, ids binary")
