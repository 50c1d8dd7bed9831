"""Best-fit-decreasing packing of token pieces into sequences of a fixed length.

Only the number of pieces of each length decides a best-fit-decreasing packing, and there are at
most `max_tokens` lengths. The histogram is packed on the driver: bins with equal content form one
group with a multiplicity, and a segment tree over remaining capacities finds the tightest open
group in logarithmic time. The plan is a bounded list of slots (length, rank range -> sequence,
offset). Spark then ranks the pieces of each length and every piece looks its slot up. Ranks come
from counts per (length, hash bucket), so a length that a third of all pieces have is spread over
all buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map, materialise
from cohortwise.llm.encoding import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
BUCKET_ROWS = 1_000


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than `most`."""
    first = total % most or most
    return [(0, min(first, total))] + [(at, most) for at in range(first, total, most)]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32, ids).

    A document is the ids of its whole text, NULL read as empty, and `end_id`; only longer ones are
    cut. `ids` (little-endian, 32 bits) is NULL unless `with_ids`. Rows with equal ids or a NULL
    `doc_id` are documents of their own; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer_path).ids
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, max_tokens)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(own), own if with_ids else None))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield dict(zip(names, zip(*rows, strict=True) if rows else [()] * 6, strict=True))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, PIECE)


class CapacityTree:
    """Segment tree over capacities 0..most; finds the smallest marked capacity that is at least `need`."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, capacity: int, value: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:  # up to the first right sibling that holds a mark, then down its left-most path
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal bins: (number of bins, [(length, pieces of it), ...]) in the order of filling.

    The same bins as placing pieces one by one, longest first, each into the tightest open bin: the
    bin just filled stays the tightest one while it has room, so it takes as many equal pieces as fit.
    """
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    tree = CapacityTree(capacity)

    def put(room: int, number: int, content: tuple) -> None:
        open_bins.setdefault(room, []).append((number, content))
        tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                put(capacity, -(-left // (capacity // length)), ())
                continue
            number, content = open_bins[room].pop()
            tree.mark(room, bool(open_bins[room]))
            each = room // length
            full = min(number, left // each)
            left -= full * each
            if full:
                put(room - each * length, full, (content, length, each))
            if full < number and left:  # fewer than `each`: the last bin of this length
                put(room - left * length, 1, (content, length, left))
                full, left = full + 1, 0
            if full < number:
                put(room, number - full, content)
    groups = []
    for room in sorted(open_bins):
        for number, content in open_bins[room]:
            parts = []
            while content:
                content, length, each = content
                parts.append((length, each))
            groups.append((number, parts[::-1]))
    return groups


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for number, parts in groups:
        offset = 0
        for length, each in parts:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, each, offset))
            taken[length] = rank + number * each
            offset += length * each
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """`pieces` (a written table with a `length` from 1 to `max_tokens`) with `sequence_id` and `offset`.

    Best-fit decreasing over all pieces; offsets in a sequence are gapless from 0. Which of several
    pieces of equal length takes which place is not specified. An empty table gives no rows.
    """
    names = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(best_fit_decreasing(counts, max_tokens))
    first = plan[:, 0] * 2**40 + plan[:, 1]  # sorted, as fewer than 2^40 pieces share a length
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    keys = [name for name in ("doc_id", "piece") if name in names]
    dealt = pieces.withColumn("__b", F.expr(f"pmod(xxhash64({', '.join(keys)}), {buckets})"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "__b")
        .agg(F.count("*").alias("__n"))
        .select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy("length", "__b").orderBy(*keys)
    ranked = (
        dealt.withColumn("__r", F.row_number().over(within) - 1)
        .join(offsets, ["length", "__b"])
        .select(*names, (F.col("__r") + F.col("__before")).alias("__rank"))
    )
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", sequence_id long, offset long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, length * 2**40 + rank, side="right") - 1
            place = rank - plan[at, 1]
            yield {n: batch.column(n) for n in names} | {
                "sequence_id": plan[at, 2] + place // plan[at, 3],
                "offset": plan[at, 4] + place % plan[at, 3] * length,
            }

    return arrow_map(ranked, work, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Encode, cut and pack whole documents; see `token_pieces` and `pack`. Pieces are written once before."""
    pieces = token_pieces(docs, tokenizer_path, max_tokens, end_id, with_ids)
    return pack(materialise(pieces, "token_pieces"), max_tokens)
