"""Packing of training examples under several limits at once: tokens, segments and loss-bearing tokens.

A sequence has a capacity in each of the three. The example that goes next into the open sequence is
the one whose demand points most in the direction of what is left: the largest dot product of the
two, each divided by the capacity and weighed by how scarce that capacity is (mean demand over the
capacity). Examples are packed in blocks of bounded size inside the tasks that hold them, so nothing
is shuffled, no task holds more than a block, and neither skew nor growth changes the work per row.

Documents may be cut. An example is then cut where the open sequence has less room than every one
left, so that a sequence is either full or, at a limit other than tokens and at the end of a block,
shortened to a power of two, for which no padding is needed; what is cut off returns to the pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map
from cohortwise.llm.encoding import encoder

BLOCK = 512
"""Examples that are packed together."""


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


class Pool:
    """Examples not yet placed, a row of demands each; those that exceed the capacity on their own are not open."""

    def __init__(self, demand: np.ndarray, capacity: np.ndarray):
        self.demand = np.ascontiguousarray(demand.T)  # a row per limit
        self.open = (demand <= capacity).all(axis=1)
        scarce = demand.mean(axis=0) / capacity if len(demand) else capacity
        self.scale = scarce / capacity**2

    def best(self, left: np.ndarray) -> int | None:
        """The fitting example with the largest dot product with `left`; the first of equal ones."""
        score = (left * self.scale) @ self.demand
        for demand, room in zip(self.demand, left.tolist(), strict=True):
            score[demand > room] = -1
        score[~self.open] = -1
        k = int(score.argmax()) if len(score) else 0
        return k if len(score) and score[k] >= 0 else None

    def largest(self) -> int | None:
        """The open example with the most tokens."""
        return int(np.where(self.open, self.demand[0], -1.0).argmax()) if self.open.any() else None


def pack_whole(demand: np.ndarray, limits: Limits) -> list[list[int]]:
    """Sequences of whole examples; those that exceed a limit on their own are in none.

    `demand` has a row (tokens, loss) per example.
    """
    capacity = limits.vector()
    rows = np.column_stack([demand[:, 0], np.ones(len(demand)), demand[:, 1]]).astype(np.float64)
    pool, out = Pool(rows, capacity), []
    while pool.open.any():
        left, content = capacity.copy(), []
        while (k := pool.best(left)) is not None:
            pool.open[k] = False
            left = left - rows[k]
            content.append(k)
        out.append(content)
    return out


def pack_cut(lengths: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length), every token in exactly one piece.

    All tokens of an example bear loss. No sequence but one whose length is a power of two is shorter
    than the smaller of the limits on tokens and loss.
    """
    size = min(limits.tokens, limits.loss)
    capacity = np.array([size, limits.segments], np.float64)
    rows = np.column_stack([lengths, np.ones(len(lengths))]).astype(np.float64)
    pool, out = Pool(rows, capacity), []
    pool.open, rest = lengths > 0, pool.demand[0]
    start = np.zeros(len(lengths), np.int64)

    def take(k: int, most: int, content: list) -> int:
        n = min(int(rest[k]), most)
        content.append((k, int(start[k]), n))
        start[k] += n
        rest[k] -= n
        pool.open[k] = rest[k] > 0
        return n

    while pool.open.any():
        content, room = [], size
        while room and len(content) < limits.segments:
            left = np.array([room, limits.segments - len(content)], np.float64)
            k = pool.best(left)
            if k is None:
                k = pool.largest()  # none fits whole: cut the one with the most tokens
            if k is None:
                break
            room -= take(k, room, content)
        used = size - room
        if used != size and used & (used - 1):  # give back what exceeds a power of two
            over = used - (1 << used.bit_length() - 1)
            while over:
                k, at, n = content.pop()
                back = min(n, over)
                over -= back
                start[k] -= back
                rest[k] += back
                pool.open[k] = True
                if n > back:
                    content.append((k, at, n - back))
        out.append(content)
    return out


def _sequence_base() -> int:
    """First sequence number of this task: the partition in the upper bits."""
    return TaskContext.get().partitionId() << 33


def pack_examples(examples: DataFrame, limits: Limits | None = None, block: int = BLOCK) -> DataFrame:
    """Whole examples in sequences: (example_id, n_tokens, n_loss, sequence_id, offset).

    `examples` has `example_id`, `n_tokens` and `n_loss`. NULL or negative numbers count as 0. An
    example that exceeds a limit on its own has a NULL sequence and offset. Offsets in a sequence are
    gapless from 0. Rows with equal or NULL ids are examples of their own; other columns are ignored;
    an empty table gives no rows. Ties in the dot product go to the row that comes first.
    """
    limits = limits or Limits()
    numbers = [F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c) for c in ("n_tokens", "n_loss")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base = _sequence_base()
        for batch in batches:
            ids, tokens, loss = batch.column(0), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for begin in range(0, len(tokens), block):
                own = slice(begin, begin + block)
                sequence, offset = ([None] * len(tokens[own]) for _ in range(2))
                for content in pack_whole(np.column_stack([tokens[own], loss[own]]), limits):
                    at = 0
                    for k in content:
                        sequence[k], offset[k] = base, at
                        at += int(tokens[own][k])
                    base += 1
                yield {
                    "example_id": ids.slice(begin, block), "n_tokens": tokens[own], "n_loss": loss[own],
                    "sequence_id": sequence, "offset": offset,
                }

    schema = "example_id long, n_tokens long, n_loss long, sequence_id long, offset long"
    return arrow_map(examples.select(F.col("example_id").cast("long"), *numbers), work, schema)


def conversation_examples(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """(example_id, n_tokens, n_loss) per conversation: every turn's ids and an end id; the assistant's turns bear loss.

    Turns of a NULL conversation are one example each, NULL texts are empty. Turns are counted one by
    one and summed by Spark, so a conversation of any length is no row of its own in a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer_path).ids
        for batch in batches:
            sizes = [len(encode(t)) // 4 + 1 for t in batch.column(2).to_pylist()]
            loss = [n if r == "assistant" else 0 for n, r in zip(sizes, batch.column(1).to_pylist(), strict=True)]
            yield {"conv_id": batch.column(0), "n_tokens": sizes, "n_loss": loss}

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    counted = arrow_map(turns, work, "conv_id long, n_tokens long, n_loss long")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = counted.withColumn("__alone", alone).groupBy("conv_id", "__alone")
    return grouped.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_loss").alias("n_loss")).select(
        F.col("conv_id").alias("example_id"), "n_tokens", "n_loss"
    )


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limits: Limits | None = None, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents in sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document is the ids of its whole text, NULL read as empty, and `end_id`, all bearing loss. Whole
    sequences are cut off its front; the rest is packed with the rests of other documents (`pack_cut`).
    Every id is in exactly one piece, a sequence is full or has a power of two of tokens, and offsets
    are gapless from 0. `ids` (little-endian, 32 bits) is NULL unless `with_ids`. Rows with equal or
    NULL ids and repeated texts are documents of their own. An empty table gives no rows; other
    columns are ignored. Of documents with equal lengths the one read first is placed first.
    """
    limits = limits or Limits()
    size = min(limits.tokens, limits.loss)
    names = [f.split()[0] for f in PIECE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer_path).ids
        end, sequence = end_id.to_bytes(4, "little"), _sequence_base()
        rests: list[tuple] = []
        rows: list[tuple] = []

        def piece(doc: int | None, total: int, ids: bytes, begin: int, at: int, n: int, offset: int) -> None:
            own = ids[4 * at : 4 * (at + n)]
            rows.append((doc, begin + at, n, zlib.crc32(own), total, sequence, offset, own if with_ids else None))

        def flush() -> Iterator[dict]:
            nonlocal rows
            if rows:
                yield dict(zip(names, zip(*rows, strict=True), strict=True))
                rows = []

        def settle_rests() -> Iterator[dict]:
            nonlocal sequence
            for content in pack_cut(np.array([len(r[2]) // 4 for r in rests], np.int64), limits):
                offset = 0
                for k, at, n in content:
                    piece(*rests[k], at, n, offset)
                    offset += n
                sequence += 1
            rests.clear()
            yield from flush()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                whole = total // size * size
                for at in range(0, whole, size):
                    piece(doc, total, ids, 0, at, size, 0)
                    sequence += 1
                    if len(rows) >= BLOCK:
                        yield from flush()
                if total > whole:
                    rests.append((doc, total, ids[4 * whole :], whole))
                if len(rests) >= BLOCK:
                    yield from settle_rests()
        yield from settle_rests()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, PIECE)
