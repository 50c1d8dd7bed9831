"""Removal of passages that repeat an earlier document.

A window is `width` consecutive words. A word goes if a window over it also starts in a document with
a smaller id. Windows are never shuffled as a whole; the steps narrow them down:

1. Seeds. In every window the phrase of `seed` words with the smallest hash is chosen. Equal windows
   choose equal phrases, and a document chooses about one phrase for every 22 words. Phrases chosen
   by documents with different ids are kept, together with the document shards they occur in.
2. Automata. Documents and kept phrases meet by shard (a hash of doc_id, about `SHARD_CHARACTERS`
   of text). Every shard compiles an Aho-Corasick automaton over its phrases as word sequences and
   streams its documents through it; windows whose chosen phrase occurs are candidates. A document
   passes one automaton, so the work grows with the text.
3. Confirmation. Candidate windows, hashed to 96 bits and reduced to one row per shard, meet by hash.
   Those with two different ids go back to their shards with the smallest id.
4. Removal. Each shard reads its documents again and takes out covered words.

A phrase or window that a third of all documents share is one row per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map, arrow_schema, hash_words, materialise, record_batch, split_words, take_turn

WIDTH, SEED = 50, 8
SHARD_CHARACTERS = 6 * 2**20
SUB_BATCH = 200

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so powers can be inverted


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of `width` words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(n, base, np.uint64))
    inverse = np.cumprod(np.full(n - width + 1, pow(base, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    return _mix((sums[width:] - sums[:-width]) * inverse)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every run of `width` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Texts:
    """Words of some documents in one array; windows never cross from one document to the next."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words = [split_words(t) if i is not None else [] for i, t in zip(ids, texts, strict=True)]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = hash_words([w for words in self.words for w in words])
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)

    def starts(self, width: int) -> np.ndarray:
        """Whether a window of `width` words starts at a word."""
        return np.arange(len(self.hashes)) + width <= self.ends[self.owner]

    def doc_ids(self, at: np.ndarray) -> np.ndarray:
        known = np.array([0 if i is None else i for i in self.ids], np.int64)
        return known[self.owner[at]]


def seeds(texts: Texts, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, document) pairs: start of the phrase in the word array, and start of a window that chose it."""
    phrase = rolling(texts.hashes, seed, _BASES[0])
    smallest = sliding_min(phrase, width - seed + 1)
    windows = np.flatnonzero(texts.starts(width))
    chosen = smallest[windows]
    fresh = np.ones(len(windows), bool)  # neighbouring windows mostly choose the same phrase
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (texts.owner[windows[1:]] != texts.owner[windows[:-1]])
    windows, chosen = windows[fresh], chosen[fresh]
    order = np.argsort(phrase, kind="stable")
    return order[np.searchsorted(phrase, chosen, sorter=order)], windows


def _batches(table: pa.Table | pa.RecordBatch) -> Iterator[Texts]:
    for k in range(0, table.num_rows, SUB_BATCH):
        part = table.slice(k, SUB_BATCH)
        yield Texts(part.column("doc_id").to_pylist(), part.column("text").to_pylist())


def _seed_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            shard = {i: s for i, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard")), strict=True)}
            for texts in _batches(batch):
                at, windows = seeds(texts, width, seed)
                symbols = np.lib.stride_tricks.sliding_window_view(texts.hashes.astype("<u4"), seed)[at] if len(at) else []
                ids = texts.doc_ids(windows).tolist() if len(at) else []
                yield {"phrase": [s.tobytes() for s in symbols], "shard": [shard[i] for i in ids], "doc_id": ids}

    return arrow_map(docs, work, "phrase binary, shard int, doc_id long")


def _met(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Keys that occur under two different ids: a row per shard, with the smallest id."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(low).alias("first"), F.max(high).alias("__last"), F.collect_set("shard").alias("__shards"))
        .filter("first < __last")
        .select(*keys, "first", F.explode("__shards").alias("shard"))
    )


def automaton(phrases: Iterator[bytes]) -> ahocorasick.Automaton | None:
    """Of phrases as four symbols a word: a node's children are searched in turn, and words would give the root thousands."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for phrase in phrases:
        found.add_word(phrase.decode("latin-1"), True)
    if not len(found):
        return None
    found.make_automaton()
    return found


def candidates(texts: Texts, found: ahocorasick.Automaton, width: int, seed: int) -> np.ndarray:
    """Starts of the windows whose chosen phrase, the one of smallest hash, the automaton finds in them."""
    if len(texts.hashes) < width:
        return np.zeros(0, np.int64)
    symbols = texts.hashes.astype("<u4").tobytes().decode("latin-1")
    ends = np.fromiter((last for last, _ in found.iter(symbols)), np.int64) + 1
    hits = ends[ends % 4 == 0] // 4 - seed  # the others lie across words
    phrase = rolling(texts.hashes, seed, _BASES[0])
    repeated = np.full(len(phrase), np.iinfo(np.uint64).max)
    repeated[hits] = phrase[hits]
    chosen = sliding_min(repeated, width - seed + 1) == sliding_min(phrase, width - seed + 1)
    starts = texts.starts(width)[: len(chosen)]
    return np.flatnonzero(chosen & starts)


def _window_keys(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    first = rolling(texts.hashes, width, _BASES[0]).view(np.int64)
    second = (rolling(texts.hashes, width, _BASES[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return first, second


def _candidate_rows(docs: DataFrame, phrases: DataFrame, width: int, seed: int) -> DataFrame:
    schema = "h1 long, h2 int, shard int, low long, high long"
    types = arrow_schema(schema)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        take_turn(__name__)
        out = []
        found = automaton(right.column("phrase").to_pylist()) if right.num_rows else None
        for texts in _batches(left) if found else ():
            at = candidates(texts, found, width, seed)
            h1, h2 = (h[at] for h in _window_keys(texts, width)) if len(at) else (at, at)
            out.append((h1, h2, texts.doc_ids(at) if len(at) else at))
        h1, h2, ids = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((ids, h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else order
        tail = np.r_[head[1:], len(h1)] - 1 if len(h1) else order
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        rows = {"h1": h1[head], "h2": h2[head].astype(np.int32), "low": ids[head], "high": ids[tail]}
        return pa.Table.from_batches([record_batch(rows | {"shard": np.full(len(head), shard, np.int32)}, types)])

    return docs.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(work, schema)


def _strip(docs: DataFrame, repeated: DataFrame, width: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    types = arrow_schema(schema)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        take_turn(__name__)
        h1, h2, first = (right.column(c).to_numpy() for c in ("h1", "h2", "first"))
        order = np.lexsort((h2, h1))
        h1, h2, first = h1[order], h2[order], first[order]
        out = []
        for k in range(0, left.num_rows, SUB_BATCH):
            part = left.slice(k, SUB_BATCH)
            ids, raw = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            texts = Texts(ids, raw)
            gone = covered(texts, h1, h2, first, width)
            rows = []
            for i, (doc, text, end) in enumerate(zip(ids, raw, texts.ends.tolist(), strict=True)):
                words = texts.words[i] if doc is not None else split_words(text)
                drop = gone[end - len(texts.words[i]) : end]
                kept = words if not drop.any() else [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                joined = b" ".join(kept)
                digest = hashlib.sha256(joined).hexdigest()
                text = joined.decode("utf-8", "replace") if with_text else None
                rows.append((doc, len(words), len(words) - len(kept), digest, text))
            out.append(record_batch(dict(zip(types.names, zip(*rows, strict=True), strict=True)), types))
        return pa.Table.from_batches(out, schema=types)

    return docs.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(work, schema)


def covered(texts: Texts, h1: np.ndarray, h2: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words under a window that starts in an earlier document; the repeated windows are sorted by both hashes."""
    windows = np.flatnonzero(texts.starts(width)) if len(h1) else np.zeros(0, np.int64)
    marks = np.zeros(len(texts.hashes) + 1, np.int64)
    if len(windows):
        own1, own2 = (h[windows] for h in _window_keys(texts, width))
        at = np.searchsorted(h1, own1)
        for _ in range(1 + _longest_run(h1)):  # equal first hashes are next to each other
            safe = np.minimum(at, len(h1) - 1)
            hit = (at < len(h1)) & (h1[safe] == own1) & (h2[safe] == own2) & (first[safe] < texts.doc_ids(windows))
            np.add.at(marks, windows[hit], 1)
            np.add.at(marks, windows[hit] + width, -1)
            at = at + 1
    return np.cumsum(marks[:-1]) > 0


def _longest_run(sorted_values: np.ndarray) -> int:
    """How many equal neighbours follow a value at most; 0 unless two hashes collide."""
    run, same = 0, sorted_values[1:] == sorted_values[:-1]
    while same.any():
        run += 1
        same = same[1:] & same[:-1]
    return run


def strip_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_words, n_removed, kept_sha256, kept).

    `kept` is NULL unless `with_text`. Words are the UTF-8 strings between the white-space characters U+0020 and U+0009 to U+000D; a
    NULL text has none. Rows with the same id are one document's parts: they never remove words from
    each other. Rows without an id lose nothing and remove nothing. Documents shorter than `width`
    keep all words. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    docs = docs.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id), {1 + size // SHARD_CHARACTERS}) as int)"))
    phrases = _met(_seed_rows(docs, width, seed), ["phrase"], "doc_id", "doc_id").select("phrase", "shard")
    rows = _candidate_rows(docs, materialise(phrases, "repeated_phrases"), width, seed)
    repeated = _met(rows, ["h1", "h2"], "low", "high")
    return _strip(docs, repeated, width, with_text)
