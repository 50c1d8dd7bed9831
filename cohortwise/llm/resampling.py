"""Importance resampling of documents towards a target corpus by hashed word runs.

Features of a text are its runs of 1 to `order` consecutive words (lower-cased in A-Z, letters,
digits and all characters beyond ASCII), hashed into `buckets` by CRC-32. A batch of texts is joined
with a separator that no word holds; one regular expression pass finds all words of the batch, and
searching their places among the documents' offsets tells whose they are. Runs whose first and last
word are of different documents are masked; the others are counted with `bincount`.

Counts of the corpus and of the target, one number per bucket, are summed by Spark over all whole
texts and give a table of gains of fixed size. A document's weight is the sum of its features' gains,
its score adds Gumbel noise drawn from a hash of its id, and the highest scores are drawn: that is
sampling without replacement in proportion to the importance weights. Ranks come from range-partitioned
scores (`with_positions`), not from a window over all rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import WORD_CACHE, arrow_map, materialise
from cohortwise.operators.positions import with_positions

ORDER, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
SCALE = 1000
JOINED_BYTES = 4 * 2**20
"""Bytes of text that are joined at once; a longer text is joined alone."""
CHUNK_WORDS = 500_000

_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SENTINEL = b"\x00"


class Buckets(dict):
    """Word -> bucket. A bounded cache in front of CRC-32."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % self.buckets
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a separator after each, A-Z in lower case, and the offset at which each starts."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return _SENTINEL.join(texts).translate(_LOWER), starts


def features(texts: list[bytes], order: int, cache: Buckets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, words) in chunks: the text each feature is of, its bucket, and words counted per document."""
    line, offsets = joined(texts)
    found = _WORDS.finditer(line)
    words, owners = [], np.zeros(0, np.int64)
    while chunk := list(islice(found, CHUNK_WORDS)):
        at = np.fromiter((m.start() for m in chunk), np.int64, len(chunk))
        fresh = np.searchsorted(offsets, at, side="right") - 1
        kept = len(words)  # the last words of the chunk before, for runs across the border
        words += [m[0] for m in chunk]
        owners = np.concatenate([owners, fresh])
        parts = [(fresh, np.fromiter(map(cache.__getitem__, words[kept:]), np.int64, len(fresh)))]
        for size in range(2, order + 1):
            first = np.arange(max(0, kept - size + 1), len(words) - size + 1)
            first = first[owners[first] == owners[first + size - 1]]  # runs that stay in one document
            hashed = (zlib.crc32(b" ".join(words[i : i + size])) % cache.buckets for i in first.tolist())
            parts.append((owners[first], np.fromiter(hashed, np.int64, len(first))))
        tail = max(0, len(words) - order + 1)
        yield (*(np.concatenate(p) for p in zip(*parts, strict=True)), np.bincount(fresh, minlength=len(texts)))
        words, owners = words[tail:], owners[tail:]


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Row number of the first text and the texts (NULL: empty) of about `JOINED_BYTES` each."""
    begin, held, size = 0, [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > JOINED_BYTES:
            yield begin, held
            begin, held, size = row, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield begin, held


def feature_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket over all whole texts of the one column of `texts`; `buckets` numbers, whatever the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, run in _runs(batch, 0):
                for _, bucket, _ in features(run, order, cache):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield {"bucket": used, "n": total[used]}

    summed = arrow_map(texts, work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln) of the ratio of smoothed shares, target over corpus."""
    source, wanted = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    ratios = (((t + 1) * source) / ((s + 1) * wanted) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """floor(1000 * Gumbel variate) of a document, from eight hex digits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 2**32)))


def weighted(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words) of every row of (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache, own = Buckets(len(gain)), gain.astype(np.float64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, run in _runs(batch, 1):
                # sums of whole numbers far below 2^53 are exact in double precision
                number, weight, words = (np.zeros(len(run)) for _ in range(3))
                for doc, bucket, counted in features(run, order, cache):
                    number += np.bincount(doc, minlength=len(run))
                    weight += np.bincount(doc, own[bucket], len(run))
                    words += counted
                part, weight = ids[begin : begin + len(run)], weight.astype(np.int64)
                yield {
                    "doc_id": part,
                    "n_features": number.astype(np.int64),
                    "weight": weight,
                    "score": [None if i is None else w + noise(i, seed) for i, w in zip(part, weight.tolist(), strict=True)],
                    "n_words": words.astype(np.int64),
                }

    return arrow_map(docs, work, "doc_id long, n_features long, weight long, score long, n_words long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    order: int = ORDER,
    buckets: int = BUCKETS,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_features, weight, score, rank).

    `rank` numbers the floor(share * N / 100) highest scores from 1, N being the rows with an id and
    at least `least_words` words; ties go to the smaller id, then to fewer features and the smaller
    weight. All other rows have no rank. A NULL text has no words, no features and weight 0. A row
    without an id has no score and is never drawn, but its words are counted. Rows that repeat an id
    or a text are rows of their own. Texts of any length are read in chunks of words. Empty tables
    give no rows; an empty target counts nothing. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    corpus = feature_counts(docs.select("text"), order, buckets)
    wanted = feature_counts(target.select(F.col("text").cast("string")), order, buckets)
    rows = materialise(weighted(docs, gains(corpus, wanted), order, seed), "weighted")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = rows.filter(able).count() * share // 100
    best = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    ranked = with_positions(rows.filter(able), best, "rank").withColumn("rank", F.col("rank") + 1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, rank).union(rows.filter(~able).select(*names, F.lit(None).cast("long")))
