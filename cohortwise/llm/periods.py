"""Periodic runs of words, found by internal pattern matching, and their collapse to one period.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q, of at
least `least` words and `REPEATS` periods. Texts of a batch form one line of symbols; a symbol names a
word of one text, so nothing in one text equals anything in another.

1. Doubling names every stretch of 2^j words by its rank, from pairs of ranks of half the length; only
   stretches that are not yet unique are sorted again. The ranks answer how far two places agree, to
   either side, in a logarithmic number of steps.
2. Only places whose first `BLOCK` words occur again are of interest. They form a sparse suffix array
   with the agreement of neighbours; the places that start with the same b words are a range of it.
3. A wavelet tree over that range gives the next occurrence of a block after its own place (range
   successor). Asked for are unions of two or three neighbouring dyadic blocks, of 2^(k+1) words at
   multiples of 2^k and of 3 * 2^(k-1) words at multiples of 2^(k-1), and of `BLOCK` words at its
   multiples. Occurrences in the window of a block's own length behind it are an arithmetic
   progression, so the first one gives the difference: the block's smallest period.
4. The candidate period is extended to both sides. What is long enough is a run.

Every run is found: one of q words and 3 q words or more holds a block of b >= q words on the grid of
step g where q + b + g - 1 is at most the run's length, with its next occurrence q words later. For
q <= 8 that is 8 + 8 + 7 <= 24; for 2^k < q <= 1.5 * 2^k with b = 1.5 * 2^k, g = 2^(k-1); for
1.5 * 2^k < q <= 2^(k+1) with b = 2^(k+1), g = 2^k. A nearer occurrence would give the run a smaller
period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map, split_words

LEAST, REPEATS, BLOCK = 24, 3, 8
LINE_WORDS = 150_000
"""Words of a batch that are searched at once; a longer text is searched alone, with about 100 bytes a word."""

Run = tuple[int, int, int]
"""(start, length, period), in words of a text."""


class Line:
    """Symbols of some texts in a row, with the ranks of all stretches of 2^j of them."""

    def __init__(self, texts: list[list[bytes]]):
        self.starts = np.cumsum([0] + [len(w) for w in texts])
        self.ranks: list[np.ndarray] = []
        names: dict[bytes, int] = {}
        line = np.fromiter((names.setdefault(w, len(names)) for words in texts for w in words), np.int64, self.starts[-1])
        line += np.repeat(np.arange(len(texts)) * max(1, len(names)), np.diff(self.starts))
        self.size = len(line)
        self._double(line)

    def _double(self, line: np.ndarray) -> None:
        """Ranks by doubling. A rank is the place of the first equal stretch in sorted order, so unique ones keep theirs."""
        rank = np.zeros(self.size, np.int32)
        loose, old, low = np.arange(self.size), np.zeros(self.size, np.int64), line
        width = 1
        while True:  # `loose` places are not unique yet: their rank so far, and what follows it
            keys = (old << 32) + low
            order = np.argsort(keys)
            keys = keys[order]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[head, len(keys)])
            ranked = old[order]  # the old rank is where the old group begins; its parts follow each other
            group = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            base = ranked[head] + head - group[np.searchsorted(group, head, side="right") - 1]
            rank = rank.copy()
            rank[loose[order]] = np.repeat(base, sizes)
            self.ranks.append(rank)
            loose = loose[order[np.repeat(sizes > 1, sizes)]]
            if not len(loose):
                return
            old = rank[loose].astype(np.int64)
            after = loose + width
            low = np.where(after < self.size, rank[np.minimum(after, self.size - 1)].astype(np.int64) + 1, 0)
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a < b on agree."""
        far = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            ok = b + far + (1 << j) <= self.size
            at = np.flatnonzero(ok)
            at = at[self.ranks[j][(a + far)[at]] == self.ranks[j][(b + far)[at]]]
            far[at] += 1 << j
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places a < b agree."""
        far = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            at = np.flatnonzero(a - far >= 1 << j)
            at = at[self.ranks[j][(a - far)[at] - (1 << j)] == self.ranks[j][(b - far)[at] - (1 << j)]]
            far[at] += 1 << j
        return far

    def repeated(self, block: int) -> np.ndarray:
        """Places whose first `block` words (a power of two) occur again, in suffix order; ties cannot be."""
        j = block.bit_length() - 1
        if j >= len(self.ranks):
            return np.zeros(0, np.int64)
        rank = self.ranks[j]
        counts = np.bincount(rank, minlength=self.size)
        places = np.flatnonzero(counts[rank] > 1)
        return places[np.argsort(self.ranks[-1][places], kind="stable")]


class WaveletTree:
    """Wavelet matrix over a permutation's values for range successor queries, many at a time."""

    def __init__(self, values: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.zeros: list[np.ndarray] = []  # per level: zeros among the first i values
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            self.zeros.append(np.r_[0, np.cumsum(1 - bit)])
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def smaller(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Values below `bound` in each range [low, high)."""
        low, high, found = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            zl, zh = zeros[low], zeros[high]
            right = (bound >> level) & 1 == 1
            found += np.where(right, zh - zl, 0)
            low = np.where(right, zeros[-1] + low - zl, zl)
            high = np.where(right, zeros[-1] + high - zh, zh)
        return found

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of each range."""
        low, high, k, value = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            zl, zh = zeros[low], zeros[high]
            right = k >= zh - zl
            k = np.where(right, k - (zh - zl), k)
            value |= right.astype(np.int64) << level
            low = np.where(right, zeros[-1] + low - zl, zl)
            high = np.where(right, zeros[-1] + high - zh, zh)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest value above `after` in each range, -1 where there is none."""
        k = self.smaller(low, high, after + 1)
        some = k < high - low
        out = np.full(len(low), -1, np.int64)
        out[some] = self.kth(low[some], high[some], k[some])
        return out


def grids(longest: int) -> Iterator[tuple[int, int]]:
    """(block length, step) of the blocks asked for, as long as they are at most `longest`."""
    yield BLOCK, BLOCK
    half = BLOCK // 2
    while 3 * half <= longest:
        yield 3 * half, half
        yield 4 * half, 2 * half
        half *= 2


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """All runs of every text, by start and period; `least` is at least 24."""
    out: list[list[Run]] = [[] for _ in texts]
    if sum(map(len, texts)) < least:
        return out
    line = Line(texts)
    places = line.repeated(BLOCK)
    if not len(places):
        return out
    agree = np.r_[0, line.forward(np.minimum(places[1:], places[:-1]), np.maximum(places[1:], places[:-1])), 0]
    tree = WaveletTree(places, line.size)
    found = []
    for length, step in grids(int(agree.max())):
        cuts = np.flatnonzero(agree[:-1] < length)  # ranges of places that start with the same words
        ends = np.r_[cuts[1:], len(places)]
        group = np.repeat(np.arange(len(cuts)), ends - cuts)
        asked = np.flatnonzero((places % step == 0) & ((ends - cuts)[group] > 1))
        if not len(asked):
            continue
        at = places[asked]
        after = tree.successor(cuts[group[asked]], ends[group[asked]], at)
        near = (after > 0) & (after - at <= length)
        found.append(np.stack([at[near], after[near]]))
    if not found:
        return out
    at, after = np.concatenate(found, axis=1)
    period = after - at
    begin = at - line.backward(at, after)
    end = after + line.forward(at, after)
    enough = end - begin >= np.maximum(least, REPEATS * period)
    for s, e, q in sorted(set(zip(begin[enough].tolist(), end[enough].tolist(), period[enough].tolist(), strict=True))):
        text = int(np.searchsorted(line.starts, s, side="right")) - 1
        out[text].append((s - int(line.starts[text]), e - s, q))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(marks[:-1]).tolist(), strict=True) if not covered]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a periodic tail for about a tenth of all ids, the test input of the query."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, runs array<struct<start:long,length:long,period:long>>, "
    "collapsed string"
)


def _described(doc: int | None, words: list[bytes], runs: list[Run], with_text: bool) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    milli = 1000 * length // period if best else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(collapsed(words, runs))
    return (
        doc, len(runs), start, length, period, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(),
        len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] if with_text else None,
        kept.decode("utf-8", "replace") if with_text else None,
    )


def find_runs(
    docs: DataFrame,
    least: int = LEAST,
    with_text: bool = True,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per row of `docs`: runs, the most repeated one, and the text without repeated periods.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, runs,
    collapsed); the last two are NULL unless `with_text`. start, length, period and exponent_milli are
    those of the run with the greatest length / period, ties to the smallest start, then period; NULL
    without runs. Words are UTF-8 strings between the six ASCII white-space characters; `prepare` may
    change a document's words. A NULL or empty text has no words, and empty digests. Whole texts of any
    length are searched; repeated rows and NULL ids are rows as any other. An empty table gives no rows;
    other columns are ignored.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not searched for")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def described(held: list[tuple]) -> dict:
        found = runs_of([words for _, words in held], least)
        rows = [_described(doc, words, runs, with_text) for (doc, words), runs in zip(held, found, strict=True)]
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                words = prepare(doc, words) if prepare else words
                if held and size + len(words) > LINE_WORDS:
                    yield described(held)
                    held, size = [], 0
                held.append((doc, words))
                size += len(words)
        if held:
            yield described(held)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, SCHEMA)
