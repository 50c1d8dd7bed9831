"""Benchmark decontamination: BM25 search of every training passage in an inverted index of test items.

Passages are runs of words of a document, overlapping by half, and at least twice as long as the
longest item, so an item quoted whole lies in one passage whole. A passage is the query, items are
what is searched. An item's score is the BM25 sum of its words that the passage holds, divided by
the sum of all its words: 1 if the passage holds them all. Every item of at least MATCH is retrieved.

Block-max WAND over blocks of items with neighbouring numbers: for every word and block the largest
contribution is known, and a block whose largest contributions do not reach MATCH together is
skipped. These sums are taken for all passages of a batch at once; in the blocks that remain, WAND
moves through the posting lists from pivot to pivot.

A retrieved pair is a leak if the passage also holds at least OVERLAP of the five-word runs of the
item's question and of its answer, or if WHOLE of all its words stand in runs of at least three words
that the passage holds: a changed word or a missing sentence does not hide the rest. The answer is
the item's last sentence.

The index is built for at most SEGMENT_ITEMS items; a larger benchmark is searched segment by
segment, so what tasks receive has a bound. Number and mean length of items, document frequencies
and the length of passages are those of the whole benchmark in every segment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import WORD_CACHE, arrow_map, materialise

MATCH = 0.6
OVERLAP = 0.5
WHOLE = 0.6
K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
SEGMENT_ITEMS = 1_000
SEGMENT_CHARACTERS = 4_000_000
RUN = 5
SHORT_RUN = 3
SUB_BATCH = 100

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal(word: str) -> str:
    """Lower case without marks at either end; empty for a word of marks."""
    return _EDGES.sub("", word.lower())


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and the rest. One sentence alone is cut behind three quarters."""
    parts = [p for p in map(normal_words, _SENTENCE.split(text)) if p]
    answer = parts.pop() if parts else []
    while parts and len(answer) < 3:
        answer = parts.pop() + answer
    question = [w for p in parts for w in p]
    if not question:
        cut = len(answer) - len(answer) // 4
        question, answer = answer[:cut], answer[cut:]
    return question, answer


def runs(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's word runs that the passage holds; 1 for an empty part."""
    if not part:
        return 1.0
    size = min(RUN, len(part))
    own = runs(part, size)
    return len(own & runs(passage, size)) / len(own)


def covered(item: list[str], passage: list[str]) -> float:
    """Share of the item's words in runs of SHORT_RUN words, or of all if it has fewer, that the passage holds."""
    size = min(SHORT_RUN, len(item))
    held, at = runs(passage, size), set()
    for i in range(len(item) - size + 1):
        if tuple(item[i : i + size]) in held:
            at.update(range(i, i + size))
    return len(at) / len(item)


class Statistics(NamedTuple):
    """Of all items with words: their number, words, longest item, and how many hold each word."""

    items: int
    words: int
    longest: int
    held: dict[str, int]


class Index:
    """Posting lists of normalised BM25 contributions, with their largest by word and block.

    `whole` are the statistics of the benchmark that `items` are a segment of; without it, they are all.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        items = [(i, text, normal_words(text)) for i, text in sorted(items, key=lambda x: (x[0], x[1]))]
        items = [x for x in items if x[2]]
        self.ids = [i for i, _, _ in items]
        self.parts = [question_answer(text) for _, text, _ in items]
        counts = [Counter(w) for _, _, w in items]
        held = Counter(w for c in counts for w in c)
        sizes = [len(w) for _, _, w in items]
        whole = whole or Statistics(len(items), sum(sizes), max(sizes, default=1), held)
        self.half = max(32, whole.longest)  # words of half a passage
        mean = whole.words / max(whole.items, 1)
        idf = {w: np.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for w in held for n in [whole.held[w]]}
        self.terms = {w: k for k, w in enumerate(sorted(held))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in held]
        for item, count in enumerate(counts):
            size = K1 * (1 - B + B * sum(count.values()) / mean)
            gain = {w: idf[w] * n * (K1 + 1) / (n + size) for w, n in count.items()}
            full = sum(gain.values())
            for w, g in gain.items():
                self.postings[self.terms[w]].append((item, g / full))
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.largest = np.zeros((len(held), blocks), np.float32)
        for term, postings in enumerate(self.postings):
            for item, g in postings:
                self.largest[term, item // BLOCK_ITEMS] = max(self.largest[term, item // BLOCK_ITEMS], g)

    def search(self, terms: list[int], blocks: list[int], match: float) -> list[tuple[int, float]]:
        """WAND inside the given blocks: items whose contributions from `terms` sum up to `match` at least."""
        out = []
        for block in blocks:
            low, high = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
            lists = []
            for t in terms:
                if top := float(self.largest[t, block]):
                    own = [p for p in self.postings[t] if low <= p[0] < high]
                    lists.append([0, own, top])
            while lists:
                lists.sort(key=lambda x: x[1][x[0]][0])
                bound, pivot = 0.0, None
                for k, (_, _, top) in enumerate(lists):
                    bound += top
                    if bound >= match - 1e-6:
                        pivot = k
                        break
                if pivot is None:
                    break
                item = lists[pivot][1][lists[pivot][0]][0]
                if lists[0][1][lists[0][0]][0] == item:
                    score = 0.0
                    for x in lists:
                        if x[1][x[0]][0] == item:
                            score += x[1][x[0]][1]
                            x[0] += 1
                    if score >= match - 1e-9:
                        out.append((item, score))
                else:
                    for x in lists[:pivot]:
                        while x[0] < len(x[1]) and x[1][x[0]][0] < item:
                            x[0] += 1
                lists = [x for x in lists if x[0] < len(x[1])]
        return out


class Terms(dict):
    """Word as written -> number of its term; -1 if no item holds it, -2 for a word of marks."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        plain = normal(word)
        number = self.terms.get(plain, -1) if plain else -2
        if len(self) < WORD_CACHE:
            self[word] = number
        return number


def leaks(texts: list[str | None], index: Index, cache: Terms, match: float, least: float) -> Iterator[tuple]:
    """(text number, item number, first word of the best passage, score, question and answer overlap)."""
    words = [(t or "").split() for t in texts]
    numbers = [np.fromiter(map(cache.__getitem__, w), np.int32, len(w)) for w in words]
    numbers = [n[n != -2] for n in numbers]
    halves = [max(1, -(-len(n) // index.half)) for n in numbers]
    base = np.r_[0, np.cumsum(halves)]
    half = np.concatenate([b + np.arange(len(n)) // index.half for b, n in zip(base, numbers, strict=False)])
    flat = np.concatenate(numbers).astype(np.int64)
    known = flat >= 0
    keys = np.unique(half[known].astype(np.int64) * len(index.terms) + flat[known])
    of, term = np.divmod(keys, max(len(index.terms), 1))
    bound = np.zeros((int(base[-1]) + 1, index.largest.shape[1]), np.float32)
    if len(keys):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        bound[of[starts]] = np.add.reduceat(index.largest[term], starts, axis=0)
    both = bound[:-1] + bound[1:]  # a passage is a half and the next one
    last = base[1:] - 1
    both[last] = bound[last]
    hits = both >= match - 1e-4
    for k in np.flatnonzero(hits.any(axis=1)).tolist():
        i = int(np.searchsorted(base, k, side="right")) - 1
        start = (k - int(base[i])) * index.half
        terms = numbers[i][start : start + 2 * index.half]
        found = index.search(np.unique(terms[terms >= 0]).tolist(), np.flatnonzero(hits[k]).tolist(), match)
        passage = None
        for item, score in found:
            if passage is None:
                passage = [w for w in map(normal, words[i]) if w][start : start + 2 * index.half]
            parts = index.parts[item]
            question, answer = (overlap(part, passage) for part in parts)
            if (question >= least and answer >= least) or covered(parts[0] + parts[1], passage) >= WHOLE - 1e-9:
                yield i, item, start, score, question, answer


def _item_words(items: DataFrame) -> DataFrame:
    """(word, size) of every item with words: a row per different word, and one with its number of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = [w for w in map(normal_words, batch.column(0).to_pylist()) if w]
            different = [x for w in own for x in set(w)]
            yield {"word": [None] * len(own) + different, "size": [len(w) for w in own] + [None] * len(different)}

    return arrow_map(items.select("text"), work, "word string, size long")


def _indices(items: DataFrame) -> Iterator[Index]:
    """The index of every segment of the benchmark that holds items with words."""

    def index(segment: DataFrame, whole: Statistics | None = None) -> Index:
        return Index([(-1 if r[0] is None else r[0], r[1]) for r in segment.collect()], whole)

    n, size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(-(-n // SEGMENT_ITEMS), -(-(size or 0) // SEGMENT_CHARACTERS))
    if parts <= 1:
        found = [index(items)] if n else []
    else:
        totals = _item_words(items).groupBy("word").agg(
            F.count("*").alias("items"), F.sum("size").alias("words"), F.max("size").alias("longest")
        )
        totals = materialise(totals, "benchmark_words")
        whole = totals.filter("word IS NULL").select("items", "words", "longest").first()
        # a random half more than the mean never comes near the next power of two at these sizes
        segments = [items.filter(F.expr(f"pmod(xxhash64(item_id, text), {2 * parts}) = {k}")) for k in range(2 * parts if whole else 0)]
        own = (_item_words(s).select("word").distinct().join(totals.select("word", "items"), "word").collect() for s in segments)
        found = (index(s, Statistics(*whole, dict(map(tuple, held)))) for s, held in zip(segments, own, strict=True))
    return (x for x in found if x.ids)


def find_leaks(docs: DataFrame, items: DataFrame, match: float = MATCH, least: float = OVERLAP) -> DataFrame:
    """One row per document row and item it leaks, of its best passage.

    (doc_id, item_id, first_word, score, question_overlap, answer_overlap). Words are compared in
    lower case without marks around them. NULL and empty texts and items without words leak nothing.
    Repeated rows, also of items, give as many rows; NULL ids stay NULL. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    schema = (
        "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indices(items):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[dict]:
            cache = Terms(index.terms)
            for batch in batches:
                ids, texts = (c.to_pylist() for c in batch.columns)
                best: dict = defaultdict(lambda: (0, 0.0, -1.0))
                for k in range(0, len(texts), SUB_BATCH):
                    for i, item, start, score, q, a in leaks(texts[k : k + SUB_BATCH], index, cache, match, least):
                        best[k + i, item] = max(best[k + i, item], (q + a, score, -start, q, a))
                rows = [(ids[i], index.ids[item], -v[2], v[1], v[3], v[4]) for (i, item), v in best.items()]
                yield dict(zip(names, zip(*rows, strict=True) if rows else [()] * 6, strict=True))

        out = out.union(arrow_map(docs, work, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, match: float = MATCH, least: float = OVERLAP) -> DataFrame:
    """Rows of `docs` in which no item is found, unchanged."""
    at = docs.columns.index("text")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    for index in _indices(items):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            cache = Terms(index.terms)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for k in range(0, len(texts), SUB_BATCH):
                    for i, *_ in leaks(texts[k : k + SUB_BATCH], index, cache, match, least):
                        keep[k + i] = False
                yield batch.filter(pa.array(keep))

        docs = arrow_map(docs, work, docs.schema)
    return docs
