"""Masked pseudo-likelihood of documents with a bidirectional window network.

Every word is predicted from the two words on either side. A word is reached in three steps, each
with probabilities that add up to one: a group of leaves, a leaf of the group, the word in its leaf.

1. Bundles. Documents are read once; about `BUNDLE_WORDS` words make one row: the different words as
   64-bit hashes with their counts, and the text as positions in that list.
2. Words. The exact count of every word of the corpus is a Spark table; it grows with the corpus.
3. Leaves. V different words have at most 3 * sqrt(V) + 252 leaves: words with at least 1/sqrt(V) of
   all occurrences have one each, the others are divided by frequency and, where many words are about
   equally frequent, by hash. So leaves grow finer with the corpus, and the rule needs on the driver at
   most sqrt(V) frequent words, 252 classes of frequency and the size of every leaf.
4. Codes. Every bundle gets the counts of its own words by joins and stores the leaf of every word.
   Neither the table of words nor a text reaches the driver or one task as a whole.
5. Network. An embedding per leaf and relative position, their sum through tanh, a softmax over groups
   and one over the leaves of the word's group. It is trained in numpy on every word of the corpus:
   each task runs Adam over its bundles from common starting weights, and the weights are averaged by
   words (one round of parameter averaging). Its weights grow with sqrt(V).

P(word | leaf) is (n + 1) / (sum of n + number of words of the leaf + 1); what is left is for unseen
words. Places beyond a document's ends are a context of their own. A document's pseudo-log-likelihood
is the sum of the logarithms over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map, arrow_schema, hash_words, materialise, record_batch, split_words, take_turn

HIDDEN = 16
OFFSETS = (-2, -1, 1, 2)
SIDE = 2
BUNDLE_WORDS = 2**20
SMALLEST_BATCH = 2_048
RATE = 0.02
BINS = 4 * 63
"""Classes of frequency: four for every doubling of the count."""
HIGHEST = np.float32(60)
"""Logits are cut here, so that exponentials stay in range."""

_BUNDLE = "bundle long, doc_ids array<long>, sizes array<long>, words array<long>, counts array<long>, places binary"
_CODED = "doc_ids array<long>, sizes array<long>, inside array<double>, leaves binary"
_SCORES = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by byte planes; `unpacked` gives them back."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4").ravel().astype(np.int64)


def bundles_of(docs: DataFrame) -> DataFrame:
    """Documents as rows of about BUNDLE_WORDS words; written, so that a bundle keeps its number."""

    def bundle(number: int, ids: list, texts: list[np.ndarray]) -> dict:
        words, places, counts = np.unique(np.concatenate(texts).view(np.int64), return_inverse=True, return_counts=True)
        return {
            "bundle": [number],
            "doc_ids": [ids],
            "sizes": [[len(t) for t in texts]],
            "words": [words],
            "counts": [counts],
            "places": [packed(places)],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(hash_words(split_words(text)))
                size += len(texts[-1])
                if size >= BUNDLE_WORDS:
                    yield bundle(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield bundle(number, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(arrow_map(rows, work, _BUNDLE), "bundles")


def word_counts(bundles: DataFrame) -> DataFrame:
    """(word, n): exact occurrences of every word hash of the corpus."""
    rows = bundles.selectExpr("inline(arrays_zip(words, counts))")
    return materialise(rows.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n")), "word_counts")


def bins_of(n: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(np.maximum(n, 1))).astype(np.int64)


@dataclass
class Leaves:
    """Rule from (word, count) to leaf, most frequent words first, and what every leaf holds."""

    heads: np.ndarray  # sorted hashes of the words with a leaf of their own
    head_leaf: np.ndarray
    first: np.ndarray  # per class of frequency: its first leaf
    splits: np.ndarray  # and its number of leaves
    occurrences: np.ndarray  # per leaf
    different: np.ndarray

    @property
    def size(self) -> int:
        return int(len(self.heads) + self.splits.sum())

    def of(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        bins = bins_of(n)
        splits = np.maximum(self.splits[bins], 1)
        leaf = self.first[bins] + (words.view(np.uint64) % splits.astype(np.uint64)).astype(np.int64)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, words), len(self.heads) - 1)
            leaf = np.where(self.heads[at] == words, self.head_leaf[at], leaf)
        return leaf

    def log_inside(self, leaf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | leaf)."""
        return np.log((n + 1) / (self.occurrences[leaf] + self.different[leaf] + 1))

    def log_share(self) -> np.ndarray:
        return np.log((self.occurrences + 1) / (self.occurrences + 1).sum())


def _totals(words: DataFrame, size: int, place) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and different words per place, at most `size` places; `place` maps words and counts to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, different = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            own = batch.column(1).to_numpy()
            at = place(batch.column(0).to_numpy(), own)
            np.add.at(n, at, own)
            different += np.bincount(at, minlength=size)
        used = np.flatnonzero(different)
        yield {"place": used, "n": n[used], "different": different[used]}

    rows = arrow_map(words.select("word", "n"), work, "place long, n long, different long").groupBy("place")
    found = rows.agg(F.sum("n").alias("n"), F.sum("different").alias("different")).toArrow()
    out = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for values, name in zip(out, ("n", "different"), strict=True):
        values[found.column("place").to_numpy()] = found.column(name).to_numpy()
    return out


def leaves_of(words: DataFrame) -> Leaves:
    different, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = max(8, int(np.ceil(np.sqrt(different))))
    frequent = words.filter(F.col("n") * wanted >= total).toArrow()  # at most `wanted` words
    heads, n = frequent.column("word").to_numpy(), frequent.column("n").to_numpy()
    rank = np.empty(len(heads), np.int64)
    rank[np.lexsort((heads, -n))] = np.arange(len(heads))
    order = np.argsort(heads)
    mass, count = _totals(words.filter(F.col("n") * wanted < total), BINS, lambda _, n: bins_of(n))
    share = np.maximum(mass / max(total, 1), count / max(different, 1))
    splits = np.clip(np.rint(wanted * share).astype(np.int64), np.minimum(count, 1), count)
    splits[0] = max(splits[0], 1)  # for words the corpus does not hold
    first = len(heads) + np.cumsum(splits[::-1])[::-1] - splits
    none = np.zeros(0, np.int64)
    rule = Leaves(heads[order], rank[order], first, splits, none, none)
    rule.occurrences, rule.different = _totals(words, rule.size, rule.of)
    return rule


def coded(bundles: DataFrame, words: DataFrame, leaves: Leaves) -> DataFrame:
    """Bundles with the leaf of every word and every document's sum of log P(word | leaf); written."""
    types = arrow_schema(_CODED)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        take_turn(__name__)
        row = left.to_pylist()[0]
        word, n = (right.column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(word)  # as in the bundle
        leaf = leaves.of(word[order], n[order])
        inside = leaves.log_inside(leaf, n[order])
        places = unpacked(row["places"])
        out = {
            "doc_ids": [row["doc_ids"]],
            "sizes": [row["sizes"]],
            "inside": [sums_of(inside[places], np.array(row["sizes"]))],
            "leaves": [packed(leaf[places])],
        }
        return pa.Table.from_batches([record_batch(out, types)])

    own = bundles.select("bundle", F.explode("words").alias("word"))
    counted = own.join(words, "word", "left").select("bundle", "word", F.coalesce("n", F.lit(0)).alias("n"))
    texts = bundles.select(F.col("bundle").alias("whole"), "doc_ids", "sizes", "places")
    rows = texts.groupBy("whole").cogroup(counted.groupBy("bundle")).applyInArrow(work, _CODED)
    return materialise(rows, "coded_words")


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, some of them empty."""
    return np.diff(np.r_[0.0, np.cumsum(values)][np.r_[0, np.cumsum(sizes)]])


def windows(leaf: np.ndarray, sizes: np.ndarray, outside: int) -> np.ndarray:
    """Leaves around every word, a row per relative position."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    line = np.full(len(leaf) + SIDE * (len(sizes) + 1), outside, np.int64)
    at = np.arange(ends[-1] if len(ends) else 0) + SIDE * (owner + 1)
    line[at] = leaf
    return np.stack([line[at + k] for k in OFFSETS])


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = h @ weights
    logits += bias
    np.minimum(logits, HIGHEST, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _slices(size: int) -> Iterator[slice]:
    """Stretches short enough for a processor's cache."""
    return (slice(k, min(k + SMALLEST_BATCH, size)) for k in range(0, size, SMALLEST_BATCH))


@dataclass
class Network:
    """Weights; `flat` and `shaped` turn them into one vector and back. Leaf g * width + j is leaf j of group g."""

    embeddings: np.ndarray  # (relative position, leaf or outside, hidden)
    hidden_bias: np.ndarray
    outer: np.ndarray  # (hidden, group)
    outer_bias: np.ndarray
    inner: np.ndarray  # (group, hidden, leaf of the group)
    inner_bias: np.ndarray

    @staticmethod
    def fresh(log_share: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        leaves = len(log_share)
        width = int(np.ceil(np.sqrt(leaves)))
        groups = -(-leaves // width)
        share = np.full(groups * width, np.exp(-30.0))  # places after the last leaf are never met
        share[:leaves] = np.exp(log_share)
        share = share.reshape(groups, width)
        whole = share.sum(axis=1, keepdims=True)
        parts = (
            rng.normal(0, 0.3, (len(OFFSETS), leaves + 1, HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 0.1, (HIDDEN, groups)),
            np.log(whole[:, 0]),
            rng.normal(0, 0.1, (groups, HIDDEN, width)),
            np.log(share / whole),
        )
        return Network(*(p.astype(np.float32) for p in parts))

    @property
    def outside(self) -> int:
        return self.embeddings.shape[1] - 1

    @property
    def width(self) -> int:
        return self.inner_bias.shape[1]

    @property
    def batch(self) -> int:
        """Words of one step: more leaves, more words, so that steps over all weights stay cheap."""
        return max(SMALLEST_BATCH, 8 * self.outside)

    def parts(self) -> list[np.ndarray]:
        return [self.embeddings, self.hidden_bias, self.outer, self.outer_bias, self.inner, self.inner_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def shaped(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Network(
            *(v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(flat, cuts), self.parts(), strict=True))
        )

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.take(self.embeddings[0], around[0], axis=0)
        for k in range(1, len(OFFSETS)):
            total += np.take(self.embeddings[k], around[k], axis=0)
        total += self.hidden_bias
        return np.tanh(total, out=total)

    def _stretches(self, group: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Groups of sorted targets and where they are."""
        cuts = np.searchsorted(group, np.arange(len(self.outer_bias) + 1))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            yield g, slice(cuts[g], cuts[g + 1])

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | leaves around); `around` has a row per relative position."""
        order = np.argsort(target, kind="stable")
        group, place = np.divmod(target[order], self.width)
        h = self.hidden(around[:, order])
        found = np.empty(len(target), np.float32)
        for own in _slices(len(target)):
            p = _softmax(h[own], self.outer, self.outer_bias)
            found[own] = p[np.arange(len(p)), group[own]]
        for g, own in self._stretches(group):
            inside = _softmax(h[own], self.inner[g], self.inner_bias[g])
            found[own] *= inside[np.arange(len(inside)), place[own]]
        out = np.empty(len(target))
        out[order] = np.log(np.maximum(found, np.finfo(np.float32).tiny))
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability, as one vector."""
        order = np.argsort(target, kind="stable")
        around = around[:, order]
        group, place = np.divmod(target[order], self.width)
        h = self.hidden(around)
        back = np.empty_like(h)
        outer, outer_bias = np.zeros_like(self.outer), np.zeros_like(self.outer_bias)
        for own in _slices(len(target)):
            p = _softmax(h[own], self.outer, self.outer_bias)
            p[np.arange(len(p)), group[own]] -= 1
            back[own] = p @ self.outer.T
            outer += h[own].T @ p
            outer_bias += p.sum(axis=0)
        inner, inner_bias = np.zeros_like(self.inner), np.zeros_like(self.inner_bias)
        for g, own in self._stretches(group):
            q = _softmax(h[own], self.inner[g], self.inner_bias[g])
            q[np.arange(len(q)), place[own]] -= 1
            back[own] += q @ self.inner[g].T
            inner[g], inner_bias[g] = h[own].T @ q, q.sum(axis=0)
        back *= 1 - h * h
        embeddings = np.empty_like(self.embeddings)
        columns = np.ascontiguousarray(back.T, np.float64)
        for k, row in enumerate(around):
            for j, column in enumerate(columns):
                embeddings[k, :, j] = np.bincount(row, column, self.outside + 1)
        parts = (embeddings, back.sum(axis=0), outer, outer_bias, inner, inner_bias)
        return np.concatenate([part.ravel() for part in parts]) * np.float32(1 / len(target))


class Adam:
    def __init__(self, size: int):
        self.first, self.second, self.steps = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.001 * (gradient * gradient - self.second)
        unbiased = self.first / (1 - 0.9**self.steps)
        scale = np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8
        return RATE / np.sqrt(1 + self.steps / 500) * unbiased / scale


def _coded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, sizes, sums inside the leaves, leaves) of one bundle after the other."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, inside = (batch.column(c)[k].values for c in range(3))
            yield ids, sizes.to_numpy(), inside.to_numpy(), unpacked(batch.column(3)[k].as_py())


def train(rows: DataFrame, log_share: np.ndarray) -> Network:
    """One pass of Adam over all words, task by task, and the mean of the tasks' weights by words."""
    start = Network.fresh(log_share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        net, weights, words = start, start.flat(), 0
        adam = Adam(weights.size)
        rng = np.random.default_rng(3)
        for _, sizes, _, leaf in _coded_rows(batches):
            around = windows(leaf, sizes, start.outside)
            order = rng.permutation(len(leaf))
            for j in range(0, len(order), start.batch):
                own = order[j : j + start.batch]
                step = adam.step(net.gradient(around[:, own], leaf[own]))
                weights = weights - step * np.float32(len(own) / start.batch)
                net = start.shaped(weights)
            words += len(leaf)
        if words:
            yield {"part": np.arange(len(weights) + 1), "total": np.r_[weights.astype(np.float64) * words, words]}

    summed = arrow_map(rows, work, "part long, total double").groupBy("part").agg(F.sum("total").alias("total"))
    found = summed.toArrow()  # as many rows as the network has weights
    if not found.num_rows:
        return start
    total = np.empty(found.num_rows)
    total[found.column("part").to_numpy()] = found.column("total").to_numpy()
    return start.shaped(total[:-1] / total[-1])


def _scores(rows: DataFrame, network: Network) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, sizes, inside, leaf in _coded_rows(batches):
            around = windows(leaf, sizes, network.outside)
            logs = np.empty(len(leaf))
            for j in range(0, len(leaf), network.batch):
                own = slice(j, j + network.batch)
                logs[own] = network.log_probabilities(around[:, own], leaf[own])
            sums = sums_of(logs, sizes) + inside
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            yield {"doc_id": ids, "n_words": sizes, "log_likelihood": sums, "mean_log_likelihood": mean}

    return arrow_map(rows, work, _SCORES)


@dataclass
class Model:
    words: DataFrame
    """Exact counts of all words of the corpus: (word hash, n)."""
    leaves: Leaves
    network: Network


def _fit(bundles: DataFrame) -> tuple[Model, DataFrame]:
    words = word_counts(bundles)
    leaves = leaves_of(words)
    rows = coded(bundles, words, leaves)
    return Model(words, leaves, train(rows, leaves.log_share())), rows


def fit(docs: DataFrame) -> Model:
    """Count, train and return the model of a corpus; an empty one has one leaf and fresh weights."""
    return _fit(bundles_of(docs))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_words, log_likelihood, mean_log_likelihood).

    Words are UTF-8 strings between ASCII white space; those the model's corpus does not hold count as
    seen 0 times. A NULL text or one without words has the sum 0 and no mean. Repeated rows and NULL ids
    are rows as any other; other columns are ignored. An empty table gives no rows.
    """
    return _scores(coded(bundles_of(docs), model.words, model.leaves), model.network)


def score_corpus(docs: DataFrame) -> DataFrame:
    """`score` of a corpus under the model fitted on it; texts are read once."""
    model, rows = _fit(bundles_of(docs))
    return _scores(rows, model.network)
