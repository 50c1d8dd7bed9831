"""Toxic documents by a subsequence string kernel and a support vector machine.

Two words are compared by the subsequences of three characters they share, contiguous or with gaps;
an occurrence that spans n characters beyond its first counts DECAY^n. An inserted character or a
spelling with dots or digits keeps most of its subsequences. Words are normalised to unit length.

The kernel machine is made linear by Nyström landmarks: a word becomes its kernel values with the
landmark words, whitened by the landmarks' own kernel matrix, and a linear SVM is trained on that.
Multiplied out, the machine is one weight per character triple, so a word's decision value is a sum
over its triples and whole texts are scored by array operations, without a kernel evaluation a pair.

Labels belong to documents. A toxic document needs one toxic word: training starts with the words
that significantly more toxic documents hold and the word that sets each toxic document apart most,
and then twice puts the word the machine finds worst in its place (multiple-instance learning).
Negatives are the words of clean documents. A document's score is the
logistic of its worst decision value, calibrated on the training documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map

DECAY, SPAN = 0.6, 5
ALPHABET = 32
GAP = 31
LANDMARKS = 96
SAMPLE_DOCUMENTS = 2_000
"""Labelled training documents of each class that the fit uses at most, by hash of the id."""
SAMPLE_WORDS = 30_000
"""Different words of clean training documents that the fit uses at most, the most frequent first."""
ROUNDS = 3
STANDARD_ERRORS, LOG_ODDS = 4.0, 3.0
CLEAN_WEIGHT = 30.0
FALSE_ALARM = 5.0
"""A clean training document that is rejected costs as much as this many toxic ones that pass."""
THRESHOLD = 0.7
BLOCK = 1 << 20

# Characters that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def _codes() -> np.ndarray:
    """Code of every character below 0x250: 0 white space, 1 to 26 letters without marks, 27 ñ, 31 any other."""
    import unicodedata

    table = np.full(0x250, GAP, np.uint8)
    for point in range(0x250):
        char = chr(point)
        base = unicodedata.normalize("NFD", LOOKALIKES.get(char, char).lower())[0]
        base = {"ß": "s", "æ": "a", "ø": "o", "œ": "o"}.get(base, base)
        if char in "ñÑ":  # a letter of its own
            table[point] = 27
        elif "a" <= base <= "z":
            table[point] = ord(base) - 96
        elif char.isspace():
            table[point] = 0
    return table


CODES = _codes()
_OFFSETS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts, each followed by white space, and the position where each text ends."""
    parts = [np.frombuffer(((t or "") + " ").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    codes = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], 28 + points % 3).astype(np.uint8)
    codes[np.isin(points, (0x2003, 0x2002, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x3000))] = 0
    ends = np.cumsum([len(p) for p in parts])
    gaps = np.flatnonzero(codes == 0)
    single = np.zeros(len(gaps) + 1, bool)  # whether the word before a gap is one character
    single[1:-1] = np.diff(gaps) == 2
    single[0] = len(gaps) > 0 and gaps[0] == 1
    inner = single[:-1] & single[1:]
    inner[np.isin(gaps, ends - 1)] = False
    codes[gaps[inner]] = GAP  # letters written apart are one word
    return codes, ends


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the first positions, the triples there (0 if it leaves the word) and the weight."""
    n = len(codes)
    word = np.cumsum(codes == 0)
    wide = codes.astype(np.int32)
    usable = (codes > 0) & (codes < GAP)
    for a, b in _OFFSETS:
        if n <= a + b:
            continue
        first, second, third = wide[: n - a - b], wide[a : n - b], wide[a + b :]
        inside = (word[: n - a - b] == word[a + b :]) & usable[: n - a - b] & usable[a : n - b] & usable[a + b :]
        at = np.flatnonzero(inside)
        yield at, (first[at] * ALPHABET + second[at]) * ALPHABET + third[at], DECAY ** (a + b)


@dataclass
class Model:
    weights: np.ndarray  # by triple
    bias: float
    slope: float
    offset: float

    def decisions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every word, and its decision value; a word without a triple has the bias."""
        value = np.zeros(len(codes), np.float32)
        norm = np.zeros(len(codes), np.float32)
        for at, triple, weight in triples(codes):
            value[at] += np.float32(weight) * self.weights[triple]
            norm[at] += np.float32(weight * weight)
        starts = word_starts(codes)
        if not len(starts):
            return starts, np.zeros(0, np.float32)
        size = np.sqrt(np.add.reduceat(norm, starts))
        return starts, np.add.reduceat(value, starts) / np.maximum(size, 1e-6) + np.float32(self.bias)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Largest decision value of each text; the bias for a text without words."""
        out = np.full(len(texts), self.bias, np.float64)
        for part in blocks(texts):
            codes, ends = encode(texts[part])
            starts, values = self.decisions(codes)
            owner = np.searchsorted(ends, starts, side="right")
            np.maximum.at(out[part], owner, values)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.offset, -50, 50)))


def word_starts(codes: np.ndarray) -> np.ndarray:
    used = codes > 0
    return np.flatnonzero(used & ~np.r_[False, used[:-1]])


def blocks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about BLOCK characters; every text is whole."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def words_in(text: str | None) -> set[bytes]:
    codes, _ = encode([text])
    return {w for w in codes.tobytes().split(b"\0") if len(w) >= 3}


def numbered(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """Different words of three letters or more, and the numbers of those in each text."""
    numbers: dict[bytes, int] = {}
    held = [np.array([numbers.setdefault(w, len(numbers)) for w in sorted(words_in(t))], np.int32) for t in texts]
    return list(numbers), held


def first_of_copies(words: list[bytes], held: list[np.ndarray], size: int = 8) -> list[int]:
    """Texts that share fewer than half of their `size` smallest word hashes with a text before."""
    hashes = np.array([zlib.crc32(w) for w in words], np.uint32)
    seen: dict[int, list[int]] = {}
    kept = []
    for i, own in enumerate(held):
        sketch = np.sort(hashes[own])[:size].tolist()
        shared = Counter(j for h in sketch for j in seen.get(h, ()))
        if 2 * max(shared.values(), default=0) > len(sketch):
            continue
        kept.append(i)
        for h in sketch:
            seen.setdefault(h, []).append(i)
    return kept


def _kernel_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple, weight) of unit-length words."""
    codes = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    word = np.cumsum(codes == 0)
    parts = [(word[at], triple, np.full(len(at), weight)) for at, triple, weight in triples(codes)]
    number, triple, weight = (np.concatenate([p[k] for p in parts]) for k in range(3))
    size = np.sqrt(np.bincount(number, weight**2, len(words)))
    return number, triple, weight / np.maximum(size[number], 1e-6)


def _projected(words: list[bytes], projection: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), projection.shape[1]), np.float32)
    for k in range(0, len(words), 1_000):
        number, triple, weight = _kernel_features(words[k : k + 1_000])
        for j in range(projection.shape[1]):
            own = projection[triple, j] * weight
            out[k : k + 1_000, j] = np.bincount(number, own, len(words[k : k + 1_000]))
    return out


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps on the rows inside the margin; clean words weigh CLEAN_WEIGHT times as much."""
    x1 = np.c_[x, np.ones(len(x), np.float32)]
    balance = np.where(y > 0, weight / weight[y > 0].sum(), CLEAN_WEIGHT * weight / weight[y < 0].sum())
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        active = y * (x1 @ w) < 1
        xa, ba = x1[active].astype(np.float64), balance[active]
        hessian = (xa * ba[:, None]).T @ xa + penalty * np.eye(len(w))
        new = np.linalg.solve(hessian, xa.T @ (ba * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic: it is THRESHOLD where shares of misses and FALSE_ALARMs cost least.

    The cut lies in the middle of the best gap between decision values; the slope makes the mean
    decision values of the two classes differ by 8 on the logistic's scale.
    """
    order = np.argsort(worst, kind="stable")
    values, bad = worst[order], toxic[order]
    missed = np.r_[0, np.cumsum(bad)] / max(bad.sum(), 1)  # with the cut before each value
    alarms = 1 - np.r_[0, np.cumsum(~bad)] / max((~bad).sum(), 1)
    best = int(np.argmin(missed + FALSE_ALARM * alarms))
    low, high = values[max(best - 1, 0)], values[min(best, len(values) - 1)]
    slope = 8 / max(float(worst[toxic].mean() - worst[~toxic].mean()), 0.1)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * (low + high) / 2)


def train(texts: list[str | None], toxic: np.ndarray, seed: int = 7) -> Model:
    """Fit on whole labelled texts. Without both classes every text scores the share of toxic ones."""
    toxic = np.asarray(toxic, bool)
    words, held = numbered(texts)
    first = first_of_copies(words, held)  # copies of a text would make its words look frequent
    texts, held, toxic = [texts[i] for i in first], [held[i] for i in first], toxic[first]
    share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-6), 1 - 1e-6)
    counts = [
        np.bincount(np.concatenate([np.zeros(0, np.int32), *(h for h, t in zip(held, toxic, strict=True) if t == k)]), minlength=len(words))
        for k in (False, True)
    ]
    negative, positive = (c.astype(np.float64) for c in counts)
    if not negative.any() or not positive.any():
        return Model(np.zeros(ALPHABET**3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    n_neg, n_pos = (~toxic).sum(), toxic.sum()
    odds = np.log((positive + 0.5) / (n_pos + 1)) - np.log((negative + 0.5) / (n_neg + 1))
    common = (positive + negative) / (n_pos + n_neg)
    error = np.sqrt(common * (1 - common) * (1 / n_pos + 1 / n_neg))
    apart = (positive / n_pos - negative / n_neg > STANDARD_ERRORS * error) & (odds > LOG_ODDS) & (positive > 2)
    marked = np.where(apart, positive, 0)  # words that significantly more toxic documents hold

    bags = [h for h, t in zip(held, toxic, strict=True) if t and len(h)]
    bags = [h for h in bags if not apart[h].any()] or bags[:1]  # the others are explained
    chosen = np.maximum(marked, _one_each(bags, odds, len(words)))
    clean = np.lexsort((np.arange(len(words)), -negative))[: min(SAMPLE_WORDS, int((negative > 0).sum()))]
    rng = np.random.default_rng(seed)
    others = rng.choice(clean, min(len(clean), LANDMARKS // 4), replace=False)
    for _ in range(ROUNDS):
        found = np.lexsort((np.arange(len(words)), -chosen))[: int((chosen > 0).sum())]
        machine = _fit(
            [words[i] for i in found], chosen[found],
            [words[i] for i in clean if not chosen[i]], negative[clean[chosen[clean] == 0]],
            [words[i] for i in {*found[:LANDMARKS].tolist(), *others.tolist()}],
        )
        values = np.full(len(words), -np.inf)
        asked = np.unique(np.concatenate([clean, *bags]))
        values[asked] = machine.decisions(np.frombuffer(b"\0".join([words[i] for i in asked]) + b"\0", np.uint8))[1]
        mistaken = np.maximum(values[clean] + 1, 0) * negative[clean]
        others = np.r_[others, clean[np.argsort(-mistaken)[: LANDMARKS // 4]]]
        chosen = np.maximum(marked, np.where(odds > 0, _one_each(bags, values, len(words)), 0))
    machine.slope, machine.offset = _calibrate(machine.worst(texts), toxic)
    return machine


def _one_each(bags: list[np.ndarray], value: np.ndarray, size: int) -> np.ndarray:
    """How many bags have a word as the one of largest value."""
    return np.bincount([bag[value[bag].argmax()] for bag in bags], minlength=size)


def _fit(found: list[bytes], chosen: np.ndarray, clean: list[bytes], held: np.ndarray, landmarks: list[bytes]) -> Model:
    landmarks = sorted(landmarks)
    number, triple, weight = _kernel_features(landmarks)
    phi = np.zeros((len(landmarks), ALPHABET**3), np.float32)
    np.add.at(phi, (number, triple), weight)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-5 * values.max()
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    projection = phi.T @ whiten  # triple -> Nyström feature
    x = _projected([*found, *clean], projection)
    y = np.r_[np.ones(len(found)), -np.ones(len(clean))]
    w, bias = _linear_svm(x, y, np.r_[np.sqrt(chosen), held])
    return Model((projection @ w).astype(np.float32), bias, 1.0, 0.0)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents that are not held out, at most SAMPLE_DOCUMENTS of each class."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [rows.filter(F.col("toxic") == k).orderBy(*order).limit(SAMPLE_DOCUMENTS) for k in (0, 1)]
    sample = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has at most 2 * SAMPLE_DOCUMENTS rows of two numbers
    found = texts.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").toArrow()
    return train(found.column("text").to_pylist(), found.column("toxic").to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, score, predicted).

    NULL and empty texts score as a text without words. Repeated rows and NULL ids are rows as any
    other (a NULL id is not held out); other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            scores = model.scores(batch.column(2).to_pylist())
            yield {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "score": scores,
                "predicted": (scores >= THRESHOLD).astype(np.int32),
            }

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)), F.col("text").cast("string")
    )
    return arrow_map(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs` whose score is below the threshold, unchanged."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < THRESHOLD))

    return arrow_map(docs, work, docs.schema)
