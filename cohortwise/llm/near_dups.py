"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Features are runs of five lower-cased words; a document of fewer words has one feature, all of them.
A feature weighs tf * idf, with idf = 1 + ln(N / df) / ln(RARE) / 2 cut to 1..1.5: 1.5 for what at most
one document in `RARE` holds, 1 for what all of them hold, so that a phrase in every copy of a large
group still counts. It depends on the share of documents only, so
two documents are as similar in a large corpus as in a small one of the same kind. Frequencies are
those of the shingles themselves; no more than `RARE` times the mean number of shingles of a document
are frequent enough to matter, which bounds the table that is sent to the tasks.

1. Equal word sequences form one text; from here on only texts with different words are compared.
2. A text's `BANDS * ROWS` samples are drawn with probability proportional to weight, so that two
   samples agree with probability equal to the weighted Jaccard similarity. Texts that agree on a
   whole band meet in a bucket; two of similarity 0.8 do so with probability 0.9997.
3. In a group of at most `SMALL` members all pairs of different classes are candidates. In a larger
   one all members meet `HUBS` members drawn by hash, never each other. A text's weight summed in `BINS`
   bins of shingles bounds what it can share with another text; candidates whose bound is below the
   similarity are left out, which loses none. Of the others the weighted Jaccard similarity is
   computed from the texts, and links are joined into classes by spreading the smallest id.
4. Members of large groups that still hold several classes are grouped anew, by longer keys out of
   `POOL` further samples and by more of them: `LEVELS` names (keys, samples a key). Step 3 runs on
   every level. This joins most classes of a crowd of near copies with few comparisons.
5. The large groups of step 2 that hold several classes after that are compared whole, so that no link
   of a bucket is lost: their members are dealt into blocks of some `BLOCK` characters, those of a large
   class together, and every two blocks meet in a task of their own. Of all pairs of different classes
   that their bins do not rule out the similarity is computed, in the first band that they share, until
   they are in one class.

Rows are members times hubs and keys, and blocks. The work of step 5 alone grows with the square of a
group's size, less the pairs inside a class; it needs the memory of two blocks.
"""

from __future__ import annotations

import functools
import random
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map, arrow_schema, hash_words, materialise, record_batch, take_turn

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 2
SMALL, HUBS = 16, 2
POOL = 64
LEVELS = ((12, 4), (24, 8), (64, 16), (96, 24))
BINS = 128
BLOCK, SLICE = 8_000_000, 16
ROW_CHARS = 1_024
"""Characters that a text counts for in a block besides its own."""
RARE, HIGHEST = 100, 1.5
CHUNK_SHINGLES = 2_000_000
TASK_DOCUMENTS = 64 * RARE
"""Documents that a task counts at least, on average: in smaller ones a shingle of one text is not yet rare."""
SEEN_BITS = 20
TABLE_BITS = 14
TASK_ROWS, TASK_TEXTS = 50_000, 500
"""Rows of ids and keys, and texts with their pairs, that a task takes on average, where a shuffle deals out fewer."""
SUB_BATCH = 100
KEPT_FEATURES = 256


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words in their order, as two signed 64-bit integers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words)))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word runs, repeated ones included; none for a text without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return _mix(out + np.uint64(size))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles and how often each occurs."""
    found, counts = np.unique(shingles(words), return_counts=True)
    return found, counts


@dataclass
class Idf:
    """Weights of shingles: the frequent ones by name, `HIGHEST` for all others."""

    keys: np.ndarray  # sorted
    values: np.ndarray

    @functools.cached_property
    def seen(self) -> np.ndarray:
        """Whether a frequent shingle starts with some bits; most shingles need no search."""
        out = np.zeros(1 << SEEN_BITS, bool)
        out[(self.keys >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
        return out

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), HIGHEST, np.float32)
        if len(self.keys):
            at = np.flatnonzero(self.seen[(found >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
            hit = self.keys[place] == found[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def idf_of(frequencies: dict[int, int], documents: int) -> Idf:
    """idf of the given shingles (as unsigned integers)."""
    keys = np.array(sorted(frequencies), np.uint64)
    share = np.array([frequencies[k] / max(documents, 1) for k in keys.tolist()])
    with np.errstate(divide="ignore"):
        values = 1 + np.clip(-np.log(np.minimum(share, 1)) / np.log(RARE), 0, 1) * (HIGHEST - 1)
    return Idf(keys, values.astype(np.float32))


def document_frequencies(docs: DataFrame) -> Idf:
    """idf from the documents that hold each shingle, over all rows.

    A task counts runs of documents exactly and passes on the shingles that more than one in 16 * RARE
    of a run's documents and of its own hold. What is left out makes a frequency too small by less than
    an eighth of the N / RARE documents from which on it matters. Tasks of fewer than 16 * RARE documents
    leave out none, so small partitions are counted together, `TASK_DOCUMENTS` documents or more to a task:
    how many rows a text adds does not depend on how finely the table is dealt.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size, documents, runs = [], 0, 0, []

        def counted() -> None:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > len(held) // (16 * RARE)
            runs.append((found[often], n[often]))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(np.unique(shingles(words_of(text))))
                size += len(held[-1])
                if size > CHUNK_SHINGLES:
                    counted()
                    documents, held, size = documents + len(held), [], 0
        if held:
            counted()
            documents += len(held)
        if runs:
            found, at = np.unique(np.concatenate([f for f, _ in runs]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in runs])).astype(np.int64)
            often = n > documents // (16 * RARE)
            yield {"shingle": found[often].view(np.int64), "n": n[often]}

    documents = docs.count()
    dealt = docs.select(F.col("text").cast("string")).coalesce(max(1, documents // TASK_DOCUMENTS))
    rows = arrow_map(dealt, work, "shingle long, n long")
    summed = rows.groupBy("shingle").agg(F.sum("n").alias("n"))
    often = summed.filter(F.col("n") > documents / RARE).toArrow()  # bounded, see the module's text
    keys, n = (often.column(c).to_numpy() for c in ("shingle", "n"))
    return idf_of(dict(zip(keys.view(np.uint64).tolist(), n.tolist(), strict=True)), documents)


@functools.lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of quantiles of r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and b ~ U(0, 1)."""
    n = 1 << TABLE_BITS
    u = (np.arange(n) + 0.5) / n
    x = np.linspace(1e-6, 25, 400_000)
    gamma = np.interp(u, 1 - np.exp(-x) * (1 + x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32)


def samples(found: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, number: int, first: int = 0) -> np.ndarray:
    """Consistent weighted samples (64-bit hashes) `first` to `first + number - 1` of each text; texts are runs from `starts`, none empty."""
    gamma, log_gamma, uniform = draws()
    sizes = np.diff(np.r_[starts, len(found)])
    mask = np.uint64((1 << TABLE_BITS) - 1)
    out = np.empty((len(starts), number), np.uint64)
    for k in range(number):
        bits = _mix(found + np.uint64((0x632BE59BD9B4E019 * (first + k + 1)) & (2**64 - 1)))
        r = gamma[bits & mask]
        beta = uniform[(bits >> np.uint64(TABLE_BITS)) & mask]
        t = np.floor(log_weight / r + beta)
        log_a = log_gamma[(bits >> np.uint64(2 * TABLE_BITS)) & mask] - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        chosen = hits[np.searchsorted(hits, starts)]
        out[:, k] = _mix(found[chosen] * np.uint64(3) + t[chosen].astype(np.int64).astype(np.uint64))
    return out


def drawn(parts: list[tuple], idf: Idf, number: int, first: int = 0) -> np.ndarray:
    """Samples of texts given by their `features`, a row each."""
    found = np.concatenate([f for f, _ in parts])
    log_weight = np.log(np.concatenate([c for _, c in parts])).astype(np.float32) + np.log(idf.of(found))
    starts = np.r_[0, np.cumsum([len(f) for f, _ in parts])[:-1]]
    return samples(found, log_weight, starts, number, first)


def profiles(parts: list[tuple], idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given by their `features`: the weight in each bin of shingles, rounded up, and in all."""
    found = np.concatenate([f for f, _ in parts])
    weight = np.concatenate([c for _, c in parts]) * idf.of(found).astype(np.float64)
    at = np.repeat(np.arange(len(parts)), [len(f) for f, _ in parts])
    exact = np.bincount(at * BINS + (found % np.uint64(BINS)).astype(np.int64), weight, len(parts) * BINS)
    with np.errstate(over="ignore"):  # infinity is a bound, too
        near = exact.astype(np.float16)
        bins = np.where(near < exact, np.nextafter(near, np.float16(np.inf)), near)
    return bins.reshape(len(parts), BINS), np.bincount(at, weight, len(parts))


def possible(bins: np.ndarray, weight: np.ndarray, other: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """How far the largest overlap that the bins allow is above the one `similarity` needs; pairs below 0 are no links.

    Texts share at most the smaller weight of every bin.
    """
    shared = np.minimum(bins, other).sum(axis=-1, dtype=np.float32)
    return shared - np.float32(similarity / (1 + similarity) * (1 - 1e-5)) * (weight + others).astype(np.float32)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32).reshape(-1, BINS)


def _signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """(doc_id, t1, t2, sketch, bins, weight): 128-bit hash of the words, samples and profile; only texts with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, texts = (batch.column(k).to_pylist() for k in (0, 1))
            for k in range(0, len(ids), SUB_BATCH):
                words = [words_of(t) for t in texts[k : k + SUB_BATCH]]
                known = [(i, w) for i, w in zip(ids[k : k + SUB_BATCH], words, strict=True) if w]
                if not known:
                    continue
                same = [text_hash(w) for _, w in known]
                parts = [features(w) for _, w in known]
                bins, weight = profiles(parts, idf)
                yield {
                    "doc_id": [i for i, _ in known],
                    "t1": [s for s, _ in same],
                    "t2": [s for _, s in same],
                    "sketch": list(drawn(parts, idf, BANDS * ROWS).view(np.int64)),
                    "bins": [row.tobytes() for row in bins],
                    "weight": weight,
                }

    return arrow_map(docs, work, "doc_id long, t1 long, t2 long, sketch array<long>, bins binary, weight double")


def _pools(texts: DataFrame, idf: Idf) -> DataFrame:
    """(rep, sketch): the `POOL` further samples of candidate texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, bodies = (c.to_pylist() for c in batch.columns)
            for k in range(0, len(ids), SUB_BATCH):
                parts = [features(words_of(t)) for t in bodies[k : k + SUB_BATCH]]
                sketch = drawn(parts, idf, POOL, BANDS * ROWS)
                yield {"rep": ids[k : k + SUB_BATCH], "sketch": list(sketch.view(np.int64))}

    return arrow_map(texts, work, "rep long, sketch array<long>")


def weighted_jaccard(a: tuple, b: tuple, idf: Idf) -> float:
    """Of two `features`: sum of the smaller weights over sum of the larger ones."""
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float((np.minimum(a[1][at_a], b[1][at_b]) * idf.of(both).astype(np.float64)).sum())
    total = sum(float((c * idf.of(f).astype(np.float64)).sum()) for f, c in (a, b))
    return shared / (total - shared) if total > shared else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """`pairs` (a, b) with the similarity of their texts, where it is at least `similarity`."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[int, tuple] = {}  # hubs come again and again

        def of(doc: int, text: str) -> tuple:
            if doc not in known:
                if len(known) >= KEPT_FEATURES:
                    known.clear()
                known[doc] = features(words_of(text))
            return known[doc]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            scores = np.array([weighted_jaccard(of(a[i], ta[i]), of(b[i], tb[i]), idf) for i in range(len(a))])
            keep = np.flatnonzero(scores >= similarity)
            yield {"a": [a[i] for i in keep], "b": [b[i] for i in keep], "similarity": scores[keep]}

    return arrow_map(rows, work, "a long, b long, similarity double")


def _kept(df: DataFrame, name: str, most: int, task: int = TASK_ROWS) -> DataFrame:
    """`materialise` for a step that takes in or passes on at most `most` rows, in no more tasks than these fill.

    A shuffle deals a short table to as many tasks as a long one; each would write a file of its own, to be read again.
    """
    return materialise(df.coalesce(max(1, -(-most // task))), name)


def _spread(classes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """`classes` (rep, class) after merging the classes that `links` (a, b), at most `most`, connect; smallest id wins."""
    one = classes.select(F.col("rep").alias("a"), F.col("class").alias("ca"))
    two = classes.select(F.col("rep").alias("b"), F.col("class").alias("cb"))
    edges = links.join(one, "a").join(two, "b").filter("ca <> cb").select("ca", "cb")
    both = edges.union(edges.select("cb", "ca")).toDF("u", "v").distinct()
    both = _kept(both, "class_links", 2 * most)
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label"))
    labels = _kept(labels, "labels", 2 * most)
    while True:
        near = labels.select(F.col("u").alias("v"), F.col("label").alias("near"))
        low = both.join(near, "v").groupBy("u").agg(F.min("near").alias("near"))
        stepped = labels.join(low, "u").select("u", F.least("label", "near").alias("stepped"), "label")
        jump = labels.select(F.col("u").alias("stepped"), F.col("label").alias("jumped"))  # to the label's label
        moved = stepped.join(jump, "stepped").select("u", F.col("jumped").alias("new"), (F.col("jumped") != F.col("label")).alias("moved"))
        moved = _kept(moved, "labels", 2 * most)
        labels = moved.select("u", F.col("new").alias("label"))
        if moved.filter("moved").isEmpty():
            break
    renamed = labels.select(F.col("u").alias("class"), "label")
    return classes.join(renamed, "class", "left").select("rep", F.coalesce("label", "class").alias("class"))


def _same_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows whose words have the hash that `wanted` (doc_id, t1, t2) names; one row per id."""
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "t1", "t2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, texts, *named = (c.to_pylist() for c in batch.columns)
            keep = [k for k, t in enumerate(texts) if text_hash(words_of(t)) == (named[0][k], named[1][k])]
            yield {"doc_id": [ids[k] for k in keep], "text": [texts[k] for k in keep]}

    return arrow_map(rows, work, "doc_id long, text string").dropDuplicates(["doc_id"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per different id in `docs`: (doc_id, class_id, text_id, n_links).

    `class_id` is the smallest id of the documents that links of at least `similarity` connect,
    `text_id` the smallest id with the same words in the same order, `n_links` the number of verified
    links of that text. Words are compared in lower case. NULL, empty and blank texts are alone in
    their classes. Rows that repeat an id are one document, for which one of its texts counts; rows
    without an id have no class. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter("doc_id IS NOT NULL")
    idf = document_frequencies(docs)
    signed = materialise(_signatures(docs, idf), "signatures")
    own = signed.groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("t")).select("doc_id", "t.t1", "t.t2")
    own = materialise(own, "own_texts")
    unique = own.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"))
    sketches = signed.groupBy("t1", "t2").agg(F.first(F.struct("sketch", "bins", "weight")).alias("s"))  # equal for equal words
    sketches = sketches.select("t1", "t2", "s.*")
    unique = materialise(unique.join(sketches, ["t1", "t2"]), "texts")
    bands = [range(k * ROWS, k * ROWS + ROWS) for k in range(BANDS)]
    groups = buckets = _grouped(unique, bands)
    members = in_buckets = groups.count()
    classes = _kept(groups.select("rep").distinct().select("rep", F.col("rep").alias("class")), "classes", members)
    candidates = classes.count()
    wanted = unique.select("t1", "t2", "rep").join(classes, "rep").select(F.col("rep").alias("doc_id"), "t1", "t2")
    texts = materialise(_same_words(docs, wanted), "candidate_texts")
    profile = unique.select("rep", "bins", "weight")
    links = texts.sparkSession.createDataFrame([], "a long, b long, similarity double")
    seen, pools, draw = links.select("a", "b"), None, random.Random(17)

    def compare(pairs: DataFrame) -> None:
        nonlocal links, seen, classes
        pairs = materialise(pairs, "pairs")
        found = _kept(_verified(pairs, texts, idf, similarity), "links", pairs.count() + candidates, TASK_TEXTS)
        seen = seen.union(pairs)
        if number := found.count():
            links = links.union(found)
            classes = _kept(_spread(classes, found, number), "classes", candidates)

    for level in range(len(LEVELS) + 1):
        compare(_likely(_pairs(groups, classes, members).join(seen, ["a", "b"], "left_anti"), profile, similarity))
        if level == len(LEVELS):
            break
        left = _kept(_mixed(groups, classes), "mixed", members)
        if left.isEmpty():
            break
        reps = left.select("rep").distinct()
        if pools is None:
            bodies = texts.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text")
            pools = materialise(_pools(bodies, idf), "pools")
        keys, size = LEVELS[level]
        chosen = [draw.sample(range(POOL), size) for _ in range(keys)]
        groups = _grouped(pools.join(reps, "rep"), chosen)
        members = groups.count()
    left = _kept(_mixed(buckets, classes), "mixed", in_buckets)
    if not left.isEmpty():
        found = materialise(_across(left, classes, texts, idf, similarity), "links")
        if number := found.count():
            links = links.union(found).dropDuplicates(["a", "b"])
            classes = _kept(_spread(classes, found, number), "classes", candidates)
    degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    reps = unique.select("t1", "t2", "rep").join(classes, "rep", "left").join(degrees, "rep", "left")
    known = own.join(reps, ["t1", "t2"]).select("doc_id", "rep", "class", "n")
    return docs.select("doc_id").distinct().join(known, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class", "rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("text_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
    )


def _keyed(sketches: DataFrame, chosen: list) -> DataFrame:
    """(rep, band, key): a key of every text for each choice of sample numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            keys = np.zeros((batch.num_rows, len(chosen)), np.uint64)
            for band, own in enumerate(chosen):
                for k in own:
                    keys[:, band] = _mix(keys[:, band] * np.uint64(31) + drawn[:, k])
            yield {"rep": batch.column(0), "keys": list(keys.view(np.int64))}

    return arrow_map(sketches.select("rep", "sketch"), work, "rep long, keys array<long>").select(
        "rep", F.posexplode("keys").alias("band", "key")
    )


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (rep, band, key) of groups with at least two texts."""
    shared = rows.groupBy("band", "key").agg(F.min("rep").alias("__lo"), F.max("rep").alias("__hi")).filter("__lo < __hi")
    return rows.join(shared.select("band", "key"), ["band", "key"])


def _grouped(sketches: DataFrame, chosen: list) -> DataFrame:
    keys = materialise(_keyed(sketches, chosen), "keys")
    return _kept(_crowded(keys), "groups", keys.count())


def _pairs(groups: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Pairs a < b of different classes: all of a small group, of a large one those with one of its hubs. `most`: rows of `groups`."""
    rows = groups.join(classes, "rep")
    hubs = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("at"), "rep", "class")) for k in range(HUBS)]
    sized = rows.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("class").alias("__lo"), F.max("class").alias("__hi"), F.array(*hubs).alias("hubs")
    )
    sized = _kept(sized.filter("__lo < __hi").select("band", "key", "n", "hubs"), "sized", most)
    small = rows.join(sized.filter(F.col("n") <= SMALL).select("band", "key"), ["band", "key"])
    held = small.groupBy("band", "key").agg(F.collect_list(F.struct("rep", "class")).alias("m"))
    every = F.expr(
        "flatten(transform(m, x -> transform(filter(m, y -> y.rep > x.rep AND y.class <> x.class), y -> struct(x.rep AS a, y.rep AS b))))"
    )
    inside = held.select(F.inline(every))
    large = rows.join(sized.filter(F.col("n") > SMALL).select("band", "key", "hubs"), ["band", "key"])
    met = large.select("rep", F.explode(F.expr("filter(hubs, h -> h.class <> class)")).alias("hub"))
    across = met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
    return inside.union(across).distinct()


def _likely(pairs: DataFrame, profile: DataFrame, similarity: float) -> DataFrame:
    """Pairs that the profiles of their texts do not rule out."""
    left = profile.select(F.col("rep").alias("a"), F.col("bins").alias("ba"), F.col("weight").alias("wa"))
    right = profile.select(F.col("rep").alias("b"), F.col("bins").alias("bb"), F.col("weight").alias("wb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ba", "bb", "wa", "wb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ba, bb = (_unpacked(batch.column(k)) for k in (2, 3))
            wa, wb = (batch.column(k).to_numpy() for k in (4, 5))
            keep = np.flatnonzero(possible(ba, wa, bb, wb, similarity) >= 0)
            yield {"a": batch.column(0).take(pa.array(keep)), "b": batch.column(1).take(pa.array(keep))}

    return arrow_map(rows, work, "a long, b long")


def _across(left: DataFrame, classes: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """(a, b, similarity): links a < b that join all classes of a group of `left` that have any link."""
    group = ["band", "key"]
    bodies = texts.select(F.col("doc_id").alias("rep"), "text")
    # a text's keys by band; its own id, which no other text has, where it is in no such group
    keys = left.groupBy("rep").agg(*[F.max(F.when(F.col("band") == k, F.col("key"))).alias(f"k{k}") for k in range(BANDS)])
    keys = keys.join(bodies, "rep").select(
        "rep", (F.length("text") + ROW_CHARS).alias("size"), F.array(*[F.coalesce(f"k{k}", "rep") for k in range(BANDS)]).alias("keys")
    )
    rows = left.join(classes, "rep").join(keys, "rep")
    whole = rows.groupBy(*group).agg(F.ceil(F.sum("size") / BLOCK).alias("n"))
    parts = rows.groupBy(*group, "class").agg(F.ceil(F.sum("size") / BLOCK).alias("c"))
    block = F.expr("pmod(pmod(xxhash64(class), n) + pmod(xxhash64(rep), c), n)").alias("block")
    rows = rows.join(whole, group).join(parts, [*group, "class"]).select(*group, block, "rep", "class", "keys")
    rows = materialise(rows, "members")
    blocks = rows.groupBy(*group, "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    one = blocks.select(*group, F.col("block").alias("one"), F.col("lo").alias("l1"), F.col("hi").alias("h1"))
    two = blocks.select(*group, F.col("block").alias("two"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    meet = one.join(two, group).filter("one <= two AND least(l1, l2) < greatest(h1, h2)")
    sides = meet.select(*group, "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    met = sides.join(rows, [*group, "block"]).join(bodies, "rep")
    types = arrow_schema("a long, b long, similarity double")

    def work(table: pa.Table) -> pa.Table:
        take_turn(__name__)
        return pa.Table.from_batches([record_batch(_block_links(table, idf, similarity), types)])

    found = met.groupBy(*group, "one", "two").applyInArrow(work, "a long, b long, similarity double")
    return found.dropDuplicates(["a", "b"])


def _block_links(table: pa.Table, idf: Idf, similarity: float) -> dict:
    """Links between the classes of one block, or between those of two, as many as it takes to join them."""
    rep, block, group = (table.column(c).to_numpy() for c in ("rep", "block", "class"))
    parts = [features(words_of(t)) for t in table.column("text").to_pylist()]
    bins, weight = profiles(parts, idf)
    order = np.argsort(weight, kind="stable")
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, : table.column("band")[0].as_py()]
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    mine, others = order[block[order] == one], order[block[order] == two]
    bins = bins.astype(np.float32)
    right, above = bins[others], weight[others]
    class_of = {c: c for c in group.tolist()}

    def root(c: int) -> int:
        while class_of[c] != c:
            class_of[c] = c = class_of[class_of[c]]
        return c

    links = {"a": [], "b": [], "similarity": []}
    for k in range(0, len(mine), SLICE):
        at = mine[k : k + SLICE]
        # a weight below `similarity` times the other one is too small for a link
        lo, hi = np.searchsorted(above, [weight[at[0]] * similarity * (1 - 1e-9), weight[at[-1]] / similarity * (1 + 1e-9)])
        excess = possible(bins[at, None], weight[at, None], right[None, lo:hi], above[None, lo:hi], similarity)
        now = np.array([root(c) for c in group.tolist()])
        fits = (excess >= 0) & (now[at, None] != now[None, others[lo:hi]])
        if one == two:
            fits &= rep[at, None] < rep[None, others[lo:hi]]
        i, j = np.nonzero(fits)
        best = np.argsort(-excess[i, j], kind="stable")
        i, j = at[i[best]], others[lo:hi][j[best]]
        first = ~(keys[i] == keys[j]).any(axis=1)  # pairs that share an earlier band are compared there
        for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
            c, d = root(group[x]), root(group[y])
            if c != d and (found := weighted_jaccard(parts[x], parts[y], idf)) >= similarity:
                class_of[max(c, d)] = min(c, d)
                links["a"].append(min(rep[x], rep[y]))
                links["b"].append(max(rep[x], rep[y]))
                links["similarity"].append(found)
    return links


def _mixed(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the large groups that hold several classes."""
    rows = groups.join(classes, "rep")
    sized = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("class").alias("__lo"), F.max("class").alias("__hi"))
    mixed = sized.filter((F.col("n") > SMALL) & F.expr("__lo < __hi")).select("band", "key")
    return groups.join(mixed, ["band", "key"]).select(*groups.columns)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of `docs` that stay: of each class the document with the smallest id; rows without an id stay."""
    gone = near_duplicates(docs, similarity).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(materialise(gone, "removed_ids"), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
