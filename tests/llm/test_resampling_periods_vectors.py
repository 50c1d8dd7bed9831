"""Importance resampling, periodic runs and vector packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import periods, resampling, vector_packing
from cohortwise.llm.encoding import Encoder
from cohortwise.llm.queries import QUERIES
from cohortwise.llm.vector_packing import Limits

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def features_by_definition(text: str | None, order: int) -> list[int]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) for r in runs], len(words)


def resampled(rows: list[tuple], target: list, order: int, buckets: int, share: int, least: int) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(f % buckets for f in features_by_definition(text, order)[0])
    for text in target:
        t.update(f % buckets for f in features_by_definition(text, order)[0])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, able = [], []
    for doc, text in rows:
        found, words = features_by_definition(text, order)
        weight = sum(math.floor(1000 * math.log((t[f % buckets] + 1) * all_s / ((s[f % buckets] + 1) * all_t))) for f in found)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, len(found), weight, score, None])
        if words >= least and doc is not None:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, row in enumerate(able[: len(able) * share // 100]):
        row[4] = k + 1
    return [tuple(r) for r in out]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("order", "share"), [(1, 10), (3, 55)])
def test_resampling_equals_brute_force(spark, small, docs, order, share):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = spark.read.parquet(f"{small}/benchmark.parquet").select("text").union(spark.createDataFrame([(None,), ("",)], "text string"))
    names = [r.text for r in target.collect()]
    got = resampling.resample(docs, target.withColumn("doc_id", F.lit("x")), order, 500, share)
    assert in_order(map(tuple, got.collect())) == in_order(resampled(rows, names, order, 500, share, 20))


def test_resampling_of_empty_tables(spark, docs, no_docs):
    assert resampling.resample(no_docs, docs).count() == 0
    got = resampling.resample(docs, no_docs, share=0)
    assert got.filter("rank IS NOT NULL").count() == 0
    assert got.count() == docs.count()


def test_resampling_reads_words_across_chunks_and_never_across_texts(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_WORDS", 3)
    texts = ["a b c d e", "", "C D", "x-y Z9 été", "one", "a b c d e f g"]
    counted, words = defaultdict(Counter), np.zeros(len(texts), np.int64)
    for doc, bucket, number in resampling.features([t.encode() for t in texts], 4, resampling.Buckets(997)):
        words += number
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            counted[d][b] += 1
    for d, text in enumerate(texts):
        found, n = features_by_definition(text, 4)
        assert counted[d] == Counter(f % 997 for f in found)
        assert words[d] == n


def runs_by_definition(words: list, least: int = 24) -> list[tuple]:
    out, n = set(), len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                part = words[i : j + q]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng: random.Random) -> list[list[bytes]]:
    texts = []
    for _ in range(rng.randint(1, 6)):
        n, letters = rng.choice([0, 5, 24, 40, 100, 300]), rng.choice([1, 2, 3, 5, 1000])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 30 else 0):
            p, a = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randint(2 * p, 5 * p + 24))):
                words[i] = words[i - p]
        texts += [words] * rng.choice([1, 1, 2])
    return texts


def test_runs_equal_the_definition():
    rng, some = random.Random(8), 0
    for _ in range(250):
        texts = periodic_texts(rng)
        wanted = [runs_by_definition(w) for w in texts]
        assert periods.runs_of(texts) == wanted
        some += sum(map(len, wanted))
    assert some > 200


@pytest.mark.parametrize("period", [*range(1, 40), 63, 64, 65, 100, 127, 128, 129])
def test_shortest_runs_of_every_period_at_every_place(period):
    """Just long enough, anywhere on the grid: found; one word less: not."""
    length = max(24, 3 * period)
    for shift in range(0, 2 * period + 9, max(1, period // 5)):
        for cut in (0, 1):
            unit = [b"u%d" % k for k in range(period)]
            words = [b"l%d" % k for k in range(shift)] + (unit * 30)[: length - cut] + [b"r%d" % k for k in range(9)]
            assert periods.runs_of([words]) == [[(shift, length, period)] if not cut else []]


def test_wavelet_tree_successors():
    rng = np.random.default_rng(4)
    values = rng.permutation(500)[:300]
    tree = periods.WaveletTree(values, 500)
    low = rng.integers(0, 300, 400)
    high = np.minimum(300, low + rng.integers(0, 60, 400))
    after = rng.integers(0, 500, 400)
    for a, b, x, got in zip(low, high, after, tree.successor(low, high, after), strict=True):
        assert got == min((v for v in values[a:b] if v > x), default=-1)


def test_agreement_to_both_sides():
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(2) for _ in range(200)]
    line = periods.Line([words[:120], words[120:]])
    symbols = [(0, w) for w in words[:120]] + [(1, w) for w in words[120:]]
    pairs = [sorted(rng.sample(range(200), 2)) for _ in range(300)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    for i, j, forward, backward in zip(a, b, line.forward(a, b), line.backward(a, b), strict=True):
        assert forward == next((k for k in range(200 - j) if symbols[i + k] != symbols[j + k]), 200 - j)
        assert backward == next((k for k in range(i) if symbols[i - 1 - k] != symbols[j - 1 - k]), i)


def described(doc: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


def test_periodic_runs_equal_brute_force(spark, docs):
    short = docs.select("doc_id", "text", "rep", "class").filter("text IS NULL OR length(text) < 20000")
    more = [(9_000 + k, " ".join(["a b c"] * k)) for k in (0, 7, 8, 20)] + [(9_100, "x " * 300), (9_100, "x " * 300)]
    short = short.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = periods.find_runs(short, with_text=False, prepare=periods.planted).drop("runs", "collapsed", "n_words")
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    wanted = [described(*r) for r in short.select("doc_id", "text").collect()]
    assert in_order(map(tuple, got.collect())) == in_order(wanted)
    assert sum(w[1] for w in wanted) > 10


def test_runs_of_long_texts_and_the_text_that_is_left(spark, no_docs):
    words = [f"w{k}" for k in range(170_000)]  # more than is searched at once
    words[1_000:91_000] = [f"p{k % 30_000}" for k in range(90_000)]
    frame = spark.createDataFrame([(5, " ".join(words)), (6, "b " * 40)], "doc_id long, text string")
    long, short = periods.find_runs(frame).orderBy("doc_id").collect()
    assert [tuple(r) for r in long.runs] == [(1_000, 90_000, 30_000)]
    assert long.collapsed.split() == words[:31_000] + words[91_000:]
    assert (short.collapsed, short.exponent_milli) == ("b", 40_000)
    assert periods.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(no_docs, least=23)


def checked_sequences(rows, most: int) -> dict:
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append(row)
    for content in sequences.values():
        content.sort(key=lambda r: r.offset)
        total = sum(r.length for r in content)
        assert [r.offset for r in content] == [sum(r.length for r in content[:k]) for k in range(len(content))]
        assert total == most or total & (total - 1) == 0  # nothing is padded
    return sequences


@pytest.mark.parametrize("limits", [Limits(), Limits(segments=3), Limits(tokens=100, segments=7, loss=64)])
def test_cut_pieces_hold_every_id_once_without_padding(docs, limits):
    rows = vector_packing.pack_documents(docs, BYTES, limits, with_ids=True).collect()
    size, encode = min(limits.tokens, limits.loss), Encoder(BYTES).whole
    sequences = checked_sequences(rows, size)
    assert max(len(c) for c in sequences.values()) <= limits.segments
    wanted = sorted(
        ((i is not None, i or 0), (encode(t) if t else b"") + b"\x01\0\0\0") for i, t in docs.select("doc_id", "text").collect()
    )
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id is not None, r.doc_id or 0)].append(r)
    for key, own in pieces.items():
        texts = sorted(t for k, t in wanted if k == key)
        held = Counter((r.start, r.doc_tokens) for r in own)
        if len(texts) == 1:  # ids that are there once: the pieces in order are the document
            own.sort(key=lambda r: r.start)
            assert b"".join(r.ids for r in own) == texts[0]
            assert {r.doc_tokens for r in own} == {len(texts[0]) // 4}
            assert max(held.values()) == 1
        else:
            assert sum(r.length for r in own) == sum(len(t) // 4 for t in texts)
    assert len(pieces) == len({k for k, _ in wanted})


def test_cut_packing_at_random():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(0, rng.choice([2, 30, 300]), rng.integers(0, 200))
        limits = Limits(tokens=int(rng.integers(1, 200)), segments=int(rng.integers(1, 9)))
        covered = [np.zeros(n, int) for n in lengths]
        for content in vector_packing.pack_cut(lengths, limits):
            total = sum(n for _, _, n in content)
            assert 0 < len(content) <= limits.segments
            assert total == limits.tokens or total & (total - 1) == 0
            for k, at, n in content:
                covered[k][at : at + n] += 1
        assert all((c == 1).all() for c in covered)


def test_whole_examples_keep_every_limit():
    rng = np.random.default_rng(7)
    tokens = rng.integers(1, 900, 600)
    loss = (tokens * rng.random(600)).astype(int)
    demand = np.column_stack([np.r_[tokens, 3000, 500], np.r_[loss, 0, 900]])
    limits = Limits(tokens=1000, segments=6, loss=500)
    packed = vector_packing.pack_whole(demand, limits)
    placed = sorted(k for content in packed for k in content)
    fits = [k for k, (t, n) in enumerate(demand.tolist()) if t <= 1000 and n <= 500]
    assert placed == fits
    for content in packed:
        assert len(content) <= 6
        assert (demand[content].sum(axis=0) <= [1000, 500]).all()
    least = max(demand[fits, 0].sum() / 1000, demand[fits, 1].sum() / 500, len(fits) / 6)
    assert len(packed) <= 1.1 * least


def test_first_choice_is_the_largest_dot_product():
    demand, limits = np.array([[500, 10], [400, 390], [100, 100]]), Limits(1000, 10, 400)
    rows = np.column_stack([demand[:, 0], np.ones(3), demand[:, 1]])
    scale = rows.mean(axis=0) / limits.vector() ** 3
    scores = rows @ (limits.vector() * scale)
    assert vector_packing.pack_whole(demand, limits)[0][0] == scores.argmax()


def test_conversations_as_examples(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "role", "text")
    turns = turns.union(spark.createDataFrame([(None, "user", "a b"), (None, "assistant", None)], turns.schema))
    examples = vector_packing.conversation_examples(turns, BYTES)
    encode, wanted = Encoder(BYTES).whole, defaultdict(lambda: [0, 0])
    for k, (conv, role, text) in enumerate(turns.collect()):
        n = len(encode(text or "")) // 4 + 1
        own = wanted[conv if conv is not None else -k - 1]
        own[0] += n
        own[1] += n if role == "assistant" else 0
    got = [tuple(r) for r in examples.collect()]
    assert in_order(got) == in_order((c if c >= 0 else None, *n) for c, n in wanted.items())
    limits = Limits(4096, 20, 2500)
    rows = vector_packing.pack_examples(examples, limits).collect()
    assert len(rows) == len(got)
    used = defaultdict(list)
    for r in rows:
        if r.sequence_id is None:
            assert r.n_tokens > 4096 or r.n_loss > 2500
        else:
            used[r.sequence_id].append(r)
    for own in used.values():
        own.sort(key=lambda r: r.offset)
        assert len(own) <= 20
        assert sum(r.n_tokens for r in own) <= 4096
        assert sum(r.n_loss for r in own) <= 2500
        assert [r.offset for r in own] == [sum(r.n_tokens for r in own[:k]) for k in range(len(own))]
    assert vector_packing.pack_examples(examples.limit(0), limits).count() == 0


def test_queries_return_their_columns(spark, small, no_docs):
    assert vector_packing.pack_documents(no_docs, BYTES).count() == 0
    rows = QUERIES["op13_vector_packing"](spark, small).collect()
    checked_sequences(rows, 2048)
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    total = spark.read.parquet(f"{small}/documents.parquet").count()
    assert QUERIES["op12_periodic_runs"](spark, small).count() == total
    assert QUERIES["op11_importance_resampling"](spark, small).count() == total
