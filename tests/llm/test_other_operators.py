"""Neighbours, URLs, toxicity, packing, records and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortwise.llm import near_dups, neighbours, packing, pii, records, toxicity, urls
from cohortwise.llm.encoding import Encoder
from cohortwise.llm.queries import QUERIES, SQL

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def nearest(rows: list[tuple], k: int) -> list[tuple]:
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        scored = []
        for c, v in good.items():
            if c != q and len(v) == len(good[q]):
                total = 0.0
                for a, b in zip(good[q], v, strict=True):
                    total += a * b
                scored.append((-total, c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return out


def test_neighbours_equal_brute_force(spark, small):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(i, [0.5, 1.0] * 4) for i in range(400, 560)]  # a common vector: ties
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0] * 7 + [None]), (1080, [math.nan] * 8), (1100, [math.inf] + [1.0] * 7)]
    rows += [(1120, [1e200] * 8), (1121, [-1e200] * 8), (1140, [1e-200] * 8), (1160, [1.0, 2.0]), (1161, [3.0, 1.0]), (None, [1.0] * 8)]
    rows += [(0, rows[0][1]), (20, [9.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tile", F.lit(1)).withColumn("width", F.lit(2))
    got = sorted(map(tuple, neighbours.nearest(frame, "vec_id % 20 = 0").collect()))
    assert got == nearest(rows, 20)
    assert neighbours.nearest(frame.limit(0), "vec_id % 20 = 0").count() == 0


def judged(pages: list[tuple]) -> dict:
    """The filter spelled out with dictionaries."""

    def parts(url):
        hit = re.search(r"://([^/?#]*)([^?#]*)", url)
        return (hit[1].translate(str.maketrans(urls._UPPER, urls._LOWER)), hit[2]) if hit else ("", "")

    def rule(host, path):
        fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]), default=None)

    import hashlib

    known = {}
    for _, url in pages:
        url = url or ""
        digest = hashlib.md5(url.encode()).hexdigest()[0]
        found = rule(*parts(url))
        known[url] = (found and found[2], digest not in urls.CALIBRATION)
    counts = {k: defaultdict(Counter) for k in ("allow", "block")}
    line = lambda u: urls.START * urls.ORDER + u.translate(str.maketrans(urls._UPPER, urls._LOWER)) + urls.END
    for url, (ruling, counted) in known.items():
        if ruling and counted:
            text = line(url)
            for at in range(urls.ORDER, len(text)):
                for k in range(urls.ORDER + 1):
                    counts[ruling][text[at - k : at]][text[at]] += 1

    def p(kind, context, char):
        below = p(kind, context[1:], char) if context else 1 / urls.ALPHABET
        seen = counts[kind][context]
        n = sum(seen.values())
        return (seen[char] + len(seen) * below) / (n + len(seen)) if n else below

    micro = {}
    for url in known:
        text = line(url)
        terms = []
        for at in range(urls.ORDER, len(text)):
            context = text[at - urls.ORDER : at]
            terms.append(round(1e6 * (math.log(p("block", context, text[at])) - math.log(p("allow", context, text[at])))))
        micro[url] = sum(terms) // len(terms)
    steps = defaultdict(Counter)
    for url, (ruling, counted) in known.items():
        if ruling and not counted:
            steps[micro[url] // 1000][ruling] += 1
    totals = Counter()
    for c in steps.values():
        totals += c
    best, cut, run = None, None, Counter()
    for step in sorted(steps, reverse=True):
        run += steps[step]
        if totals["allow"] and totals["block"]:
            gain = run["block"] / totals["block"] - run["allow"] / totals["allow"]
            if best is None or (gain, step) > best:
                best, cut = (gain, step), step * 1000
    both = {r for r, counted in known.values() if r and counted} == {"allow", "block"}
    out = {}
    for page, url in pages:
        host, path = parts(url or "")
        found = rule(host, path)
        model = "block" if both and cut is not None and micro[url or ""] >= cut else "allow"
        out[page] = (host, path, found and found[0] + found[1], found[2] if found else model)
    return out


def test_urls_equal_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    pages = [tuple(r) for r in table.collect()]
    odd = [None, "", "no scheme", "http://EXAMPLE.com", "http://COM/", "x://a.net/es/y?z", "http://a.net/ES/", "http://www.example.com/en/x", "http://b.www.example.com/en/", "http://éÀ.example.com/en/#x", "://net/fr/://com/", "http://xnet/fr/a", "z" * 5_000]
    pages += [(10_000 + k, u) for k, u in enumerate(odd)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("gram", F.lit(1)).withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame).collect()}
    assert got == judged(pages)
    assert urls.judge(frame.limit(0)).count() == 0
    unruled = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert sorted(str(r.verdict) for r in urls.judge(unruled).collect()) == ["allow"] * 3


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    bad = ["zorgblat", "quixmuck", "vylkrent"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        if toxic := i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    edges = [(2000, None), (2001, ""), (None, "zorgblat"), (2002, "zor.gblat here"), (2003, "z o r g b l a t"), (2004, "quixxmuck"), (5, rows[5][1])]
    docs = spark.createDataFrame([*rows, *edges], "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit(1))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(docs, marks)
    got = [r for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) + len(edges)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([p == t for p, t in held]) > 0.97
    by = {r.doc_id: r.predicted for r in got}
    assert (by[2000], by[2001], by[2002], by[2004]) == (0, 0, 1, 1)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r.predicted for r in got)
    empty = toxicity.fit(docs.limit(0), marks)
    assert toxicity.score(docs.limit(0), empty).count() == 0 and set(toxicity.score(docs, empty).toPandas().predicted) == {0}


def test_kernel_machine_equals_kernel_sums():
    """One weight per triple gives what explicit kernel features give."""
    rng = np.random.default_rng(0)
    weights = rng.normal(size=toxicity.ALPHABET**3).astype(np.float32)
    machine = toxicity.Model(weights, 0.25, 1, 0)
    words = [bytes(rng.integers(1, 27, rng.integers(3, 12)).tolist()) for _ in range(50)]
    _, values = machine.decisions(np.frombuffer(b"\0".join(words) + b"\0", np.uint8))
    number, triple, weight = toxicity._kernel_features(words)
    assert np.allclose(values, np.bincount(number, weights[triple] * weight, 50) + 0.25, atol=1e-4)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_tokenizers(path, rows):
    fast, plain = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [t or "" for _, t in rows] + ["".join(rng.choice("ab's ,.\n\t\u00a0é1$<|>Σ") for _ in range(rng.randrange(30))) for _ in range(4_000)]
    for text in texts:
        assert fast.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def one_by_one(lengths: list[int], capacity: int) -> list[int]:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        room = [r for r in bins if r >= n]
        if room:
            at = bins.index(min(room))
            bins[at] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_packing_plan_equals_one_by_one():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, rng.choice([capacity, 5])) for _ in range(rng.randrange(1, 120))]
        groups = packing.best_fit_decreasing(Counter(lengths), capacity)
        assert sorted(capacity - sum(n * k for n, k in parts) for m, parts in groups for _ in range(m)) == one_by_one(lengths, capacity)
    tree = packing.CapacityTree(100)
    marked = {3, 17, 64, 100}
    for m in marked:
        tree.mark(m, True)
    assert [tree.tightest(n) for n in range(101)] == [min(m for m in marked if m >= n) for n in range(101)]


def test_packed_documents(docs, no_docs):
    got = packing.pack_documents(docs, BYTES, 256, with_ids=True).toPandas()
    plain = Tokenizer.from_file(BYTES)
    wanted = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, (at, n) in enumerate(packing.cut(len(ids), 256)):
            wanted[r.doc_id, k, at, n, np.array(ids[at : at + n], "<u4").tobytes()] += 1
    rows = zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got.piece, got.start, got.length, map(bytes, got.ids), strict=True)
    assert Counter((None if d is None else int(d), *r) for d, *r in rows) == wanted
    assert (got.ids_crc32 == [zlib.crc32(i) for i in got.ids]).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all() and own.length.sum() <= 256
    assert got.sequence_id.nunique() == len(one_by_one(got.length.tolist(), 256))
    assert packing.pack_documents(no_docs, BYTES).count() == 0


def test_records_round_trip(spark, docs, no_docs, tmp_path):
    records.write_records(docs, f"{tmp_path}/r", WORDS)
    records.write_index(spark, f"{tmp_path}/r", f"{tmp_path}/i")
    index = records.read_index(spark, f"{tmp_path}/i")
    plain = Tokenizer.from_file(WORDS)
    encoded = [
        (r.doc_id, np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect()
    ]
    key = lambda r: r[1]
    wanted = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in records.read_records(spark, f"{tmp_path}/r", index).collect()), key=key)
    place = lambda doc: -1 if doc is None else doc
    assert [place(d) for d, _, _ in wanted] == sorted(place(d) for d, _ in encoded)
    assert sorted((place(d), i) for d, _, i in wanted) == sorted((place(d), i) for d, i in encoded)
    assert [s for _, s, _ in wanted] == [sum(len(i) // 4 for _, _, i in wanted[:k]) for k in range(len(wanted))]
    assert {(r.start, r.n_tokens, r.ids_crc32) for r in index.collect()} == {(s, len(i) // 4, zlib.crc32(i)) for _, s, i in wanted}
    some = index.filter("start % 3 = 0").orderBy(F.rand(4))
    picked = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in records.read_records(spark, f"{tmp_path}/r", some).collect()), key=key)
    assert picked == [w for w in wanted if w[1] % 3 == 0]
    scanned = records.scan_records(spark, f"{tmp_path}/r")
    assert sorted(bytes(r.ids) for r in scanned.collect()) == sorted(i for _, _, i in wanted)
    records.write_records(no_docs, f"{tmp_path}/n", WORDS)
    assert records.scan_records(spark, f"{tmp_path}/n").count() == 0


def test_starts_follow_file_numbers_and_many_rows_without_id_are_spread(spark, docs, tmp_path, monkeypatch):
    schema = "file string, byte_offset long, byte_length long, ids_before long, doc_id long, n_tokens long, ids_crc32 long"
    files = [(f"part-{k:05d}-x.txt", 0, 9, 0, k, 10 + k % 2, 0) for k in (100_001, 99_999, 100_000, 99_998)]
    spark.createDataFrame(files, schema).write.parquet(f"{tmp_path}/i")
    starts = {r.doc_id: r.start for r in records.read_index(spark, f"{tmp_path}/i").collect()}
    assert starts == {99_998: 0, 99_999: 10, 100_000: 21, 100_001: 31}
    monkeypatch.setattr(records, "FILE_CHARACTERS", 2_000)
    nameless = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c d e f g h i j k l m n o p q r s t' AS text").repartition(4)
    records.write_records(nameless, f"{tmp_path}/r", WORDS)
    sizes = [r["count"] for r in records.scan_records(spark, f"{tmp_path}/r").groupBy("file").count().collect()]
    assert sum(sizes) == 400
    assert max(sizes) < 200


def test_damaged_records_are_refused():
    good = records.frame(records.payload_of(7, np.array([1, 70_000], "<u4"), 4))
    doc, ids, end = records.read_frame(memoryview(good), 0)
    assert (doc, ids.tolist(), end) == (7, [1, 70_000], len(good))
    for at in range(len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged|cut off"):
            records.read_frame(memoryview(bytes(bad)), 0)
    for size in range(1, len(good)):
        with pytest.raises(ValueError, match="damaged|cut off"):
            records.read_frame(memoryview(good[:size]), 0)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, small)
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    ids = {r.doc_id for r in first.collect()}
    assert ids == {d for d, p in scores.items() if not p}
    second = corpus_pipeline.drop_near_duplicates(spark, first, small)
    assert second.count() == near_dups.near_duplicates(first).select("class_id").distinct().count()
    third = corpus_pipeline.drop_benchmark_leaks(spark, second, small)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in third.collect() for i in items)
    fourth = corpus_pipeline.redact_personal_data(spark, third, small)
    assert fourth.schema == third.schema == docs.schema
    assert {r.doc_id: r.text for r in fourth.collect()} == {r.doc_id: pii.redact(r.text, pii.find(r.text)) for r in third.collect()}
    assert all(r.n_chars == len(r.text) for r in fourth.collect())
    whole = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in fourth.collect()}


def test_queries_run(spark, small):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and SQL.keys() <= QUERIES.keys()
    contract = {
        "op1": ["query_id", "rank", "vec_id", "score"],
        "op2": ["page_id", "host", "path", "rule", "verdict"],
        "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op5": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op7": ["doc_id", "held_out", "score", "predicted"],
        "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op10": ["doc_id", "start", "n_tokens", "ids_crc32"],
    }
    for name, query in QUERIES.items():
        frame = query(spark, small)
        assert set(contract.get(name.split("_")[0], [])) <= set(frame.columns), name
