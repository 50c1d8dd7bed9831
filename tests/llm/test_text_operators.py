"""Phrases, personal data, near duplicates, decontamination and pseudo-likelihood against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortwise.llm import decontaminate, masked_lm, near_dups, phrases, pii


def by_id(frame, *columns) -> dict:
    return {r[0]: tuple(r)[1:] for r in frame.filter("doc_id IS NOT NULL").select("doc_id", *columns).collect()}


def stripped(rows: list[tuple], width: int) -> dict:
    seen, out = {}, {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        keys = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        drop = {j for i, k in enumerate(keys) if k in seen for j in range(i, i + width)}
        for k in keys:
            seen.setdefault(k, doc)
        kept = b" ".join(w for j, w in enumerate(words) if j not in drop)
        out[doc] = (len(words), len(drop), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width, seed", [(50, 8), (9, 4)])
def test_phrases_equal_brute_force(docs, rows, width, seed):
    got = phrases.strip_repeats(docs, width, seed, with_text=False)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == stripped(rows, width)
    assert got.count() == len(rows) + 3


def test_phrases_of_a_hot_passage(spark, small):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(70)]
    word = lambda: f"v{rng.randrange(40)}"
    rows = [(i, " ".join([word() for _ in range(20)] + (passage if i % 3 else []) + [word() for _ in range(9)])) for i in range(300)]
    got = phrases.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == stripped(rows, 50)


def test_phrases_of_nothing(no_docs):
    assert phrases.strip_repeats(no_docs).count() == 0


def base_spans(text: str) -> list[tuple]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in pii.PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_personal_data_equals_whole_text_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a1.@+- 45(%x\né") for _ in range(rng.randrange(50))) for _ in range(20_000)]
    texts += ["9" * 4_000 + ".1.2.3", "4111 1111 1111 1111", "a@b.c@d.e", "+1 (255) 555-8013 x 10.0.0.256 0000010.1.1.1"]
    for text in texts:
        assert [s for s in pii.find(text) if s[0] < 4] == base_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@b", "a@" * 50_000 + "c.de", "1." * 50_000, "+1" * 50_000):  # in linear time
        assert len([s for s in pii.find(text) if s[0] < 4]) == {"1.": 12_500, "a@": 1}.get(text[:2], 0)


def test_added_personal_data():
    text = "see http://me:pw@host/x and https://10.0.0.1:80/ password=ab12cd34 iban: DE89370400440532013000 token x"
    added = [text[a:b] for k, a, b in pii.find(text) if k > 3]
    assert added == ["me:pw@host", "10.0.0.1:80", "ab12cd34", "DE89370400440532013000"]
    assert pii.redact(text, pii.find(text)).startswith("see http://[ADDRESS]/x and https://[IP]/ password=[ACCOUNT]")


def test_personal_data_reports_and_redacts(spark, docs, rows, no_docs):
    got = pii.personal_data_report(docs)
    texts = dict(rows)
    for doc, (emails, digest, spans) in by_id(got, "n_email", "base_sha256", "spans").items():
        found = pii.find(texts[doc])
        assert emails == sum(s[0] == 0 for s in found) and spans == pii.listing(found)
        assert digest == hashlib.sha256(pii.listing(found, 4).encode()).hexdigest()
    assert got.count() == docs.count() and pii.personal_data_report(no_docs).count() == 0
    frame = spark.createDataFrame([(1, "mail a@b.co", 11, None), (None, None, None, 3)], "doc_id int, text string, n_chars long, x int")
    out = pii.redact_documents(frame)
    assert out.schema == frame.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "mail [EMAIL]", 12, None), (None, None, None, 3)], frame.schema).collect()))
    assert pii.find_personal_data(docs).filter("doc_id = 0").first()["redacted"] is not None


def components(rows: list[tuple], similarity: float) -> tuple[dict, dict]:
    parts = {d: near_dups.features(near_dups.words_of(t)) for d, t in rows}
    counts = Counter(f for found, _ in parts.values() for f in found.tolist())
    idf = near_dups.idf_of({f: n for f, n in counts.items() if n > len(parts) / near_dups.RARE}, len(parts))
    holders = defaultdict(list)
    for doc, (found, _) in parts.items():
        for f in found.tolist():
            holders[f].append(doc)
    parent = {d: d for d in parts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        if near_dups.weighted_jaccard(parts[a], parts[b], idf) >= similarity:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in parts}, parts


def test_near_duplicates_equal_all_pairs(spark, rows, docs, no_docs):
    expected, _ = components(rows, near_dups.SIMILARITY)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d: c for d, (c,) in by_id(near_dups.near_duplicates(frame), "class_id").items()} == expected
    kept = near_dups.deduplicate(docs)
    assert {r.doc_id for r in kept.collect()} == {d for d, c in expected.items() if d == c} | {None}
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_near_copies_of_one_text_meet_without_all_pairs(spark, small):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(200), 1):
            words[at] = f"x{i}{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(80))) for i in range(30)]
    got = by_id(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "class_id")
    assert {got[i][0] for i in range(120)} == {0} and all(got[200 + i] == (200 + i,) for i in range(30))


def test_pairs_of_one_template_meet_between_outsiders(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(400), []
    for i in range(60):
        shared = fresh(20)
        rows += [(1_000 * k + i, " ".join([*template, *shared, *fresh(20)])) for k in (1, 2)]
    rows += [(9_000 * k + i, " ".join([*template, *fresh(40)])) for k in (0, 1) for i in range(20)]  # the ends
    expected, _ = components(rows, near_dups.SIMILARITY)
    assert expected == {d: d - 1_000 if 2_000 <= d < 9_000 else d for d, _ in rows}
    got = by_id(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "class_id")
    assert {d: c for d, (c,) in got.items()} == expected


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    """Pairs of one template whose longer keys never agree, and two classes with only one link among many near misses."""
    monkeypatch.setattr(near_dups, "LEVELS", ((1, near_dups.POOL),))
    monkeypatch.setattr(near_dups, "BLOCK", 80_000)
    rng = random.Random(8)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(400), []
    for i in range(60):
        shared = fresh(20)
        rows += [(1_000 * k + i, " ".join([*template, *shared, *fresh(20)])) for k in (1, 2)]
    front, back = fresh(45), fresh(45)
    rows += [(3_000 + i, " ".join([*front, *template, *fresh(5)])) for i in range(30)]
    rows += [(4_000 + i, " ".join([*template, *back, *fresh(5)])) for i in range(30)]
    rows += [(5_000, " ".join([*front[25:], *template, *back[:20]]))]
    expected, _ = components(rows, near_dups.SIMILARITY)
    got = by_id(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "class_id")
    assert {d: c for d, (c,) in got.items()} == expected


def test_profiles_rule_out_no_link():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 30, 31, 3_000]))) for _ in range(60)]
    texts += [t + " tail" for t in texts] + ["x " * 90_000, "x " * 88_000]
    parts = [near_dups.features(near_dups.words_of(t)) for t in texts]
    idf = near_dups.idf_of({int(parts[0][0][0]): 50}, len(texts))
    bins, weight = near_dups.profiles(parts, idf)
    bins = bins.astype(np.float32)
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            found = near_dups.weighted_jaccard(parts[i], parts[j], idf)
            if found >= near_dups.SIMILARITY:
                links += 1
                assert near_dups.possible(bins[i], weight[i], bins[j], weight[j], found) >= 0
    assert links > 20


def test_large_mixed_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """400 texts of one template, most of them just below the similarity of each other, some linked."""
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(300)], []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), rng.choice([1, 4, 8, 14, 20])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    expected, parts = components(rows, near_dups.SIMILARITY)
    written, keep = [], near_dups.materialise

    def counting(frame, name):
        out = keep(frame, name)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "materialise", counting)
    got = by_id(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "class_id")
    linked = [d for d, c in expected.items() if sum(x == c for x in expected.values()) > 1]
    met = [d for d in linked if got[d][0] != d or any(got[x][0] == d for x in linked if x != d)]
    assert len(met) >= 0.97 * len(linked) > 100
    assert all(expected[c] == expected[d] for d, (c,) in got.items())
    assert sum(written) < 40 * len(rows)


def test_short_tables_are_written_in_one_file(spark, monkeypatch):
    """Where shuffles have many partitions, a table of a few rows is not spread over all of them."""
    files, keep = [], near_dups.materialise

    def counting(frame, name):
        out = keep(frame, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(near_dups, "materialise", counting)
    many = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    rows = [(2 * i + k, " ".join([*(f"w{i}_{j}" for j in range(100)), f"x{i}_{k}"])) for i in range(40) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = by_id(near_dups.near_duplicates(frame), "class_id")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {d: c for d, (c,) in got.items()} == {d: d - d % 2 for d, _ in rows}
    short = [n for name, n in files if name in ("groups", "classes", "class_links", "labels", "links")]
    assert len(short) >= 6 and max(short) == 1


def test_document_frequencies_are_those_of_the_shingles(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(f for _, t in rows for f in near_dups.features(near_dups.words_of(t))[0].tolist())
    wanted = near_dups.idf_of({f: n for f, n in counts.items() if n > len(rows) / near_dups.RARE}, len(rows))
    got = near_dups.document_frequencies(frame)
    assert got.keys.tolist() == wanted.keys.tolist()
    assert got.values.tolist() == wanted.values.tolist()
    assert near_dups.idf_of({5: 3}, 30).values == near_dups.idf_of({5: 300}, 3_000).values  # a share, not a size
    assert near_dups.idf_of({1: 30, 2: 1}, 30).of(np.array([0, 1, 2], np.uint64)).tolist() == pytest.approx([1.5, 1.0, 1.3693], abs=1e-3)


def test_small_partitions_pass_on_frequent_shingles_only(spark, monkeypatch):
    """However finely the table is dealt: shingles of one text are left out where they are counted."""
    made, keep = [], near_dups.arrow_map

    def counting(df, work, schema):
        out = keep(df, work, schema)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "arrow_map", counting)
    texts = [(i, " ".join([*(["a b c d e"] if i % 8 == 0 else []), *(f"w{i}_{k}" for k in range(10))])) for i in range(3_200)]
    got = near_dups.document_frequencies(spark.createDataFrame(texts, "doc_id long, text string").repartition(40))
    common = near_dups.shingles(near_dups.words_of("a b c d e"))
    assert got.keys.tolist() == common.tolist() and made == [1]
    assert got.values.tolist() == near_dups.idf_of({int(common[0]): 400}, 3_200).values.tolist()


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    words = [f"w{k}".encode() for k in rng.integers(0, 50, 400)]
    other = words[:300] + [f"z{k}".encode() for k in range(100)]
    (fa, ca), (fb, cb) = near_dups.features(words), near_dups.features(other)
    draw = lambda f, c: near_dups.samples(f, np.log(c).astype(np.float32), np.array([0]), 4_000)
    share = float((draw(fa, ca) == draw(fb, cb)).mean())
    exact = near_dups.weighted_jaccard((fa, ca), (fb, cb), near_dups.idf_of({}, 1))
    assert abs(share - exact) < 0.04


def test_leaks_equal_search_for_whole_items(spark, small, docs, rows, no_docs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    quoted = [(10_000 + k, f"{rows[3][1]} {text} {rows[4][1]}") for k, (_, text) in enumerate(texts)]
    frame = spark.createDataFrame([*rows, *quoted], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, items).collect()}
    plain = {d: " ".join(decontaminate.normal_words(t)) for d, t in [*rows, *quoted]}
    assert got == {(d, i) for i, t in texts for d, p in plain.items() if " ".join(decontaminate.normal_words(t)) in p}
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()}
    assert kept == {d for d, _ in [*rows, (None, None)]} - {d for d, _ in got}
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()
    odd = spark.createDataFrame([(None, "x y z. a b c d e."), (1, None), (2, ""), (3, "...")], items.select("item_id", "text").schema)
    assert decontaminate.find_leaks(docs, odd).count() == 0


def quotes(index, texts: list[str]) -> list[set]:
    """Numbers of the items found in each text."""
    out = [set() for _ in texts]
    for i, item, *_ in decontaminate.leaks(texts, index, decontaminate.Terms(index.terms), decontaminate.MATCH, decontaminate.OVERLAP):
        out[i].add(item)
    return out


def test_changed_and_cut_items_are_found():
    rng = random.Random(6)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    index = decontaminate.Index([(k, " ".join(fresh(20)) + ". " + " ".join(fresh(4 + k % 3)) + ".") for k in range(20)])
    for item, (question, answer) in enumerate(index.parts):
        words = question + answer
        cases = [words, question, words[5:], words[:-6]]
        for k in range(len(words)):
            other = rng.randrange(len(words))
            cases += [[w if i != k else "new" for i, w in enumerate(words)]]
            cases += [[w if i not in (k, other) else "new" for i, w in enumerate(words)]]
        around = [" ".join([*fresh(50), *case, *fresh(50)]) for case in cases]
        assert quotes(index, around) == [{item}] * len(cases)
        shuffled = [" ".join([*fresh(50), *rng.sample(words, len(words)), *fresh(50)]) for _ in range(20)]
        assert quotes(index, shuffled) == [set()] * 20


def test_segments_give_the_rows_of_one_index(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(6, 50))) + "." for _ in range(40)]
    items = spark.createDataFrame([*enumerate(texts), (None, texts[0] + " z."), (50, "..."), (51, None)], "item_id long, text string")
    rows = []
    for k in range(400):
        words = rng.choice(texts).split()
        cut = words[: int(len(words) * rng.uniform(0.5, 1))]
        around = [" ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(40)) for _ in range(2)]
        rows.append((k, " ".join([around[0], *cut, around[1]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found() -> list:
        out = decontaminate.find_leaks(docs, items).collect()
        return sorted(((r.doc_id, -1 if r.item_id is None else r.item_id, r.first_word, *(round(x, 9) for x in r[3:])) for r in out))

    whole = found()
    monkeypatch.setattr(decontaminate, "SEGMENT_ITEMS", 15)
    assert found() == whole and len(whole) > 100
    no_words = spark.createDataFrame([(k, "...") for k in range(40)], "item_id long, text string")
    assert decontaminate.find_leaks(docs, no_words).count() == 0


def test_block_max_search_equals_full_scores():
    rng = random.Random(3)
    items = [(k, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(3, 25))) + ".") for k in range(90)]
    index = decontaminate.Index(items)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 50)))
        whole = defaultdict(float)
        for t in terms:
            for item, gain in index.postings[t]:
                whole[item] += gain
        blocks = [b for b in range(index.largest.shape[1]) if index.largest[terms, b].sum() >= 0.5 - 1e-4]
        got = dict(index.search(terms, blocks, 0.5))
        assert got.keys() == {i for i, s in whole.items() if s >= 0.5 - 1e-9}
        assert all(abs(got[i] - whole[i]) < 1e-9 for i in got)


def exact_log_softmax(logits: np.ndarray, at: int) -> float:
    return logits[at] - np.log(np.exp(logits.astype(np.float64)).sum())


def test_pseudo_likelihood_equals_word_by_word_sums(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(masked_lm, "BUNDLE_WORDS", 3_000)
    model = masked_lm.fit(docs)
    net, leaves = model.network, model.leaves
    counts = Counter(w for _, t in [*rows, (0, rows[1][1]), rows[2]] for w in (t or "").encode().split())
    found = {r.word: r.n for r in model.words.collect()}
    hashes = dict(zip(counts, masked_lm.hash_words(list(counts)).view(np.int64).tolist(), strict=True))
    assert found == {hashes[w]: n for w, n in counts.items()}  # exact, whatever the size of the corpus

    def brute(text):
        words = (text or "").encode().split()
        n = np.array([counts[w] for w in words], np.int64)
        own = masked_lm.hash_words(words).view(np.int64)
        at = leaves.of(own, n) if words else n
        line, total = [net.outside] * 2 + at.tolist() + [net.outside] * 2, 0.0
        for k in range(len(words)):
            around = [line[k + 2 + o] for o in masked_lm.OFFSETS]
            h = np.tanh(sum(net.embeddings[j][c] for j, c in enumerate(around)) + net.hidden_bias)
            group, place = divmod(line[k + 2], net.width)
            total += exact_log_softmax(h @ net.outer + net.outer_bias, group)
            total += exact_log_softmax(h @ net.inner[group] + net.inner_bias[group], place)
        return len(words), total + float(leaves.log_inside(at, n).sum())

    got, whole = (by_id(f, "n_words", "log_likelihood") for f in (masked_lm.score(docs, model), masked_lm.score_corpus(docs)))
    for doc, text in [*rows[:5], rows[-1], rows[-12]]:
        size, total = brute(text)
        assert got[doc] == (size, pytest.approx(total, rel=1e-4, abs=1e-4))
        assert whole[doc][0] == size
    assert masked_lm.score(docs, model).count() == len(rows) + 3
    assert masked_lm.score_corpus(no_docs).count() == 0
    assert by_id(masked_lm.score(docs.limit(5), masked_lm.fit(no_docs)), "n_words")  # words never seen


def test_leaves_cover_all_words_and_grow_with_them(spark):
    """Words have one leaf each, P(word | leaf) adds up to one, and sixteen times the words give over 2.5 times the leaves."""
    sizes = []
    for different in (2_000, 32_000):
        words = spark.range(different).selectExpr("xxhash64(id) word", "cast(1 + 200000 div (id * id + 1) as bigint) n")
        leaves = masked_lm.leaves_of(words)
        rows = words.toArrow()
        word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
        at = leaves.of(word, n)
        assert at.min() == 0 and at.max() < leaves.size
        inside = np.bincount(at, np.exp(leaves.log_inside(at, n)), leaves.size)
        unseen = 1 / (leaves.occurrences + leaves.different + 1)
        assert np.allclose((inside + unseen)[np.unique(at)], 1)
        assert np.bincount(at)[at[n == n.max()]].tolist() == [1]
        sizes.append(leaves.size)
    assert sizes[1] > 2.5 * sizes[0]


def test_shuffled_words_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = masked_lm.fit(docs)
    rng = random.Random(1)
    kept = [r for r in docs.limit(200).collect() if len(r.text.split()) > 30]
    mixed = spark.createDataFrame([(r.doc_id, " ".join(rng.sample(r.text.split(), len(r.text.split())))) for r in kept], docs.schema)
    whole, other = (by_id(masked_lm.score(d, model), "log_likelihood") for d in (docs, mixed))
    assert np.mean([whole[i][0] > other[i][0] for i in other]) > 0.6


def test_network_gradient():
    leaves = 30  # five groups of six
    net = masked_lm.Network.fresh(np.log(np.full(leaves, 1 / leaves)))
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, leaves + 1, (4, 50)), rng.integers(0, leaves, 50)
    flat, gradient = net.flat().astype(np.float64), net.gradient(around, target)
    for k in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 20):
        step = np.zeros(len(flat))
        step[k] = 1e-2
        up, down = (-net.shaped(flat + s).log_probabilities(around, target).mean() for s in (step, -step))
        assert (up - down) / 2e-2 == pytest.approx(gradient[k], rel=0.05, abs=1e-4)
    every = [net.log_probabilities(np.repeat(around[:, :1], leaves, axis=1), np.arange(leaves))]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
