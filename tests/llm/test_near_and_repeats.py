import hashlib
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from zephyria.llm import ngram_join, repeat_index, shingles, suffix_dedup
from zephyria.llm.common import importable_on_workers, with_keys
from zephyria.llm.components import components

SCHEMA = "doc_id long, text string"


def copies(seed, groups=12, size=10):
    """Texts with near copies at many similarities, short texts and shared passages."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = ["", None, " \n ", "one", "ONE", "one two three", "one two  three", "one two three four five"]
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(5, 150))
        for _ in range(size):
            text = [rng.choice(words) if rng.random() < rng.choice((0, 0.005, 0.02, 0.04)) else w for w in base]
            if rng.random() < 0.3:
                text += passage.split()[: rng.randint(5, 60)]
            out.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3), (3, 5)])
def test_links_are_all_found(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = copies(seed)
    got = ngram_join.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.linked(rows)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_words_that_cancel_in_sums_of_powers(spark):
    """Texts of long self-similar words that share no word are not one set."""
    rows = []
    for size in (64, 256, 1024, 2048, 4096):
        one, two = thue_morse(size), thue_morse(size, "ba")
        rows += [(len(rows), " ".join(one + str(i) * 3 for i in range(5))), (len(rows) + 1, " ".join(two + str(i) * 3 for i in range(5)))]
        rows += [(len(rows), " ".join([one] * 5)), (len(rows) + 1, " ".join([two] * 5))]
    assert len({tuple(shingles.shingle_set(t).tolist()) for _, t in rows}) == len(rows)
    got = ngram_join.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d for d, _ in rows}


def test_words_are_told_apart_by_every_byte():
    words = sorted({bytes([65 + (i >> s) % 26 for s in range(0, 4)]) * (1 + i % 5) for i in range(3000)} | {b"x" * n for n in range(1, 300)})
    assert len(set(shingles.word_hashes(b" ".join(words)).tolist())) == len(words)
    assert (shingles.word_hashes(b"  a\tbc a ")[[0, 2]] == shingles.word_hashes(b"a a")).all()


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    rows = copies(4, groups=1, size=120)
    got = ngram_join.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.linked(rows)


def test_shared_counts_and_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join.shared_counts(sets)
    off = ~np.eye(70, dtype=bool)
    assert (got == want)[off].all()
    n = np.array([len(s) for s in sets])
    assert (ngram_join.linked(sets) == ((100 * want >= 80 * (n[:, None] + n[None, :] - want)) & off)).all()


def one_last_word_apart(words, n):
    """Texts that differ only in their last word, and one without it."""
    base = " ".join("b%d" % i for i in range(words - 1))
    return [(0, base), *((i, f"{base} x{i}") for i in range(1, n))]


@pytest.mark.parametrize("words, n", [(9, 41), (13, 600), (14, 1000)])
def test_short_texts_of_a_large_group_keep_their_links(spark, words, n):
    rows = one_last_word_apart(words, n)
    sets = [ngram_join.shingle_set(t) for _, t in rows]
    size = np.array([len(s) for s in sets])
    both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets[:40]] for a in sets[:40]])
    want = 100 * both >= 80 * (size[:40, None] + size[None, :40] - both)
    assert (ngram_join.linked(sets)[:40, :40] == (want & ~np.eye(40, dtype=bool))).all()
    got = ngram_join.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.linked(rows)


def test_near_ids_null_and_repeated(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (7, None), (8, "z")], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_report(df).collect())
    assert got == [(-1, 6, 4), (4, 6, 4), (4, 6, 4), (7, 0, 7), (8, 1, 8)]
    assert ngram_join.keep_one(df.withColumnRenamed("x", "y")).count() == 3
    assert ngram_join.near_duplicate_report(df.limit(0)).count() == 0


def test_a_shingle_of_all_sets_reaches_its_bucket_once_a_pack(spark):
    rows = [(i, "a b c d e " + " ".join(f"w{i}x{j}" for j in range(6)), "x") for i in range(90)]
    keyed = with_keys(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3))
    importable_on_workers(spark)
    packs = ngram_join.packed_shingles(keyed, 4).collect()
    often = [r for r in packs if r["kind"] == ngram_join.OFTEN]
    assert len(often) == 3 and {len(r["body"]) for r in often} == {8}
    assert sum(int.from_bytes(r["body"][4:], "little") for r in often) == 90


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


# ---------------------------------------------------------------- long repeats


def test_index_finds_first_places():
    rng = random.Random(1)
    for _ in range(200):
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        pieces += rng.choices(pieces, k=2)
        index = repeat_index.RepeatIndex(pieces)
        seen, want, at = {}, [], 0
        for p in pieces:
            want += [seen.setdefault(p[i : i + 5], at + i) if i + 5 <= len(p) else None for i in range(len(p))]
            at += len(p)
        got = index.sources(5)
        assert all(w is None or w == g for g, w in zip(got, want))


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(4)]
    out = ["", None, "x" * 99, "x" * 100, "x" * 5000, "ab" * 700, "é" * 300, shared[0]]
    for _ in range(60):
        text = " ".join(word() for _ in range(rng.randint(5, 60)))
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.randint(0, len(s) // 2)
            text = f"{text} {s[cut:]}{word()}"
        out += [text] * rng.choice((1, 1, 1, 2))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, block, hot, many", [(1, 1 << 21, 1 << 18, 8), (2, 2000, 1500, 1), (3, 400, 0, 0), (4, 1 << 20, 300, 2)])
def test_covered_bytes(spark, monkeypatch, seed, block, hot, many):
    """Also where routes are hot: counted by one piece a task, windows met by their own hashes."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix_dedup, "ROUTE_PIECES", many)
    monkeypatch.setattr(suffix_dedup, "PIECE_WINDOWS", 300)
    rows = passages(seed)
    got = {r.doc_id: r for r in suffix_dedup.repeat_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, (data, covered) in plain.repeats(rows).items():
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(data), sum(covered), runs)
        assert got[d].kept_sha256 == hashlib.sha256(plain.cut(data, covered)).hexdigest()


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 700)
    data = bytes(random.Random(2).choices(b"abcd", k=5000))
    whole, windows = suffix_dedup.pieces_of(data), []
    for at, part in suffix_dedup.text_parts(data):
        route, _, start, count, _ = suffix_dedup.pieces_of(part)
        for r, s, n in zip(route, start, count):
            windows += [(at + s + i, r) for i in range(n)]
    assert sorted(windows) == sorted((s + i, r) for r, s, n in zip(whole[0], whole[2], whole[3]) for i in range(n))


def test_repeats_ids_null_and_repeated(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=250))
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (4, None, 4), (5, "é" * 50 + "ü" * 50, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.repeat_report(df).collect())
    assert got == [(-1, 0), (3, 250), (3, 250), (4, 0), (5, 0)]
    cut = {r.spans: r.text for r in suffix_dedup.cut_repeats(df).collect()}
    assert cut == {1: text, 2: "", 3: "", 4: None, 5: "é" * 50 + "ü" * 50}
    assert suffix_dedup.repeat_report(df.limit(0)).count() == 0


def test_covered_windows_of_a_hot_route_are_stretches(spark):
    """Of a passage in many documents of a task, each but the first is one row, not one a window."""
    text = "".join(random.Random(5).choices("abcdefghij", k=300))
    keyed = spark.createDataFrame([(i, text) for i in range(60)], "doc long, text string").coalesce(1)
    firsts = keyed.select(F.lit(5).cast("long").alias("route"), "doc", F.lit(0).cast("long").alias("start"), F.lit(201).cast("long").alias("windows"), F.lit(True).alias("hot"))
    placed = suffix_dedup.with_bytes(firsts, keyed)
    assert placed.count() == 201 + 59
    spans = suffix_dedup.indexed_spans(placed).collect()
    assert sorted((r["doc"], r["start"], r["end"]) for r in spans) == [(i, 0, 300) for i in range(1, 60)]
