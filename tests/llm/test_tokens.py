import random

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyria.llm import bpe_stream, packing, token_count, tokenizers_local

PIECES = ["a", "aa", "b", "th", "e", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "'", "1", "22", "!!", "<|endoftext|>", "<|end", "é", "漢字", "😀", " ", " ", "tion", "ab", "ba", "%%%", "|", "."]


@pytest.fixture(scope="module")
def coder():
    return bpe_stream.Encoder(plain.PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def in_chunks(coder, text, sizes):
    machine, out, at = bpe_stream.TextStream(coder.merges, coder.lookahead), [], 0
    for n in sizes:
        out += machine.feed(text[at : at + n])
        at += n
    return out + machine.feed(text[at:]) + machine.finish()


LIBRARY = plain.library()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.lists(st.integers(1, 5), max_size=60))
def test_encoding_is_the_library_s(coder_text, sizes):
    coder, text = _coder(), "".join(coder_text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(coder.encode(text)) == ids_of(coder.stream(text)) == want
    assert in_chunks(coder, text, sizes) == want
    assert tokenizers_local.id_encoder(plain.PATH)(text).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip_of_any_text(text):
    coder = _coder()
    got = coder.encode(text)
    assert ids_of(got) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert "".join(bpe_stream.decoder(plain.PATH).decode(got)) == text


def _coder():
    return bpe_stream.encoder(plain.PATH)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, " " * 40_000 + "x", "!" * 40_000, "".join(random.Random(1).choices("abcdefgh", k=60_000))])
def test_long_runs_need_bounded_memory(coder, text):
    machine, out, most = bpe_stream.TextStream(coder.merges, coder.lookahead), [], 0
    for at in range(0, len(text), 500):
        out += machine.feed(text[at : at + 500])
        most = max(most, len(machine.word.last), len(machine.tail))
    assert out + machine.finish() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert most <= 2 * coder.lookahead + 2 * bpe_stream.FEED_CHARS


def test_decoding_of_any_ids():
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        got = "".join(bpe_stream.decoder(plain.PATH).decode(np.array(ids, "<u4").tobytes(), step=rng.randint(1, 4)))
        assert got == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, None), (2, "", "z")], "doc_id long, text string, n_tokens string")
    coded = bpe_stream.encode_texts(df, plain.PATH)
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    back = bpe_stream.decode_ids(coded, plain.PATH).collect()
    assert sorted((r.text or "", r.decoded) for r in back) == [("", ""), ("", ""), ("a b", "a b"), ("a b", "a b")]
    assert bpe_stream.round_trip_digests(df.limit(0), plain.PATH).count() == 0
    assert sorted(r.n_tokens for r in bpe_stream.round_trip_digests(df, plain.PATH).collect()) == [0, 0, 2, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_each_library(spark, name):
    path = public_tokenizers.path(name)
    rng = random.Random(5)
    texts = ["", None, "Hello there", " two  spaces ", "<|endoftext|> inside", "x" * 3000, " ".join("".join(rng.choices("abcdé,.", k=rng.randint(1, 9))) for _ in range(30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(df, path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        want = {i: len(own.encode(t or "")) for i, t in enumerate(texts)}
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got == want


def test_count_columns(spark):
    df = spark.createDataFrame([(1, "é b", 9)], "doc_id long, text string, row long")
    row = token_count.token_counts(df, plain.PATH, limit=1).collect()[0]
    assert (row["row"], row.n_bytes, row.over_limit) == (9, 4, True)
    assert token_count.token_counts(df.limit(0), plain.PATH).count() == 0


# ---------------------------------------------------------------- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_best_fit(lengths):
    from functools import lru_cache

    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def fewest(i, rooms):
        if i == len(lengths):
            return 0
        best = 1 + fewest(i + 1, tuple(sorted([*rooms, 20 - lengths[i]])))
        for k, r in enumerate(rooms):
            if r >= lengths[i]:
                best = min(best, fewest(i + 1, tuple(sorted([*rooms[:k], r - lengths[i], *rooms[k + 1 :]]))))
        return best

    sizes = np.array(lengths)
    bins, offsets, count = packing.best_fit_decreasing(sizes, 20)
    assert packing.bin_bound(sizes, 20) <= fewest(0, ()) <= count
    for b in range(count):
        mine = sorted(zip(offsets[bins == b], sizes[bins == b]))
        assert all(x[0] + x[1] == y[0] for x, y in zip(mine, mine[1:])) and mine[0][0] == 0 and sum(mine[-1]) <= 20


@pytest.mark.parametrize("part_pieces", [100_000, 40])
def test_pieces_and_places(spark, part_pieces):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abc de,", k=rng.randint(0, 400)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 700), (503, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, key string")
    out = packing.pack_documents(df, plain.PATH, seq_len=256, with_ids=True, part_pieces=part_pieces).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == plain.pieces(rows, 256)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= 256
    waste = 1.05 if part_pieces > 1000 else 1.2  # a partition of few pieces packs less well
    assert len(sequences) <= waste * sum(r.length for r in out) / 256 + 2


def test_packing_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    out = packing.pack_documents(df, plain.PATH).collect()
    assert len(out) == 5 and len({(r.sequence_id, r.offset) for r in out}) == 5
    assert packing.pack_documents(df.limit(0), plain.PATH).count() == 0


def test_known_pairs_stay_within_their_bound(monkeypatch):
    monkeypatch.setattr(bpe_stream, "PAIRS", 40)
    encoder, own = bpe_stream.Encoder(plain.PATH), plain.library()
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé ", k=300))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == own.encode(text, add_special_tokens=False).ids
        assert len(encoder.merges.neighbours) <= 40 and len(encoder.merges.older_neighbours) <= 40
