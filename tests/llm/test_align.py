import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from zephyria.llm.token_align import cross_alignment, ends_before, json_side, piece_side, sound
from zephyria.llm.tokenizers_local import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces, letters = sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    docs = []
    for doc_id, text in rows:
        whole = (" " + text).encode() if text else b""
        enc = own.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in pieces.encode(text or ""):
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        if not whole or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc_id, 0, 0, "", []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        both, groups, start = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]}), [], 0
        for end in both:
            groups.append("|".join(",".join(str(s[2]) for s in side if start <= s[0] < end) for side in spans))
            start = end
        docs.append((doc_id, len(a), len(b), ";".join(groups), links))
    count = Counter(link for d in docs for link in d[4])
    most = {}
    for (_, q), n in count.items():
        most[q] = max(most.get(q, 0), n)
    return sorted(
        (d, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, n_a, n_b, g, links in docs
    )


TEXTS = ["", None, "a", " ", "\n\n", "Hello  world!", "naïve café – 100 %", "日本語のテキスト", "▁under", "a\x00b", "<s> </s> <|endoftext|>", "🙂🙃 ok", "  lead", "x" * 300, "\ttab\r\n"]


@pytest.mark.parametrize("hot_pairs", [0, 3, 1 << 16])
def test_alignment_equals_a_plain_one(spark, hot_pairs):
    rng = random.Random(4)
    words = "the quick brown-fox jumps_over 3.14 Überraschung d'accord état antidisestablishmentarianism ... ——".split()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, pair int, row int").repartition(4)
    got = sorted(map(tuple, cross_alignment(df, A, B, hot_pairs).collect()))
    assert got == plain_alignment(rows)


def test_alignment_of_long_and_no_texts(spark):
    schema = "doc_id long, text string"
    assert cross_alignment(spark.createDataFrame([], schema), A, B).count() == 0
    text = "word and wörd, 12345\n" * 100_000
    (row,) = cross_alignment(spark.createDataFrame([(1, text)], schema), A, B).collect()
    own = Tokenizer.from_file(A)
    assert row.n_a == len(own.encode(" " + text, add_special_tokens=False).ids)
    assert row.n_links == row.n_a + row.n_b - row.n_groups


def test_texts_are_held_against_their_tokens_all_at_once():
    """A text that one side spells in other bytes, or in fewer or more, is told among sound ones."""
    (encode_a, bytes_a), (encode_b, bytes_b) = json_side(A), piece_side(B)
    texts = ["one two", "", "same", "bytes", "longer text", *TEXTS[2:6]]
    ids_a, ids_b = encode_a(texts), encode_b(texts)
    plain = lambda ids, s: b"".join(bytes(s.line[s.start[i] : s.start[i] + s.length[i]]) for i in ids.tolist())
    ids_b[2], ids_b[3] = encode_b(["sane"])[0], ids_b[3][:-1]  # as many bytes, but others; and fewer
    want = [bool(t) and all(plain(x[i], s) == (" " + t).encode() for x, s in ((ids_a, bytes_a), (ids_b, bytes_b))) for i, t in enumerate(texts)]
    assert sound(texts, [(ids_a, bytes_a), (ids_b, bytes_b)]).tolist() == want
    assert want[0] and want[4] and not any(want[1:4])
    assert sound([], [([], bytes_a)]).tolist() == []
    ends = np.array([2, 3, 7])
    assert ends_before(ends, 7).tolist() == np.searchsorted(ends, np.arange(8), "left").tolist()
