"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Encoding. The encoding of a prefix ends in exactly one token that (a) is a suffix of
the prefix and (b) may stand next to the last token of what lies before it. So the
last tokens of all prefixes follow from one another, left to right, from suffix
matches of an automaton. A token is emitted once every way the text may go on runs
through it, that is, when the paths back from all live positions have met. How far
behind the end they must have met is a property of the merge list, its sufficient
lookahead, which is computed from the list; it bounds what is kept.

Words (a text cut before single spaces) that were encoded before come from a bounded
memory of finished transductions.

Decoding. Token bytes go through an incremental UTF-8 machine that holds back at most
three bytes; bytes that are no UTF-8 become U+FFFD.

Defined cases: null is the empty text, with no tokens; a special string inside a text
is its special token; result columns replace input columns of the same name; an empty
table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import boxed, importable_on_workers, text_of, unboxed
from zephyria.llm.tokenizers_local import PATTERN, byte_level_file

#: Finished words that each of two generations of a memory holds.
REMEMBERED = 200_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
#: Token pairs in one generation of those whose neighbourhood is known.
PAIRS = 1 << 18
#: Characters that are fed to the transducer at a time.
FEED_CHARS = 1 << 14

_WORDS = regex.compile(PATTERN)
_RUNS = {k: regex.compile(p) for k, p in {"L": r"\p{L}*+", "N": r"\p{N}*+", "O": r"[^\s\p{L}\p{N}]*+", "S": r"\s*+"}.items()}
_CLASSES = (("S", regex.compile(r"\s")), ("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")))
_GAP = regex.compile(r"(?<=\S) (?=\S)")


class MergeList:
    """The merges of a byte-level file, as ids, with what the transducer needs of them."""

    def __init__(self, path: str):
        spec = byte_level_file(path)
        if not spec.regular:
            raise ValueError("this is no plain byte-level BPE file")
        self.specials = spec.specials
        ids = spec.ranks
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        self.left, self.right = [-1] * len(self.bytes_of), [-1] * len(self.bytes_of)
        self.merged: dict[int, int] = {}
        for a, b in spec.merges:
            x, y, xy = ids[a], ids[b], ids[a + b]
            self.left[xy], self.right[xy] = x, y
            self.merged[x << 20 | y] = xy
        self.longest = max(map(len, ids))
        self.suffixes = ahocorasick.Automaton()
        for token, i in ids.items():
            self.suffixes.add_word(token.decode("latin-1"), (len(token), i))
        self.suffixes.make_automaton()
        self.neighbours: dict[int, bool] = {}
        self.older_neighbours: dict[int, bool] = {}
        #: tokens that are the encoding of their own bytes
        self.whole = [x < 0 or self.may_follow(x, y, joined=True) for x, y in zip(self.left, self.right)]

    def follows(self, key: int, a: int, b: int) -> bool:
        """``may_follow``, remembered in two generations of at most ``PAIRS`` pairs."""
        fits = self.older_neighbours.get(key)
        if fits is None:
            fits = self.may_follow(a, b)
        if len(self.neighbours) >= PAIRS:
            self.older_neighbours = dict(self.neighbours)
            self.neighbours.clear()  # in place: streams hold on to it
        self.neighbours[key] = fits
        return fits

    def may_follow(self, a: int, b: int, joined: bool = False) -> bool:
        """Whether the bytes of ``a`` and ``b``, merged in order of rank, stay these two.

        Undoes merges from the last backwards: the pair at the border must at no
        time have been due before the merge that came next on either side. ``joined``:
        whether they come to be these two, be it that they then merge.
        """
        left, right, merged = self.left, self.right, self.merged
        limit, ties = 1 << 30, False
        while True:
            m = None if joined else merged.get(a << 20 | b)
            joined = False
            if m is not None and (m < limit or ties and m == limit):
                return False
            ra, rb = (a if left[a] >= 0 else -1), (b if left[b] >= 0 else -1)
            if ra == rb:
                if ra < 0:
                    return True
                limit, ties, a, b = ra, False, right[a], left[b]
            elif ra > rb:
                limit, ties, a = ra, False, right[a]
            else:  # of equal merges the left one comes first
                limit, ties, b = rb, True, left[b]

    @property
    def lookahead(self) -> int:
        """Bytes that suffice to make a token stable.

        An unknown continuation reaches left only token by token: at rank r, through
        merge (x, y), to an x whose right neighbour y begins with a token already
        reached at a lower rank. The longest such chain, in bytes, is the bound.
        """
        reach = [0] * len(self.bytes_of)
        for xy in range(len(self.left)):
            x, y = self.left[xy], self.right[xy]
            if x < 0:
                continue
            best = reach[y]
            while self.left[y] >= 0:
                y = self.left[y]
                best = max(best, reach[y])
            reach[x] = max(reach[x], len(self.bytes_of[x]) + best)
        return max(reach) + self.longest


class WordStream:
    """Transducer for one pre-token, fed byte by byte in pieces of any size."""

    def __init__(self, merges: MergeList, lookahead: int):
        self.merges, self.keep = merges, 2 * lookahead
        self.reset()

    def reset(self) -> None:
        self.last: list[int] = [-1]  # last token of each prefix, from the last emitted border on
        self.search = None

    def feed(self, data: str) -> list[int]:
        """Take bytes (as Latin-1 text); returns tokens that became stable."""
        merges, last = self.merges, self.last
        neighbours, follows = merges.neighbours, merges.follows
        out: list[int] = []
        start = len(last)
        if self.search is None:
            self.search, fed = merges.suffixes.iter(data), 0
        else:
            self.search.set(data)
            fed = self.fed
        shift = start - fed
        at = -1
        for end, (size, token) in self.search:
            i = end + shift
            if i == at:
                continue
            j = i - size
            if j < 0:
                continue
            before = last[j]
            if before < 0:
                if merges.whole[token]:
                    last.append(token)
                    at = i
                continue
            key = before << 20 | token
            fits = neighbours.get(key)
            if fits is None:
                fits = follows(key, before, token)
            if fits:
                last.append(token)
                at = i
        self.fed = fed + len(data)
        if len(last) > self.keep:
            out = self.stable()
        return out

    def stable(self) -> list[int]:
        """Emit what all live paths share, and forget it."""
        size_of, last = self.merges.bytes_of, self.last
        end = len(last) - 1
        live = [-p for p in range(max(0, end - self.merges.longest + 1), end + 1)]
        heapify(live)
        while len(live) > 1:
            p = -heappop(live)
            while live and -live[0] == p:
                heappop(live)
            if not live:
                live = [-p]
                break
            heappush(live, -(p - len(size_of[last[p]]) if p else 0))
        border = -live[0]
        out = self.path(border)
        if border:
            self.last = last[border:]
        return out

    def path(self, end: int) -> list[int]:
        tokens = []
        while end > 0:
            tokens.append(self.last[end])
            end -= len(self.merges.bytes_of[self.last[end]])
        return tokens[::-1]

    def finish(self) -> list[int]:
        out = self.path(len(self.last) - 1)
        self.reset()
        return out


class TextStream:
    """Transducer for a text that comes in chunks: pre-tokens, each fed to a WordStream.

    A match of the split pattern is final once the text goes on for a few characters
    after it; a run of one class that is longer than a chunk is fed on as it comes.
    """

    def __init__(self, merges: MergeList, lookahead: int):
        self.merges, self.word = merges, WordStream(merges, lookahead)
        self.hold = max([3, *(len(s) + 1 for s in merges.specials)])
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
        self.tail, self.run = "", ""

    def feed(self, chunk: str, final: bool = False) -> list[int]:
        """Tokens that are certain after ``chunk``."""
        out: list[int] = []
        text, self.tail = self.tail + chunk, ""
        while self.special and (m := self.special.search(text)):
            out += self._section(text[: m.start()], True)
            out.append(self.merges.specials[m.group()])
            text = text[m.end() :]
        return out + self._section(text, final)

    def _section(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        at, sure = 0, len(text) if final else max(0, len(text) - self.hold)
        if self.run:
            end = _RUNS[self.run].match(text).end()
            if end > sure or end == len(text) and not final:
                out += self._give(text[:sure])
                self.tail = text[sure:]
                return out
            at = max(0, end - 1) if self.run == "S" and end < len(text) else end
            out += self._give(text[:at]) + self.word.finish()
            self.run = ""
        for m in _WORDS.finditer(text, at):
            if m.end() > sure or m.end() == len(text) and not final:
                break
            out += self._give(m.group()) + self.word.finish()
            at = m.end()
        rest = text[at:]
        if len(rest) > FEED_CHARS and not final:
            last = rest[0] if rest[0] != " " or rest[1].isspace() else rest[1]
            self.run = next((k for k, p in _CLASSES if p.match(last)), "O")
            out += self._give(rest[: -self.hold])
            rest = rest[-self.hold :]
        self.tail = rest
        return out

    def _give(self, text: str) -> list[int]:
        return self.word.feed(text.encode().decode("latin-1")) if text else []

    def finish(self) -> list[int]:
        out = self.feed("", final=True)
        out += self.word.finish()
        self.run = ""
        return out


class Memory:
    """The last finished transductions, in two generations of bounded size."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Texts to ids: remembered words first, the transducer for all else."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.lookahead = self.merges.lookahead
        self.word = WordStream(self.merges, self.lookahead)
        self.words, self.parts = Memory(), Memory()

    def stream(self, text: str) -> bytes:
        """Ids (little-endian, 4 bytes each) by the transducer, fed in chunks."""
        machine, out = TextStream(self.merges, self.lookahead), []
        for at in range(0, len(text), FEED_CHARS):
            out.append(np.array(machine.feed(text[at : at + FEED_CHARS]), "<u4").tobytes())
        out.append(np.array(machine.finish(), "<u4").tobytes())
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.word.feed(part.encode().decode("latin-1")) + self.word.finish()
        found = struct.pack(f"<{len(ids)}I", *ids)
        self.parts.put(part, found)
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a text without inner boundaries."""
        found = self.words.get(word)
        if found is None:
            if len(word) > REMEMBERED_CHARS:
                return self.stream(word)
            known = self.parts.get
            found = b"".join([known(p) or self._part(p) for p in _WORDS.findall(word)])
            self.words.put(word, found)
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.merges.specials):
            return self.stream(text)
        # a text without uneven spaces is cut fast; remembered words are even
        words, even = text.split(" "), lambda w: w and not w[0].isspace() and not w[-1].isspace()
        young, out = self.words.young, []
        for i, word in enumerate(words):
            word = " " + word if i else word
            ids = young.get(word)
            if ids is None:
                if not even(words[i]):
                    return self._uneven(text)
                ids = self._word(word)
                young = self.words.young
            out.append(ids)
        return b"".join(out)

    def _uneven(self, text: str) -> bytes:
        first, *others = _GAP.split(text)
        return b"".join([self._word(first), *[self._word(" " + w) for w in others]])


class Decoder:
    """Ids to text: token bytes through an incremental UTF-8 machine."""

    def __init__(self, path: str):
        spec = byte_level_file(path)
        self.bytes_of = {i: t for t, i in spec.ranks.items()} | {i: t.encode() for t, i in spec.specials.items()}
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """The text in parts, as ids come in."""
        values = np.frombuffer(ids, "<u4")
        self.machine.reset()
        for at in range(0, len(values), step):
            yield self.feed(values[at : at + step].tolist())
        yield self.feed([], final=True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with token_ids: the ids of each text, as an array."""
    importable_on_workers(docs.sparkSession)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = encoder(path)
        for texts in batches:
            yield pa.array([np.frombuffer(machine.encode(t), "<u4").astype(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    rows = boxed(docs, text=text_of())
    return unboxed(rows.select("row", F.arrow_udf(ids, "array<long>")("text").alias("ids")), docs.columns, token_ids=F.col("ids"))


def decode_ids(docs: DataFrame, path: str, column: str = "token_ids") -> DataFrame:
    """``docs`` with decoded: the text of an array of ids; null ids have no text."""
    importable_on_workers(docs.sparkSession)

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = decoder(path)
        for rows in batches:
            yield pa.array(["".join(machine.decode(np.array(r or [], "<u4").tobytes())) for r in rows.to_pylist()], pa.string())

    rows = boxed(docs, ids=F.col(f"`{column}`"))
    return unboxed(rows.select("row", F.arrow_udf(texts, "string")("ids").alias("text")), docs.columns, decoded=F.col("text"))


DIGESTS = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding back."""
    importable_on_workers(docs.sparkSession)

    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, back = encoder(path), decoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids, decoded = coder.encode(text.as_py()), hashlib.sha256()
                for part in back.decode(ids):
                    decoded.update(part.encode())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*rows) if rows else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = boxed(docs, text=text_of())
    coded = rows.select("row", F.arrow_udf(digests, DIGESTS)("text").alias("code"))
    return unboxed(coded, docs.columns, **{c: F.col("code").getField(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")})
