"""Alignment of two tokenizers: which tokens cover the same bytes, and how often.

Both tokenizers cut one byte string, so a batch of texts is one line of bytes with
two sequences of token ends. Every token points to the token of the other side that
overlaps it and reaches farthest right; a token that ends where its partner ends is
the end of its chain (of the two, the second tokenizer's). Successors are doubled,
``next = next[next]``, for all tokens at once until nothing changes: then each token
holds the terminal token of its group, and equal labels are one group.

Stretches between neighbouring ends of either side are the links: each lies in one
token of either side, and two tokens overlap in one stretch. Links of a document are
kept as distinct id pairs with counts. Pair counts of the corpus are partial sums,
merged by pair. To bring them back, the most frequent pairs (at most ``HOT_PAIRS``,
broadcast) are looked up where the links are; only the others are shuffled, none of
which can have more links than the least of those.

Defined cases: a null or empty text, or one that either tokenizer does not give back
byte for byte, has no tokens (zeros, and '' as groups); special strings in a text are
plain text; rows with equal ids stay apart; other columns are not read; an empty
table gives no rows. A batch holds ``BATCH_BYTES`` of text or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import importable_on_workers, stored, text_of
from zephyria.llm.token_count import balanced
from zephyria.llm.tokenizers_local import byte_letters, plain_encoder

#: Bytes of text that are aligned at a time.
BATCH_BYTES = 1 << 19
#: So many of the most frequent id pairs are broadcast (17 bytes each) at most.
HOT_PAIRS = 1 << 16
#: A pair of ids is one number: the first id times this, plus the second.
SPAN = 1 << 32


@dataclass
class Spelling:
    """The bytes of every token of a side, one after another."""

    line: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, table: list[bytes]) -> Spelling:
        length = np.array([len(x) for x in table], np.int64)
        return cls(np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length, length)

    def __len__(self) -> int:
        return len(self.length)

    def spelled(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, which end at ``ends``."""
        length = self.length[ids]
        return self.line[np.repeat(self.start[ids] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=4)
def json_side(path: str):
    """(texts to ids, bytes of each token) of a byte-level ``.json`` file; a space goes before each text."""
    from tokenizers import Tokenizer

    own, letters = Tokenizer.from_file(path), byte_letters()
    vocab = own.get_vocab(with_added_tokens=True)
    size = max(vocab.values()) + 1
    table: list[bytes] = [b""] * size
    for token, i in vocab.items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    encode = plain_encoder(path)
    return lambda texts: [encode(" " + t) for t in texts], Spelling.of(table)


@lru_cache(maxsize=4)
def piece_side(path: str):
    """(texts to ids, bytes of each token) of a sentencepiece ``.model`` file, which adds the space itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: [np.asarray(x, np.int64) for x in pieces.encode(texts, num_threads=1)], Spelling.of(table)


def ends_before(ends: np.ndarray, size: int) -> np.ndarray:
    """How many of the rising ``ends`` are below each byte place up to ``size``: the token that ends there or holds it."""
    ending = np.zeros(size + 1, np.int64)
    ending[ends] = 1
    return np.cumsum(ending) - ending


def terminals(a_end: np.ndarray, b_end: np.ndarray, a_before: np.ndarray, b_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group label of every token of either side: the second side's token that ends its group.

    The ends rise and both sides end at the same byte; ``a_before`` and ``b_before`` are their ``ends_before``.
    """
    n = len(a_end)
    own = np.arange(len(b_end))
    to_b = b_before[a_end]  # holds the last byte of the first side's token
    to_a = a_before[b_end]
    ahead = np.where(a_end[to_a] > b_end, to_a, n + own) if n else own
    successor = np.concatenate([n + to_b, ahead])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n
        successor = further


@dataclass
class Labels:
    """Decimal ids with the separator that follows them, padded to one width."""

    table: np.ndarray
    size_a: int

    SEPARATORS = (",", "|", ";", "")

    @classmethod
    def of(cls, size_a: int, size_b: int) -> Labels:
        text = [f"{i}{s}" for size in (size_a, size_b) for i in range(size) for s in cls.SEPARATORS]
        return cls(np.array(text, "S"), size_a)

    def text(self, codes: np.ndarray) -> bytes:
        return self.table[codes].tobytes().translate(None, b"\0")


def sound(texts: list[str], sides: list[tuple[list[np.ndarray], Spelling]]) -> np.ndarray:
    """Whether every side's tokens of a text spell a space and the text; an empty text has none."""
    wholes = [(" " + t).encode() if t else b"" for t in texts]
    size = np.array([len(w) for w in wholes], np.int64)
    kept = size > 0
    for ids, spelling in sides:
        first = np.cumsum([0, *map(len, ids)])
        until = np.concatenate([[0], np.cumsum(spelling.length[np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)])])[first]
        kept &= np.diff(until) == size
    at = np.flatnonzero(kept)
    line = np.frombuffer(b"".join(wholes[i] for i in at.tolist()), np.uint8)
    owner_end = np.cumsum(size[at])
    for ids, spelling in sides:
        tokens = np.concatenate([*(ids[i] for i in at.tolist()), np.zeros(0, np.int64)]).astype(np.int64)
        off = np.flatnonzero(spelling.spelled(tokens, np.cumsum(spelling.length[tokens])) != line)
        kept[at[np.searchsorted(owner_end, off, "right")]] = False
    return kept


def aligned(texts: list[str], side_a, side_b, labels: Labels) -> dict[str, list]:
    """Columns of the report and the distinct linked pairs of each text, with their counts."""
    (encode_a, bytes_a), (encode_b, bytes_b) = side_a, side_b
    ids_a, ids_b = encode_a(texts), encode_b(texts)
    zero = np.zeros(0, np.int64)
    kept = sound(texts, [(ids_a, bytes_a), (ids_b, bytes_b)]).tolist()
    ids_a, ids_b = ([x if k else zero for k, x in zip(kept, ids)] for ids in (ids_a, ids_b))
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([*ids, zero]).astype(np.int64) for ids in (ids_a, ids_b))
    a_end, b_end = np.cumsum(bytes_a.length[a]), np.cumsum(bytes_b.length[b])
    size = int(b_end[-1]) if len(b) else 0
    a_before, b_before = ends_before(a_end, size), ends_before(b_end, size)
    label_a, label_b = terminals(a_end, b_end, a_before, b_before)

    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    last_b = label_b == np.arange(len(b))  # ends a group
    n_groups = np.bincount(doc_b[last_b], minlength=len(texts))

    # groups as text: first side's ids of a group, then the second side's
    number = np.cumsum(last_b) - 1
    group_a, group_b = number[label_a], number[label_b]
    groups = int(last_b.sum())
    in_b = np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(np.bincount(group_a, minlength=groups))[group_b]
    codes = np.zeros(len(a) + len(b), np.int64)
    ends_a = np.append(group_a[1:] != group_a[:-1], True) if len(a) else np.zeros(0, bool)
    final = np.zeros(len(b), bool)
    final[(first_b[1:] - 1)[n_b > 0]] = True
    codes[place_a] = 4 * a + ends_a
    codes[place_b] = 4 * (labels.size_a + b) + np.where(final, 3, np.where(last_b, 2, 0))
    cut = (first_a + first_b).tolist()
    digests = [hashlib.sha256(labels.text(codes[x:y])).hexdigest() if y > x else "" for x, y in zip(cut, cut[1:])]

    # a link is the stretch up to an end of either side; one number holds its text and its pair, so that a plain sort will do
    ending = np.zeros(size + 1, bool)
    ending[a_end] = ending[b_end] = True
    ends = np.flatnonzero(ending)
    at_a, at_b = a_before[ends], b_before[ends]
    doc, pairs = doc_a[at_a], len(bytes_a) * len(bytes_b)
    link = np.sort((doc * len(bytes_a) + a[at_a]) * len(bytes_b) + b[at_b])
    new = np.ones(len(link), bool)
    new[1:] = link[1:] != link[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(link)))
    starts = np.searchsorted(link[at], np.arange(len(texts) + 1) * pairs)
    first, second = np.divmod(link[at] - np.repeat(np.arange(len(texts)) * pairs, np.diff(starts)), len(bytes_b))
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": np.bincount(doc, minlength=len(texts)),
        "groups_sha256": digests,
        "pairs": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(first * SPAN + second, pa.int64())),
        "times": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(times, pa.int32())),
    }


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; stored."""
    importable_on_workers(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = json_side(json_path), piece_side(model_path)
        labels = Labels.of(len(side_a[1]), len(side_b[1]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for x, y in balanced(texts, BATCH_BYTES):
                yield pa.RecordBatch.from_pydict({"doc_id": ids[x:y]} | aligned(texts[x:y], side_a, side_b, labels))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(align, ALIGNED)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair in the corpus, and whether its second id has no pair with more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            distinct, back = np.unique(pairs, return_inverse=True)
            n = np.bincount(back, times, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"pair": distinct, "n": n})

    counts = found.select("pairs", "times").mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair") % SPAN), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_alignment(docs: DataFrame, json_path: str, model_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Tokens, groups, links and corpus-wide link counts of every row of ``docs``."""
    spark = docs.sparkSession
    found = alignments(docs, json_path, model_path)
    counts = stored(pair_counts(found), "pair-table")
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow().sort_by("pair")  # at most hot_pairs rows
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the hot pairs of each row, and a row for each other pair."""
        pair_of, n_of, best_of = known.value
        for batch in batches:
            rows, lists = batch.column(0).to_numpy(), batch.column(1)
            pairs, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            at = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(pair_of, pairs), max(len(pair_of) - 1, 0))
            is_hot = pair_of[place] == pairs if len(pair_of) else np.zeros(len(pairs), bool)
            place, weight, owner = place[is_hot], times[is_hot], at[is_hot]
            sums = np.zeros((2, len(rows)), np.int64)
            np.add.at(sums[0], owner, weight * n_of[place])
            np.add.at(sums[1], owner, weight * best_of[place])
            none = np.zeros(int((~is_hot).sum()), np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": np.concatenate([rows, rows[at[~is_hot]]]),
                    "pair": pa.array(np.concatenate([np.zeros(len(rows), np.int64), pairs[~is_hot]]), mask=np.arange(len(rows) + len(none)) < len(rows)),
                    "times": np.concatenate([np.zeros(len(rows), np.int64), times[~is_hot]]),
                    "count_sum": np.concatenate([sums[0], none]),
                    "n_best": np.concatenate([sums[1], none]),
                }
            )

    schema = "row long, pair long, times long, count_sum long, n_best long"
    split = stored(found.select("row", "pairs", "times").mapInArrow(looked_up, schema), "looked-up")
    rare = split.where("pair is not null").select("row", "pair", "times").join(counts, "pair")
    weighted = rare.select("row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    sums = (
        split.where("pair is null").select("row", "count_sum", "n_best").unionByName(weighted)
        .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    )
    report = found.drop("pairs", "times").join(sums, "row")
    return report.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
