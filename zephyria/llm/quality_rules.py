"""Quality rules: counts of the text, then compression bands.

A text's zstandard ratio (bytes before by bytes after) tells repetition (high) from
noise (low). It depends on length, so each band of lengths has its own limits; the
whole text and its fixed chunks are both held against them.

Defined cases: null text has no words; a text without words fails the base rules;
repeated rows each get the same result; result columns replace input columns of the
same name; an empty table gives no rows. Lone surrogates cannot occur in a Spark
string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import boxed, importable_on_workers, unboxed

LEVEL = 3
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
CHUNK_BYTES = 4096
#: A text is rejected when more than this share of its chunk bytes lies outside the band.
BAD_CHUNK_SHARE = 0.3
#: Upper end of the length in bytes, least ratio, greatest ratio.
BANDS = (
    (128, 0.0, 3.0),
    (256, 0.75, 2.4),
    (512, 0.9, 2.5),
    (1024, 1.1, 2.6),
    (2048, 1.25, 2.8),
    (4096, 1.35, 3.0),
    (8192, 1.45, 3.1),
    (16384, 1.5, 3.2),
    (65536, 1.55, 3.5),
    (float("inf"), 1.6, 4.0),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,zstd_ratio:double,bad_chunk_share:double>"


def in_band(n_bytes: int, ratio: float) -> bool:
    for end, least, most in BANDS:
        if n_bytes <= end:
            return least <= ratio <= most
    return False


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; the window is a power of two.

    Windows get exact ranks by pairing ranks of half windows, so nothing collides.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width, top = 1, len(seen)
    while width < window:
        pairs = rank[:-width] * top + rank[width:]
        values, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        top, width = len(values), 2 * width
        if top == len(pairs):
            return 0
    starts = counts[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:-window][starts] = 1
    edge[window:][starts] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def compression(data: bytes, zstd: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> tuple[float, float]:
    """Ratio of the whole text, and the share of bytes in chunks outside their band."""
    if not data:
        return 0.0, 0.0
    ratio = len(data) / len(zstd.compress(data))
    if len(data) <= chunk:
        return ratio, 0.0 if in_band(len(data), ratio) else 1.0
    bad = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        if not in_band(len(part), len(part) / len(zstd.compress(part))):
            bad += len(part)
    return ratio, bad / len(data)


def assess(text: str | None, zstd: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    ratio, share = compression(data, zstd)
    kept = not failed and in_band(len(data), ratio) and share <= BAD_CHUNK_SHARE
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, kept, ratio, share


def _assess_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    for texts in batches:
        rows = [assess(t.as_py(), zstd) for t in texts]
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(RESULTS))


RESULTS = (*COUNTS, "base_failed", "kept", "zstd_ratio", "bad_chunk_share")


def judged(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, beside its ``verdict``."""
    importable_on_workers(docs.sparkSession)
    return boxed(docs, verdict=F.arrow_udf(_assess_batches, VERDICT)(F.col("text")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, base_failed, kept and the two compression figures."""
    return unboxed(judged(docs), docs.columns, **{c: F.col("verdict").getField(c) for c in RESULTS})


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged."""
    return unboxed(judged(docs).where("verdict.kept"), docs.columns)
