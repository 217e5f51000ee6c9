"""Token counts: lengths only, from batches balanced by bytes.

Each Arrow batch is cut into parts (long texts at boundaries where every tokenizer
begins a word anyway) and the parts into batches of about equal bytes; the tokenizer
returns nothing but lengths, which are summed by text.

Defined cases: null text is the empty text, with no tokens; special strings inside a
text count as the file's library has them by default; result columns replace input
columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.common import boxed, importable_on_workers, text_of, unboxed
from zephyria.llm.tokenizers_local import part_counter, safe_parts

TOKEN_LIMIT = 512
#: Bytes that one call of the tokenizer gets.
BATCH_BYTES = 1 << 20


def balanced(parts: list[str], size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive parts of about ``size`` bytes."""
    start = held = 0
    for i, part in enumerate(parts):
        held += len(part.encode())
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(parts):
        yield start, len(parts)


def text_lengths(texts: list[str], count, drop_space: bool) -> np.ndarray:
    """Tokens of each text."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = safe_parts(text, drop_space=drop_space)
        parts += own
        owner += [i] * len(own)
    lengths = np.zeros(len(texts), np.int64)
    for a, b in balanced(parts):
        np.add.at(lengths, owner[a:b], count(parts[a:b]))
    return lengths


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    importable_on_workers(docs.sparkSession)

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # words of a byte-level file carry their space; other tokenizers add or drop it
        count, drop_space = part_counter(path), not keeps_spaces(path)
        for texts in batches:
            yield pa.array(text_lengths(texts.to_pylist(), count, drop_space), pa.int64())

    rows = boxed(docs, text=text_of())
    counted = rows.select("row", F.octet_length("text").cast("long").alias("n_bytes"), F.arrow_udf(lengths, "long")("text").alias("n_tokens"))
    return unboxed(counted, docs.columns, n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > limit)


def keeps_spaces(path: str) -> bool:
    """Whether tokens hold the space before a word as it stands in the text."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        return (json.load(f).get("pre_tokenizer") or {}).get("type") == "ByteLevel"
