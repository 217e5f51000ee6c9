"""Tokenizer files as fast, exact encoders inside tasks.

A byte-level BPE file without normaliser whose token ids follow the order of its
merges can be run by tiktoken: same pattern, same merges, same ids, several times the
speed of the library that the file is written for. Anything else is left to its own
library. No file is copied; the path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex

#: The split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are cut at safe boundaries into parts of about this many characters.
PART_CHARS = 1 << 16
#: A part that has no boundary for this long goes to the file's own library.
LONGEST_RUN = 1 << 18

_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and its byte.

    Printable bytes stand for themselves; the others take code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return letters


class ByteLevelFile:
    """Vocabulary, merge order and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.specials}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        pre, plain = spec["pre_tokenizer"] or {}, ("normalizer", "post_processor", "truncation", "padding")
        merged = [self.ranks.get(a + b) for a, b in self.merges]
        self.regular = (
            model["type"] == "BPE"
            and not any(spec.get(k) for k in plain)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and all(len(a) == 1 for a in sorted(self.ranks, key=self.ranks.get)[:256])
            and merged == list(range(256, 256 + len(merged)))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )


@lru_cache(maxsize=4)
def byte_level_file(path: str) -> ByteLevelFile:
    return ByteLevelFile(path)


def safe_parts(text: str, size: int = PART_CHARS, drop_space: bool = False) -> list[str]:
    """``text`` cut before single spaces between non-spaces, about every ``size`` characters.

    Byte-level BPE always begins a token at such a space. Tokenizers that put the
    space into the next word themselves need it dropped.
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end() if drop_space else cut.start()
    parts.append(text[start:])
    return parts


def id_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to token ids (uint32), as the library of a ``.json`` file gives them."""
    from tokenizers import Tokenizer

    spec = byte_level_file(path)
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def by_library(text: str) -> np.ndarray:
        return np.asarray(own.encode(text, add_special_tokens=False).ids, np.uint32)

    if not spec.regular:
        return by_library
    import tiktoken

    core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=spec.ranks, special_tokens=spec.specials)
    special = set(spec.specials)

    def encode(text: str) -> np.ndarray:
        parts = safe_parts(text) if len(text) > PART_CHARS else [text]
        ids = [by_library(p) if len(p) > LONGEST_RUN else core.encode_to_numpy(p, allowed_special=special) for p in parts]
        return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype(np.uint32, copy=False)

    return encode


def plain_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to token ids as ``id_encoder`` gives them, but with special strings as plain text."""
    from tokenizers import Tokenizer

    spec = byte_level_file(path)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()

    def by_library(text: str) -> np.ndarray:
        return np.asarray(own.encode(text, add_special_tokens=False).ids, np.uint32)

    if not spec.regular:
        return by_library
    import tiktoken

    core = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=spec.ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts = safe_parts(text) if len(text) > PART_CHARS else [text]
        ids = [by_library(p) if len(p) > LONGEST_RUN else core.encode_to_numpy(p, disallowed_special=()) for p in parts]
        return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype(np.uint32, copy=False)

    return encode


def part_counter(path: str) -> Callable[[Sequence[str]], list[int]]:
    """Parts of texts to their numbers of tokens, by the library of the file."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda parts: [len(x) for x in pieces.encode(list(parts), num_threads=1)]
    with open(path, encoding="utf-8") as f:
        regular = (json.load(f).get("pre_tokenizer") or {}).get("type") == "ByteLevel"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    if regular and byte_level_file(path).regular:
        import tiktoken

        spec = byte_level_file(path)
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=spec.ranks, special_tokens=spec.specials)
        special = set(spec.specials)

        def lengths(parts: Sequence[str]) -> list[int]:
            # one call for the batch; runs without a boundary, which cost that coder their square, by the library
            even = [p for p in parts if len(p) <= LONGEST_RUN]
            found = iter(core.encode_batch(even, num_threads=1, allowed_special=special))
            return [len(next(found)) if len(p) <= LONGEST_RUN else len(own.encode(p, add_special_tokens=False).ids) for p in parts]

        return lengths
    return lambda parts: [len(x) for x in own.encode_batch_fast(list(parts), add_special_tokens=False)]
