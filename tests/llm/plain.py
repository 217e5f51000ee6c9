"""Plain single-process versions that results are held against."""

import hashlib
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHITE = re.compile(r"[\x20\x09-\x0D]+")


def library():
    return Tokenizer.from_file(PATH)


def digest(text):
    return hashlib.sha256(WHITE.sub(" ", text or "").encode()).hexdigest()


def exact(rows):
    """{doc_id: (keep_id, size, digest)} for rows with unique ids."""
    groups = {}
    for d, t in rows:
        groups.setdefault(digest(t), []).append(d)
    return {d: (min(g), len(g), h) for h, g in groups.items() for d in g}


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(rows):
    """{doc_id: (number of shingles, least linked id)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(rows, width=100):
    """{doc_id: (bytes, covered flags)} by a set of all windows so far."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                covered[i : i + width] = b"\1" * width
            seen.add(w)
        out[d] = data, covered
    return out


def cut(data, covered):
    return bytes(x for x, c in zip(data, covered) if not c)


def pieces(rows, limit=2048):
    """{(doc_id, piece): (start, length, crc32)} by the tokenizer's own library."""
    tokenizer, out = library(), {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at, n = 0, len(ids) % limit or min(len(ids), limit)
        for k in range(-(-len(ids) // limit)):
            part = ids[at : at + n]
            out[d, k] = at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at, n = at + n, limit
    return out


def words_in_repeats(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def base_counts(text):
    text = text or ""
    words = [w for w in WHITE.split(text) if w]
    lines = [x for x in text.split("\n") if WHITE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), words_in_repeats(words)
