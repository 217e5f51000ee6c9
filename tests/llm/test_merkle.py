import hashlib
import zlib

import pytest

from zephyria.llm.merkle import merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def climb(nodes):
    """Root of a list of digests and, for each, its levels of (before, after)."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, held = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in owner[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(h(*run))
            held.append(sum(owner[a : a + 3], []))
        nodes, owner = parents, held
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        seen = leaf(r, r[4].replace("\n", "")) if tampered else leaf(r, r[4])
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), seen))
    keys = sorted(groups, key=str.encode)
    trees = {k: climb([x[2] for x in sorted(groups[k])]) for k in keys}
    root, tops = climb([trees[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops):
        for (known, doc_id, first, seen), path in zip(sorted(groups[k]), trees[k][1]):
            cur = seen
            for before, after in path + top:
                cur = h(before, cur, after)
            proof = h(*[b + a for b, a in path + top])
            out.append((doc_id if known else None, first, trees[k][0], root, proof, cur, cur == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_a_plain_one(spark, levels):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "e": 10, "z": 28, None: 95, "": 5}
    rows, i = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            i += 1
            rows.append(((i * 7919) % 1009, source, None if i % 5 == 0 else "en", None if i % 7 == 0 else i, [None, "", "x\ny\n", "ü" * i, "plain"][i % 5]))
    rows += [(None, "b", None, None, None), (3, "z", "en", 1, "same\n"), (3, "z", "en", 1, "same\n"), (3, "z", "en", 1, "other")]
    rows.append((77, "long", "en", 1, "word\n" * 400_000))
    got = merkle_manifest(spark.createDataFrame(rows, DOCS).repartition(5), levels=levels).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables_and_clashing_columns(spark, n):
    rows = [(i, "s", "en", 1, "t\n", "key", 5) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS + ", key string, pos int")
    got = sorted(map(tuple, merkle_manifest(df).collect()), key=str)
    assert got == (plain_manifest([r[:5] for r in rows]) if n else [])


def test_many_groups_of_one_row(spark):
    rows = [(i, f"host{i}", "en", i, f"line {i}\n") for i in range(40)]
    got = merkle_manifest(spark.createDataFrame(rows, DOCS), levels=2).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
