"""Merkle manifest of a table: a leaf a row, a tree a group, a root over all groups.

Leaves get their places by one global sort of narrow rows (group, order, digest)
and running counts of its partitions. A tree is then climbed in blocks of
``FANOUT ** LEVELS`` leaves. Inside a block every node stands on the row of its
first leaf, so level ``l`` is a pair of lag and lead columns at the fixed offsets
``FANOUT ** l`` and twice that, masked by the node's slot and the length of its
run: they give each node its siblings, and rows of first children hash the parent.
Every level of a block shares one shuffle and one sort. The block digests are the
leaves of the next climb, until each group is one row; the groups' roots, in order
of group, are climbed the same way. On the way back each row takes the path of its
block, so a path is shuffled once a block, not once a leaf.

No window holds more than a block, whatever part of the rows one group has.

Defined cases: null columns hash as ``-``; a null group is a group of its own and
comes first; a null ``doc_id`` comes first in its group; rows with equal ids are
ordered by their digest; one leaf is its own subroot and one subroot the root, with
the digest of nothing as proof; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyria.llm.common import stored

#: Children of a node.
FANOUT = 3
#: Levels that one climb takes; its blocks have FANOUT ** LEVELS leaves.
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<before string, after string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or ``-``."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def is_tampered(doc_id: Column) -> Column:
    """Whether 2 divides the unsigned CRC-32 of the decimal id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """(key, doc_id, leaf, seen) of every row; ``seen`` is the digest after tampering.

    ``key`` orders groups as their values do bytewise, null first.
    """
    original = {c: F.col(f"`{c}`") for c in columns}
    changed = original | {"text": F.replace(original["text"], F.lit("\n"), F.lit(""))} if "text" in original else original
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaf = leaf_digest(list(original.values()))
    id_ = F.col(f"`{order}`")
    return docs.select(
        key.alias("key"),
        id_.alias("doc_id"),
        leaf.alias("leaf"),
        F.when(is_tampered(id_), leaf_digest(list(changed.values()))).otherwise(leaf).alias("seen"),
    )


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place within their ``key`` in that order, and ``n``, the rows of the key.

    A partition of the sorted table knows how many rows of a key the partitions
    before it hold, so no key has to fit a task.
    """
    at = stored(rows.orderBy("key", *order).withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    part = F.shiftright("at", 33)
    parts = at.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    group = Window.partitionBy("key")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "key",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(group).alias("n"),
    )
    found = at.withColumn("part", part).join(starts, ["key", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (key, pos, n, digest, ...) with block, path and top.

    ``path``: the siblings of the node's ancestors in its block. ``top``: the block's
    digest, on its first row only.
    """
    size = FANOUT**levels
    rows = nodes.withColumns({"block": F.expr(f"pos div {size}"), "node": F.col("digest")})
    block = Window.partitionBy("key", "block").orderBy("pos")
    steps = []
    for level in range(levels):
        step = FANOUT**level
        count = F.expr(f"(n + {step - 1}) div {step}")  # nodes of this level
        place = F.expr(f"pos div {step}")
        slot = place % FANOUT
        run = F.least(F.lit(FANOUT), count - (place - slot))
        is_node = (F.col("pos") % step == 0) & F.col("node").isNotNull() & (count > 1)

        def beside(offset: int, slot=slot, run=run, step=step) -> Column:
            """The digest of the sibling ``offset`` slots away; nothing outside the run."""
            moved = F.lead("node", offset * step) if offset > 0 else F.lag("node", -offset * step)
            inside = (slot + offset >= 0) & (slot + offset < run)
            return F.when(inside, moved.over(block)).otherwise("")

        rows = rows.withColumns(
            {
                f"before{level}": F.when(is_node, F.concat(*[beside(-o) for o in range(FANOUT - 1, 0, -1)])),
                f"after{level}": F.when(is_node, F.concat(*[beside(o) for o in range(1, FANOUT)])),
            }
        )
        parent = F.when(slot == 0, F.sha2(F.concat("node", f"after{level}"), 256))
        rows = rows.withColumn("node", F.when(F.col(f"after{level}").isNotNull(), parent).otherwise(F.col("node")))
        pair = F.struct(F.col(f"before{level}").alias("before"), F.col(f"after{level}").alias("after"))
        steps.append(F.when(F.col(f"after{level}").isNotNull(), pair))
    # a node's siblings stand on the row of its first leaf: carry them to its other leaves
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(step, ignorenulls=True).over(so_far).alias(f"step{i}") for i, step in enumerate(steps)]
    top = F.when(F.col("pos") % size == 0, F.col("node")).alias("top")
    path = F.filter(F.array(*[f"step{i}" for i in range(levels)]), lambda s: s.isNotNull()).cast(PATH).alias("path")
    return rows.select(*nodes.columns, "block", top, *carried).select(*nodes.columns, "block", "top", path)


def with_paths(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame], levels: int = LEVELS) -> DataFrame:
    """``nodes`` (key, pos, n, digest, ...) with path, subroot and root.

    ``finish`` turns (key, digest), one row a key, into (key, path, subroot, root).
    A climb is run twice, for the block digests and for the paths: narrow rows are
    cheaper to shuffle again than paths are to keep.
    """
    most = nodes.agg(F.max("n").alias("n")).first().n or 1
    if most == 1:
        return nodes.join(finish(nodes.select("key", "digest")), "key")
    size = FANOUT**levels
    rows = climbed(nodes, levels)
    tops = rows.where("top is not null").select(
        "key", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest")
    )
    above = with_paths(stored(tops, "block-digests"), finish, levels)
    rest = above.select("key", F.col("pos").alias("block"), F.col("path").alias("rest"), "subroot", "root")
    joined = rows.join(rest, ["key", "block"])
    return joined.select(*nodes.columns, F.concat("path", "rest").alias("path"), "subroot", "root")


def over_groups(levels: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over one digest a key, in order of key."""

    def finish(subroots: DataFrame) -> DataFrame:
        members = subroots.select(F.lit("").alias("key"), F.col("key").alias("member"), "digest")
        ranked = stored(placed(members, ["member"]), "subroots")

        def top(one: DataFrame) -> DataFrame:
            return one.select("key", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

        paths = with_paths(ranked, top, levels)
        return paths.select(F.col("member").alias("key"), "path", F.col("digest").alias("subroot"), "root")

    return finish


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id", levels: int = LEVELS
) -> DataFrame:
    """A row for each row of ``docs``: its leaf, the roots, the digest of its proof, and what folding the proof gives.

    The proof is folded from the leaf as tampered with, and the siblings as they were.
    """
    # written before they are sorted: sampling for the sort would read and hash all texts once more
    digests = stored(leaves(docs, columns, group, order).withColumnRenamed("leaf", "digest"), "digests")
    rows = placed(digests, ["doc_id", "digest", "seen"])
    paths = with_paths(stored(rows, "leaves"), over_groups(levels), levels)
    folded = F.aggregate("path", F.col("seen"), lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), ""), 256)
    report = paths.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
    )
    return report.withColumn("verified", F.col("folded_root") == F.col("root"))
