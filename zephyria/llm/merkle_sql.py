"""The manifest as plain SQL, for the check of ``merkle``: strings joined run by run, level by level."""

from __future__ import annotations

#: Levels that the text is written out for: 3 ** 12 rows a source, 3 ** 8 sources.
GROUP_LEVELS, TOP_LEVELS = 12, 8

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(tree: str, levels: int) -> str:
    """Digests and siblings of the nodes of every level; ``<tree>0`` has (k, p, h, m), m the nodes of the level."""
    parts = []
    for i in range(levels):
        run = "over (partition by k, p // 3 order by p rows between"
        parts.append(
            f"""{tree}_beside{i} as materialized (
 select k, p, m, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as b,
 coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as a from {tree}{i})"""
        )
        parts.append(
            f"""{tree}{i + 1} as materialized (
 select k, p, h, count(*) over (partition by k) as m from (
 select k, p // 3 as p, case when max(m) > 1 then sha256(string_agg(h, '' order by p)) else min(h) end as h
 from {tree}{i} group by k, p // 3))"""
        )
    return ",\n".join(parts)


def _fold(rows: str, tree: str, place: str, levels: int) -> str:
    """``<rows>0`` with its proof and folded digest carried up to ``<rows><levels>``."""
    parts = []
    for i in range(levels):
        parts.append(
            f"""{rows}{i + 1} as materialized (
 select f.* replace (f.proof || case when s.m > 1 then s.b || s.a else '' end as proof,
 case when s.m > 1 then sha256(s.b || f.cur || s.a) else f.cur end as cur)
 from {rows}{i} f join {tree}_beside{i} s on s.k = f.{'k' if place == 'p' else 'one'} and s.p = f.{place} // {3**i})"""
        )
    return ",\n".join(parts)


MANIFEST_SQL = f"""
with crc_table as (
 select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
 lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) as t
), docs as materialized (
 select doc_id, coalesce('=' || source, '') as k, {_leaf('text')} as leaf,
 case when xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
 lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 2 = 0
 then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end as seen
 from documents, crc_table
), rows0 as materialized (
 select doc_id, k, '' as one, leaf, row_number() over (partition by k order by doc_id nulls first, leaf, seen) - 1 as p,
 seen as cur, '' as proof from docs
), tree0 as materialized (
 select k, p, leaf as h, count(*) over (partition by k) as m from rows0
),
{_climb('tree', GROUP_LEVELS)},
subroots as materialized (
 select k, h as subroot, row_number() over (order by k) - 1 as q from tree{GROUP_LEVELS}
), top0 as materialized (
 select '' as k, q as p, subroot as h, count(*) over () as m from subroots
),
{_climb('top', TOP_LEVELS)},
{_fold('rows', 'tree', 'p', GROUP_LEVELS)},
tops0 as materialized (
 select r.*, subroot, q from rows{GROUP_LEVELS} r join subroots using (k)
),
{_fold('tops', 'top', 'q', TOP_LEVELS)}
select f.doc_id, f.leaf, f.subroot, t.h as root, sha256(f.proof) as proof_sha256, f.cur as folded_root, f.cur = t.h as verified
from tops{TOP_LEVELS} f, top{TOP_LEVELS} t
"""
