"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex({text}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"

REPEATED_WORDS = f"""
with d as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as s from d)),
later as (select doc_id, s from windows qualify row_number() over (partition by k order by doc_id, s) > 1),
removed as (select distinct doc_id, unnest(range(s, s + 20)) as at from later),
placed as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from d),
kept as (select p.doc_id, string_agg(word, ' ' order by p.at) as kept from placed p anti join removed r on p.doc_id = r.doc_id and p.at = r.at group by p.doc_id),
n as (select doc_id, count(*) as n_removed from removed group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n on d.doc_id = n.doc_id left join kept on d.doc_id = kept.doc_id"""

NEAR_COPIES = f"""
with recursive d as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
shingles as (select distinct doc_id, array_to_string(w[s:s + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as s from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
linked as (select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * s.n >= 75 * (x.n + y.n - s.n)),
both_ways as (select a, b from linked union all select b, a from linked),
reached as (select doc_id, doc_id as other from d union select r.doc_id, l.b from reached r join both_ways l on r.other = l.a),
least as (select doc_id, min(other) as component_id from reached group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d join least on d.doc_id = least.doc_id left join sizes on d.doc_id = sizes.doc_id"""


def _field(name: str) -> str:
    value = f"cast({name} as varchar)"
    return f"case when {name} is null then '-' else strlen({value}) || ':' || {value} end"


def _leaf(text: str = "text") -> str:
    return f"sha256({' || '.join(_field(c) if c != 'text' else _field(text) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"


CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _tree(name: str, levels: int) -> str:
    """Levels of trees ``name0(g, pos, h)``: of each the nodes, and what stands left and right of a node in its run."""
    out = []
    for n in range(levels):
        run = "partition by g, pos // 16 order by pos rows between"
        out.append(f"""{name}{n}w as (select *, count(*) over (partition by g) as total,
            coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
            coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from {name}{n}),
          {name}{n + 1} as (select g, pos // 16 as pos, case when any_value(total) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h
            from {name}{n}w group by g, pos // 16)""")
    return ",\n".join(out)


def _climb(rows: str, name: str, levels: int, pos: str, g: str) -> tuple[str, str]:
    """Rows with ``folded`` and ``path`` carried up the tree."""
    out = []
    for n in range(levels):
        out.append(f"""{rows}_{name}{n + 1} as (select p.* replace (case when t.total > 1 then sha256(t.l || p.folded || t.r) else p.folded end as folded,
            case when t.total > 1 then p.path || t.l || t.r else p.path end as path)
          from {rows if n == 0 else f"{rows}_{name}{n}"} p join {name}{n}w t on t.g = p.{g} and t.pos = p.{pos} // {16**n})""")
    return ",\n".join(out), f"{rows}_{name}{levels}"


def manifest_sql(levels: int = 6, source_levels: int = 4) -> str:
    """For up to 16 ** levels leaves of a source and 16 ** source_levels sources; ids differ within a source."""
    lower, low = _climb("p", "s", levels, "pos", "g")
    upper, top = _climb(low, "u", source_levels, "source_at", "one")
    return f"""
with p0 as (select doc_id, source, coalesce('s' || source, '') as g, {_leaf()} as leaf,
    case when {CRC32} % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_leaf()} end as folded from documents),
p1 as (select *, '' as path, 1 as one, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from p0),
s0 as (select g, pos, leaf as h from p1),
{_tree("s", levels)},
sources as (select g, h, row_number() over (order by g) - 1 as pos from s{levels}),
u0 as (select 1 as g, pos, h from sources),
{_tree("u", source_levels)},
p as (select p1.*, s.pos as source_at, s.h as subroot from p1 join sources s on s.g = p1.g),
{lower},
{upper}
select doc_id, leaf, subroot, u{source_levels}.h as root, sha256(path) as proof_sha256, folded as folded_root, folded = u{source_levels}.h as verified
from {top} cross join u{source_levels}"""


MANIFEST = manifest_sql()
