from .common import query, table
from .merkle import audited

# DuckDB has no crc32: bit by bit over the digits of the id.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: coalesce(ord(c), 0)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)), 4294967295)"""
FIELD = "case when {0} is null then '-' else octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, first: str, depth: int) -> str:
    """Nodes (k, pos, h, n) of every level: l and r are the digests beside a node; a key with one node left stays as it is."""
    out = [f"{name}0 as ({first})"]
    for i in range(depth):
        run = "partition by k, pos // 8 order by pos rows between"
        out.append(f"""{name}s{i} as (select k, pos, case when n > 1 then coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') else '' end as l,
            case when n > 1 then coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') else '' end as r, n > 1 as act from {name}{i})""")
        out.append(f"""{name}{i + 1} as (select k, pos // 8 as pos, case when max(n) > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end as h, (max(n) + 7) // 8 as n
            from {name}{i} group by k, pos // 8)""")
    return ",\n".join(out)


LOW, HIGH = 9, 4  # levels of the statement: 8^9 documents of a language, 8^4 languages


def _sql() -> str:
    steps = ["f0 as (select row_number() over () as id, t.*, ktop.pos as kpos, case when crc % 3 = 0 then bad else leaf end as cur, '' as sib from t join ktop using (k))"]
    for i in range(LOW):
        steps.append(f"""f{i + 1} as (select f{i}.* exclude (cur, sib), case when act then sha256(l || cur || r) else cur end as cur, sib || l || r as sib
            from f{i} join as{i} s on f{i}.k = s.k and f{i}.pos // {8**i} = s.pos)""")
    for i in range(HIGH):
        j = LOW + i
        steps.append(f"""f{j + 1} as (select f{j}.* exclude (cur, sib), case when act then sha256(l || cur || r) else cur end as cur, sib || l || r as sib
            from f{j} join bs{i} s on f{j}.kpos // {8**i} = s.pos)""")
    low = _levels("a", "select k, pos, leaf as h, n from t", LOW)
    high = _levels("b", "select 0 as k, pos, h, n from ktop", HIGH)
    bad = _leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
with d as (select doc_id, coalesce('.' || lang, '') as k, {CRC} as crc, {_leaf('text')} as leaf, {bad} as bad from documents),
t as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n from d),
{low},
ktop as (select k, h, row_number() over (order by k) - 1 as pos, count(*) over () as n from a{LOW}),
{high},
{", ".join(steps)}
select doc_id, leaf, ktop.h as subroot, b{HIGH}.h as root, sha256(sib) as proof_sha256, cur as folded_root, cur = b{HIGH}.h as verified
from f{LOW + HIGH} join ktop using (k), b{HIGH}
"""


@query("op13_merkle_manifest", _sql())
def op13_merkle_manifest(spark, sf):
    """Digests, proof and tamper check of every document."""
    return audited(table(spark, sf, "documents"))
