from .common import query, table
from .minhash import near_duplicates

SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from w),
x as materialized (select doc_id, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
e as materialized (select a, b from p join s sa on p.a = sa.doc_id join s sb on p.b = sb.doc_id where 100 * c >= 75 * (len(sa.s) + len(sb.s) - c)),
r as (select doc_id as node, doc_id as reach from documents union select r.node, e.b from r join e on r.reach = e.a),
c as (select node, min(reach) as component_id from r group by node)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on doc_id = node
"""


@query("op6_cpsjoin_neardup", SQL)
def op6_cpsjoin_neardup(spark, sf):
    """Components of all documents at shingle similarity 0.75."""
    return near_duplicates(table(spark, sf, "documents"))
