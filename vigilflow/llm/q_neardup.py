from .common import query, table
from .neardup import near_duplicates

SQL = """
with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, x, sqrt(list_dot_product(x, x)) as l from v),
e as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.9),
r as (select vec_id as node, vec_id as reach from v union select r.node, e.b from r join e on r.reach = e.a),
c as (select node, min(reach) as component_id from r group by node),
n as (select a, count(*) as n from e group by a)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join c on vec_id = c.node left join n on vec_id = n.a
"""


@query("op4_pq_neardup", SQL)
def op4_pq_neardup(spark, sf):
    """Links and components of all vectors at cosine 0.9."""
    return near_duplicates(table(spark, sf, "embeddings"))
