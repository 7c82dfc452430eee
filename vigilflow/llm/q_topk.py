from pyspark.sql import functions as F

from .common import query, table
from .topk import search

SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as x from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id != q.vec_id and len(c.x) = len(q.x)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op3_blockmax_topk", SQL)
def op3_blockmax_topk(spark, sf):
    """The ten best vectors of every hundredth."""
    return search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)
