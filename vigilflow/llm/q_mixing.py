from .common import query, table
from .mixing import decide

SQL = r"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    case when source is null then '1' else '0' || source end as key,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from documents),
s as (select key, sum(size)::bigint as source_size, (row_number() over (order by key) - 1) % 3 + 1 as w from d group by key),
l as (select *, 3 * source_size / w::double as lim from s),
f as (select *, (select sum(source_size) from s) - coalesce(3 * sum(source_size) over b, 0) as rest_words,
    (select sum(w) from s) - coalesce(sum(w) over b, 0) as rest_w from l
    window b as (order by lim, key rows between unbounded preceding and 1 preceding)),
v as (select min_by(rest_words / rest_w::double, (lim, key)) as level from f where rest_words / rest_w::double <= lim),
t as (select key, source_size, least(3.0 * source_size, level * w)::double as target from s, v),
k as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
r as (select *, round(target - whole * source_size)::bigint as rest from k),
h as (select key, size, count(*) as n, (1000 * size / (size + 100)::double)::double as g0 from d where size > 0 group by key, size),
h1 as (select h.*, floor(g0)::bigint as g, rest from h join r using (key)),
h2 as (select *, coalesce(sum(n * size) over b, 0) as sure, sum(n * g * size) over (partition by key) - coalesce(sum(n * g * size) over b, 0) as mass
    from h1 window b as (partition by key order by size desc rows between unbounded preceding and 1 preceding)),
c as (select key, max_by((rest - sure)::double / mass::double, size) as c from h2 where (rest - sure)::double / mass::double * g <= 1 group by key),
o as (select r.*, c, rest - coalesce((select sum(n * size) from h1 where h1.key = r.key and c.c * h1.g >= 1), 0) as open from r left join c using (key)),
p as (select d.*, o.source_size, o.target, o.whole, o.open, o.c * floor(1000 * size / (size + 100)::double) as p from d join o using (key)),
q as (select *, case when p > 0 and p < 1 then (u / (1 - u)) * ((1 - p) / p) end as q from p),
m as (select *, case when q is not null then sum(size) over (partition by key, q is not null order by q, u, doc_id, size rows unbounded preceding) end as cum from q),
a as (select *, coalesce(cum <= open, false) as ordered from m),
g as (select key, max(open) - coalesce(sum(case when ordered then size end), 0) as gap, bool_and(ordered) as every from a where q is not null group by key),
e as (select a.key, min_by(doc_id, (abs(size - gap), q, u, doc_id, size)) as extra, min(abs(size - gap)) as off, max(gap) as gap
    from a join g using (key) where q is not null and not ordered and gap > 0 group by a.key)
select a.doc_id, a.size, a.source_size, a.target,
    (a.size * (a.whole + case when a.p >= 1 or a.ordered or (e.off < e.gap and a.doc_id = e.extra and not a.ordered and a.q is not null) then 1 else 0 end))::bigint as taken
from a left join e using (key)
"""


@query("op5_pareto_mix", SQL)
def op5_pareto_mix(spark, sf):
    """Words that the mix takes of every document."""
    return decide(table(spark, sf, "documents"))
