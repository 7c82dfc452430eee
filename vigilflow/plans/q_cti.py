"""Indicator store and enrichment queries."""

from pyspark.sql import functions as F

from ..operators import cti, ioc
from . import views as v
from .registry import query, table

DT, TTL, HALF = 300.0, 86400.0, 21600.0


def _live(spark, sf):
    return cti.evidence(cti.live_entries(v.iocs(spark, sf)))


def _enriched(spark, sf, dt=DT, ttl=TTL, injection=False, **kw):
    f = v.flows(spark, sf)
    t0 = v.start(f)
    s = cti.build_sightings(v.iocs(spark, sf), f) if injection else _live(spark, sf)
    return cti.enrich(f, cti.timeline(s, dt, t0), dt, ttl, HALF, t0, **kw)


v.CTES["entries"] = (("iocs",), """
select value, first_seen as ts, confidence, seq, 0 as ord, source from iocs
union all select value, last_seen, confidence, seq, 1, source from iocs where last_seen <> first_seen""")


def timeline_cte(dt: float) -> str:
    return f"""tl as (select value, poll_t, confidence from (
 select *, row_number() over (partition by value, poll_t order by ts desc, seq desc, ord desc) r
 from (select e.*, t0 + ceil((ts - t0) / {dt}) * {dt} as poll_t from entries e, t0)) where r = 1)"""


def enriched_cte(dt: float = DT, ttl: float = TTL, half: float = HALF) -> str:
    """Enriched flows in DuckDB: one ASOF JOIN per endpoint, then the best-match rule."""
    side = """{p} as (select f.flow_id, coalesce(f.ts - t.poll_t <= {ttl}, false) as vis, f.ts - t.poll_t as age,
 t.confidence as conf from flows f asof left join tl t on f.{ip} = t.value and f.ts >= t.poll_t)"""
    return ",\n".join([
        timeline_cte(dt), side.format(p="s", ip="src_ip", ttl=ttl), side.format(p="d", ip="dst_ip", ttl=ttl),
        f"""best as (select f.*, (s.vis and not (d.vis and (not s.vis or d.conf >= s.conf))) as us,
 (d.vis and (not s.vis or d.conf >= s.conf)) as ud, s.age as s_age, d.age as d_age, s.conf as s_conf, d.conf as d_conf
 from flows f join s using (flow_id) join d using (flow_id)),
enriched as (select best.* exclude (us, ud, s_age, d_age, s_conf, d_conf),
 cast(us as int) as ioc_src_match, cast(ud as int) as ioc_dst_match,
 case when ud then d_age when us then s_age end as age_s,
 case when ud then d_conf when us then s_conf else 0 end as feed_confidence,
 case when ud or us then 1 else 0 end as source_count,
 coalesce(pow(0.5, case when ud then d_age when us then s_age end / {half}), 0) as feed_age_score
 from best)"""])


FEATURES_SQL = """cast(ioc_src_match as double) as ioc_src_match, cast(ioc_dst_match as double) as ioc_dst_match,
 round(cast(cast(feed_age_score as float) as double), 5) as feed_age_score, round(feed_confidence, 5) as feed_confidence,
 cast(source_count as double) as source_count,
 cast(case when feed_confidence >= 0.8 then 3 when feed_confidence >= 0.6 then 2 when feed_confidence > 0 then 1
 else 0 end as double) as reputation_bucket, age_s"""


def _features(df, *keep):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in cti.FEATURES], "age_s")


@query("ioc_classify", """
with vals as (select url as value from pages
 union all select md5(url) from pages
 union all select 'http://x.example/' || md5(url) from pages
 union all select regexp_extract(url, '://([^/?#]+)', 1) from pages
 union all select '10.0.' || (user_id // 256) || '.' || (user_id % 256) from events
 union all select event_type from events union all select text from benchmark),
l as (select lower(trim(value, chr(32)||chr(9)||chr(10)||chr(13))) as x from vals),
k as (select case when x = '' or length(x) > 256 then null
 when regexp_matches(x, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$') then 'ipv4'
 when contains(x, '://') and regexp_matches(split_part(x, '/', -1), '^[0-9a-f]{32,64}$') then 'hash'
 when contains(x, '://') then 'url'
 when regexp_matches(x, '^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$') then 'hash'
 when regexp_matches(x, '^([a-z0-9-]+\\.)+[a-z]{2,}$') then 'domain' end as ioc_type from l)
select coalesce(ioc_type, 'none') as ioc_type, count(*) as n from k group by 1""")
def ioc_classify(spark, sf):
    pages, events = table(spark, sf, "pages"), table(spark, sf, "events")
    uid = F.col("user_id")
    vals = pages.select(F.explode(F.array(
        "url", F.md5("url"), F.concat(F.lit("http://x.example/"), F.md5("url")),
        F.regexp_extract("url", "://([^/?#]+)", 1))).alias("value"))
    vals = vals.unionByName(events.select(F.explode(F.array(
        F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256), "event_type")).alias("value")))
    vals = vals.unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("value")))
    return vals.groupBy(F.coalesce(ioc.classify("value"), F.lit("none")).alias("ioc_type")).agg(
        F.count(F.lit(1)).alias("n"))


RAW = """raw as (select '  ' || value || ' ' as value, source,
 case when seq % 3 = 0 then 0 else first_seen end as first_seen, case when seq % 3 = 1 then 0 else last_seen end as last_seen,
 confidence * 2 - 0.5 as confidence, repeat(tags, 200) as tags, sightings, seq from iocs
 union all select 'not an indicator', source, first_seen, last_seen, confidence, tags, sightings, seq from iocs)"""


@query("ioc_normalise", v.cte("iocs") + "," + RAW + """
select trim(value) as value, 'ipv4' as ioc_type, source, case when first_seen <= 0 then last_seen else first_seen end as first_seen,
 case when last_seen <= 0 then first_seen else last_seen end as last_seen,
 round(greatest(0.0, least(1.0, confidence)), 6) as confidence, length(tags) as tag_len, sightings
from raw where value <> 'not an indicator'""")
def ioc_normalise(spark, sf):
    i, seq = v.iocs(spark, sf), F.col("seq")
    good = i.select(
        F.concat(F.lit("  "), "value", F.lit(" ")).alias("value"), "source",
        F.when(seq % 3 == 0, 0.0).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(seq % 3 == 1, 0.0).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.col("confidence") * 2 - 0.5).alias("confidence"), F.repeat("tags", F.lit(200)).alias("tags"), "sightings")
    bad = i.select(F.lit("not an indicator").alias("value"), "source", "first_seen", "last_seen", "confidence",
                   "tags", "sightings")
    return ioc.normalise(good.unionByName(bad)).select(
        "value", "ioc_type", "source", "first_seen", "last_seen", F.round("confidence", 6).alias("confidence"),
        F.length("tags").alias("tag_len"), "sightings")


v.CTES["store"] = (("iocs",), """
select value, ioc_type, source, arg_min(provenance, seq) as provenance, min(first_seen) as first_seen,
 max(last_seen) as last_seen, max(confidence) as confidence,
 coalesce(arg_max(tags, seq) filter (tags <> ''), '') as tags,
 cast(arg_min(sightings, seq) + count(*) - 1 as int) as sightings
from iocs group by value, ioc_type, source""")


@query("ioc_upsert", v.cte("store") + "select * replace (round(confidence, 6) as confidence) from store")
def ioc_upsert(spark, sf):
    # the first half of the feed is stored, then the second half arrives
    i = v.iocs(spark, sf)
    mid = i.agg(F.percentile_approx("seq", 0.5)).scalar()
    old = ioc.upsert(i.where(F.col("seq") <= mid))
    new = ioc.upsert(i.where(F.col("seq") > mid), old)
    return new.withColumn("confidence", F.round("confidence", 6))


@query("ioc_expire", v.cte("store", "t0") + """
select count(*) filter (last_seen < cut) as removed, count(*) filter (last_seen >= cut) as kept
from store, (select max(last_seen) - 240 * 3600.0 as cut from store)""")
def ioc_expire(spark, sf):
    store = ioc.upsert(v.iocs(spark, sf))
    now = store.agg(F.max("last_seen")).scalar()
    return ioc.expiry_counts(store, 240.0, now)


@query("ioc_stats", v.cte("store") + """
select 'total' as dimension, 'all' as name, count(*) as n from store
union all select 'ioc_type', ioc_type, count(*) from store group by ioc_type
union all select 'source', source, count(*) from store group by source""")
def ioc_stats(spark, sf):
    return ioc.stats(ioc.upsert(v.iocs(spark, sf)))


@query("ioc_lookup", v.cte("store", "flows") + """
select value, source, sightings from store where value in (select dst_ip from flows where dst_port = 4444)""")
def ioc_lookup(spark, sf):
    wanted = v.flows(spark, sf).where(F.col("dst_port") == 4444).select(F.col("dst_ip").alias("value"))
    return ioc.lookup(ioc.upsert(v.iocs(spark, sf)), wanted).select("value", "source", "sightings")


@query("cti_poll_grid", v.cte("t0") + """
select flow_id, t0 + ceil((ts - t0) / 300.0) * 300.0 as poll_5m, t0 + ceil((ts - t0) / 3600.0) * 3600.0 as poll_1h,
 ts as poll_0 from flows, t0""")
def cti_poll_grid(spark, sf):
    f = v.flows(spark, sf)
    t0 = f.agg(F.min("ts")).scalar()
    return f.select("flow_id", cti.poll_grid("ts", 300, t0).alias("poll_5m"),
                    cti.poll_grid("ts", 3600, t0).alias("poll_1h"), cti.poll_grid("ts", 0, t0).alias("poll_0"))


@query("cti_asof_join", v.cte("entries", "t0") + "," + timeline_cte(DT) + f"""
select f.flow_id, case when f.ts - t.poll_t <= {TTL} then 1 else 0 end as visible,
 case when f.ts - t.poll_t <= {TTL} then f.ts - t.poll_t end as age,
 round(case when f.ts - t.poll_t <= {TTL} then t.confidence else 0 end, 6) as conf
from flows f asof left join tl t on f.dst_ip = t.value and f.ts >= t.poll_t""")
def cti_asof_join(spark, sf):
    f = v.flows(spark, sf)
    t0 = v.start(f)
    s = cti.slotted_timeline(cti.timeline(_live(spark, sf), DT, t0), DT, TTL, t0)
    j = cti.asof_join(f, s, "dst_ip", DT, TTL, t0, "d")
    return j.select("flow_id", F.col("d_visible").cast("int").alias("visible"), F.col("d_age").alias("age"),
                    F.round("d_conf", 6).alias("conf"))


@query("cti_asof_exact_times", v.cte("entries") + f""",
tl as (select value, ts as poll_t, arg_max(confidence, (seq, ord)) as confidence from entries group by 1, 2)
select f.flow_id, case when f.ts - t.poll_t <= {TTL} then f.ts - t.poll_t end as age,
 round(case when f.ts - t.poll_t <= {TTL} then t.confidence else 0 end, 6) as conf
from flows f asof left join tl t on f.dst_ip = t.value and f.ts >= t.poll_t""")
def cti_asof_exact_times(spark, sf):
    """Zero poll interval: sightings count from their own time on."""
    f = v.flows(spark, sf)
    t0 = v.start(f)
    s = cti.slotted_timeline(cti.timeline(_live(spark, sf), 0, t0), 0, TTL, t0)
    j = cti.asof_join(f, s, "dst_ip", 0, TTL, t0, "d", strategy="merge")
    return j.select("flow_id", F.col("d_age").alias("age"), F.round("d_conf", 6).alias("conf"))


@query("cti_enrich", v.cte("entries", "t0") + "," + enriched_cte() + f"select flow_id, {FEATURES_SQL} from enriched")
def cti_enrich(spark, sf):
    return _features(_enriched(spark, sf), "flow_id")


@query("cti_enrich_shuffled", v.cte("entries", "t0") + "," + enriched_cte() + f"select flow_id, {FEATURES_SQL} from enriched")
def cti_enrich_shuffled(spark, sf):
    """The plan for timelines too large to broadcast: a filter of their addresses first, then joins by shuffle."""
    return _features(_enriched(spark, sf, broadcast_rows=0), "flow_id")


@query("cti_age_score", v.cte("entries", "t0") + "," + enriched_cte() +
       "select cast(age_s / 3600 as bigint) as age_h, count(*) as n, round(avg(feed_age_score), 5) as score from enriched group by 1")
def cti_age_score(spark, sf):
    e = _enriched(spark, sf)
    return e.groupBy(F.round(F.col("age_s") / 3600).cast("bigint").alias("age_h")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("feed_age_score").cast("double")), 5).alias("score"))


@query("cti_reputation", v.cte("iocs") + """
select seq, cast(case when confidence * 1.2 - 0.6 >= 0.8 then 3 when confidence * 1.2 - 0.6 >= 0.6 then 2
 when confidence * 1.2 - 0.6 > 0 then 1 else 0 end as int) as bucket from iocs""")
def cti_reputation(spark, sf):
    return v.iocs(spark, sf).select("seq", cti.reputation(F.col("confidence") * 1.2 - 0.6).alias("bucket"))


@query("cti_coverage", v.cte("entries", "t0") + "," + enriched_cte() + """
select round(avg(m), 6) as coverage_all, round(avg(m) filter (label = 1), 6) as coverage_malicious,
 round(avg(m) filter (label = 0), 6) as coverage_benign,
 round(quantile_cont(age_s / 60, 0.5) filter (m = 1), 6) as median_age_min,
 round(quantile_cont(age_s / 60, 0.9) filter (m = 1), 6) as p90_age_min
from (select *, ioc_src_match + ioc_dst_match as m from enriched)""")
def cti_coverage(spark, sf):
    c = cti.coverage(_enriched(spark, sf))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


# controlled injection: hash-ordered choice of addresses, then the evidence model
v.CTES["ips"] = (("flows",), """
select ip, bool_or(label = 1) as malicious,
 bool_or(label = 1 and role = 0) and bool_or(label = 1 and role = 1) as multi_role
from (select src_ip as ip, 0 as role, label from flows union all select dst_ip, 1, label from flows) group by ip""")
v.CTES["picked"] = (("ips",), """
select ip, malicious, multi_role from (
 select *, row_number() over (partition by malicious order by md5('42:' || ip)) as r,
  count(*) over (partition by malicious) as n from ips)
where r <= greatest(1, floor(n * case when malicious then 0.6 else 0.004 end))""")
v.CTES["merged"] = (("picked", "entries"), """
select ip as value, ts, null::double as confidence, role, 0 as seq, 0 as ord, false as live from (
 select distinct ip, role, ts from (select src_ip as ip, 0 as role, ts from flows union all select dst_ip, 1, ts from flows)
 where ip in (select ip from picked))
union all select value, ts, confidence, 2, seq, ord, true from entries""")
v.CTES["sightings"] = (("merged",), """
select m.*, case when live then confidence else least(0.95, 0.45 + 0.07 * (rnk - 1)) end as conf,
 cast(case when live then 1 else least(3, 1 + cast(rnk >= 2 as int) + cast(rnk >= 5 as int)
  + cast(coalesce(p.multi_role, false) as int)) end as int) as sources
from (select *, row_number() over (partition by value order by ts, role, seq, ord) as rnk from merged) m
left join picked p on m.value = p.ip""")


@query("cti_inject", v.cte("picked") + "select ip, malicious, multi_role from picked")
def cti_inject(spark, sf):
    return cti.select_injected(v.flows(spark, sf))


@query("cti_sightings", v.cte("merged") + """
select value, live, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from merged group by 1, 2""")
def cti_sightings(spark, sf):
    s = cti.build_sightings(v.iocs(spark, sf), v.flows(spark, sf))
    return s.groupBy("value", "live").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))


@query("cti_evidence_rank", v.cte("sightings") + """
select value, ts, role, seq, ord, rnk, round(conf, 6) as conf, sources from sightings""")
def cti_evidence_rank(spark, sf):
    s = cti.build_sightings(v.iocs(spark, sf), v.flows(spark, sf))
    return s.select("value", "ts", "role", "seq", "ord", "rnk", F.round("conf", 6).alias("conf"), "sources")


@query("cti_summary", v.cte("sightings") + """
select count(distinct value) as n_indicators, count(*) filter (live) as n_sightings_live,
 count(*) filter (not live) as n_sightings_injected, count(distinct value) filter (sources > 1) as n_multi_source
from sightings""")
def cti_summary(spark, sf):
    return cti.sighting_summary(cti.build_sightings(v.iocs(spark, sf), v.flows(spark, sf)))


@query("cti_enrich_injected", v.cte("sightings", "t0") + """,
tl as (select value, poll_t, conf, sources from (select *, row_number() over (partition by value, poll_t
  order by ts desc, role desc, seq desc, ord desc) r
 from (select s.*, t0 + ceil((ts - t0) / 300.0) * 300.0 as poll_t from sightings s, t0)) where r = 1),
d as (select f.flow_id, f.ts - t.poll_t <= 604800 as vis, f.ts - t.poll_t as age, t.conf, t.sources
 from flows f asof left join tl t on f.dst_ip = t.value and f.ts >= t.poll_t),
s as (select f.flow_id, f.ts - t.poll_t <= 604800 as vis, f.ts - t.poll_t as age, t.conf, t.sources
 from flows f asof left join tl t on f.src_ip = t.value and f.ts >= t.poll_t),
b as (select flow_id, coalesce(d.vis, false) and (not coalesce(s.vis, false) or d.conf >= s.conf) as ud,
 coalesce(s.vis, false) as sv, s.age sa, d.age da, s.conf sc, d.conf dc, s.sources sk, d.sources dk from s join d using (flow_id))
select flow_id, cast(sv and not ud as int) as src, cast(ud as int) as dst,
 case when ud then da when sv then sa end as age_s,
 round(case when ud then dc when sv then sc else 0 end, 5) as conf,
 cast(case when ud then dk when sv then sk else 0 end as int) as sources from b""")
def cti_enrich_injected(spark, sf):
    e = _enriched(spark, sf, ttl=604800.0, injection=True)
    return e.select("flow_id", F.col("ioc_src_match").cast("int").alias("src"),
                    F.col("ioc_dst_match").cast("int").alias("dst"), "age_s",
                    F.round(F.col("feed_confidence").cast("double"), 5).alias("conf"),
                    F.col("source_count").cast("int").alias("sources"))


@query("cti_distinct_sources", v.cte("entries", "t0") + """,
g as (select value, source, t0 + ceil((ts - t0) / 3600.0) * 3600.0 as poll_t from entries, t0)
select value, poll_t, (select count(distinct source) from g b where b.value = a.value and b.poll_t <= a.poll_t) as sources
from (select distinct value, poll_t from g) a""")
def cti_distinct_sources(spark, sf):
    t0 = v.start(v.flows(spark, sf))
    return cti.timeline(_live(spark, sf), 3600.0, t0, source_mode="distinct").select(
        "value", "poll_t", F.col("sources").cast("bigint").alias("sources"))


# ------------------------------------------------------------- set operations
@query("set_distinct_ips", v.cte("ips") + "select ip from ips")
def set_distinct_ips(spark, sf):
    f = v.flows(spark, sf)
    return f.select(F.col("src_ip").alias("ip")).union(f.select("dst_ip")).distinct()


@query("set_intersect", v.cte("iocs") + "select src_ip as ip from flows intersect select value from iocs")
def set_intersect(spark, sf):
    return v.flows(spark, sf).select(F.col("src_ip").alias("ip")).intersect(v.iocs(spark, sf).select("value"))


# every benign address also has malicious flows at some time, so the differences are taken per hour
HOUR = "cast(floor(ts / 3600) as bigint)"


def _hours(f, label):
    return f.where(F.col("label") == label).select(F.col("src_ip").alias("ip"), F.floor(F.col("ts") / 3600).cast("bigint").alias("hour"))


@query("set_except", v.cte("flows") + f"""
select src_ip as ip, {HOUR} as hour from flows where label = 0 except select src_ip, {HOUR} from flows where label = 1""")
def set_except(spark, sf):
    """Addresses and hours with benign flows only."""
    f = v.flows(spark, sf)
    return _hours(f, 0).subtract(_hours(f, 1))


@query("set_union", v.cte("flows") + """
select dataset, count(*) as n, sum(label) as positives, round(sum(dur), 3) as dur from (
 select 'udp' as dataset, * from flows where proto = 'udp' union all select 'other', * from flows where proto <> 'udp') group by 1""")
def set_union(spark, sf):
    f = v.flows(spark, sf)
    parts = f.where("proto = 'udp'").withColumn("dataset", F.lit("udp")).unionByName(
        f.where("proto <> 'udp'").withColumn("dataset", F.lit("other")))
    return parts.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"),
                                        F.round(F.sum("dur"), 3).alias("dur"))


@query("join_anti_benign", v.cte("flows") + f"""
select flow_id, src_ip from flows f where label = 0 and not exists (
 select 1 from flows m where m.label = 1 and m.src_ip = f.src_ip and floor(m.ts / 3600) = floor(f.ts / 3600))""")
def join_anti_benign(spark, sf):
    """Benign flows of addresses without a malicious flow in the same hour."""
    f = v.flows(spark, sf).withColumn("hour", F.floor(F.col("ts") / 3600).cast("bigint"))
    bad = _hours(f, 1).withColumnRenamed("ip", "src_ip").distinct()
    return f.where("label = 0").join(bad, ["src_ip", "hour"], "left_anti").select("flow_id", "src_ip")


@query("join_semi_selected", v.cte("picked") + """
select flow_id, src_ip, dst_ip from flows where src_ip in (select ip from picked)""")
def join_semi_selected(spark, sf):
    f = v.flows(spark, sf)
    sel = cti.select_injected(f).select(F.col("ip").alias("src_ip"))
    return f.join(sel, "src_ip", "left_semi").select("flow_id", "src_ip", "dst_ip")


def ft_rates(spark, sf):
    """Live-enriched flows with native and derived rate columns, as the scorer sees them."""
    from ..functions.features import add_rates
    from ..sources.flows import derive

    return add_rates(derive(_enriched(spark, sf)))


# ------------------------------------------------------------------ volume
v.CTES["wide"] = ((), """
select '172.16.' || ((l_partkey % 4000) // 256) || '.' || (l_partkey % 256) as dst_ip,
 '10.1.' || ((l_suppkey % 500) // 256) || '.' || (l_suppkey % 256) as src_ip,
 epoch(l_shipdate) + l_linenumber * 60.0 + (l_orderkey % 3600) as ts, cast(l_returnflag = 'R' as int) as label, l_quantity from lineitem""")
v.CTES["wide_entries"] = (("wide",), """
select dst_ip as value, ts, max(0.5 + l_quantity / 100) as confidence from wide where label = 1 and l_quantity >= 40 group by 1, 2""")


@query("cti_enrich_volume", v.cte("wide_entries") + """,
z as (select min(ts) as t0 from wide),
tl as (select value, poll_t, arg_max(confidence, ts) as confidence from (
 select e.*, t0 + ceil((ts - t0) / 300.0) * 300.0 as poll_t from wide_entries e, z) group by 1, 2)
select f.label, count(*) as n, count(*) filter (f.ts - t.poll_t <= 604800) as matched,
 round(sum(t.confidence) filter (f.ts - t.poll_t <= 604800), 3) as conf, sum(f.ts - t.poll_t) filter (f.ts - t.poll_t <= 604800) as age
from wide f asof left join tl t on f.dst_ip = t.value and f.ts >= t.poll_t group by 1""")
def cti_enrich_volume(spark, sf):
    """One flow per line item; both endpoints are joined, only destinations carry indicators."""
    li = table(spark, sf, "lineitem")
    dst, src = F.col("l_partkey"), F.col("l_suppkey")
    f = li.select(
        F.concat(F.lit("172.16."), F.floor((dst % 4000) / 256), F.lit("."), dst % 256).alias("dst_ip"),
        F.concat(F.lit("10.1."), F.floor((src % 500) / 256), F.lit("."), src % 256).alias("src_ip"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 60.0 + F.col("l_orderkey") % 3600).alias("ts"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity")
    t0 = v.start(f)
    s = f.where("label = 1 and l_quantity >= 40").groupBy(F.col("dst_ip").alias("value"), "ts").agg(
        F.max(F.lit(0.5) + F.col("l_quantity") / 100).alias("conf")).select(
        "value", "ts", "conf", F.lit(1).alias("sources"), F.lit(0).alias("role"), F.lit(0).alias("seq"), F.lit(0).alias("ord"))
    e = cti.enrich(f, cti.timeline(s, DT, t0), DT, 604800.0, HALF, t0)
    hit = F.col("ioc_dst_match") > 0
    # the features hold single precision; the confidence is a multiple of 0.01
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("matched"),
        F.round(F.sum(F.when(hit, F.round(F.col("feed_confidence").cast("double"), 4))), 3).alias("conf"),
        F.sum(F.when(hit, F.col("age_s"))).alias("age"))
