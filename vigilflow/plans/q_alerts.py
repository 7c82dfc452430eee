"""Alert filters, look-ups and operational summaries."""

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..sources import sinks
from ..session import shared_dir
from . import views as v
from .q_sources import _dir
from .registry import query

HITS = "(src_hit + dst_hit > 0)"
# first reason that is no indicator flag, else the first one
LEAD = """coalesce(list_filter(reasons, lambda r: not starts_with(r.feature, 'ioc_'))[1].tactic, reasons[1].tactic)"""


def _now(a):
    return a.agg(F.max("flow.ts")).scalar()


@query("flt_alerts", v.cte("scored") + "select flow_id, score from scored where score >= 0.02")
def flt_alerts(spark, sf):
    return al.over_threshold(v.scored(spark, sf), 0.02).select("flow_id", "score")


@query("flt_facets", v.cte("alerts") + f"""
select alert_id, score from alerts where proto = 'tcp' and score >= 0.88 and score < 0.96 and {HITS}
 and (contains(lower(reasons[1].tactic || '|' || reasons[2].tactic || '|' || reasons[3].tactic), 'exfiltration')
  or contains(lower(reasons[1].technique || '|' || reasons[2].technique || '|' || reasons[3].technique), 'exfiltration'))""")
def flt_facets(spark, sf):
    return al.facet_filter(v.alerts(spark, sf), proto="tcp", score=(0.88, 0.96), ioc=True, text=" Exfiltration ").select(
        "alert_id", "score")


@query("flt_match_count", v.cte("alerts") + """
select 'notified' as facet, count(*) filter (notify) as n from alerts
union all select 'recent', count(*) filter ((select max(ts) from alerts) - ts <= 300) from alerts
union all select 'minute', count(*) filter (floor(ts / 60) = 28415000) from alerts""")
def flt_match_count(spark, sf):
    a = v.alerts(spark, sf)
    parts = [al.match_count(a, **k).select(F.lit(n).alias("facet"), "n") for n, k in (
        ("notified", {"notified_only": True}), ("recent", {"recent_at": _now(a)}), ("minute", {"minute": 28415000}))]
    return parts[0].union(parts[1]).union(parts[2])


@query("alert_by_id", v.cte("alerts") + """
select alert_id, score, dst_ip from alerts where alert_id = (select max(alert_id) from alerts)""")
def alert_by_id(spark, sf):
    a = v.alerts(spark, sf)
    wanted = a.agg(F.max("alert_id")).first()[0]
    return al.by_id(a, wanted).select("alert_id", "score", "flow.dst_ip")


@query("alerts_latest", v.cte("alerts") + """
select alert_id, seq, score from (select alert_id, flow_id + 1000000 as seq, score from alerts where notify
 union all select alert_id, flow_id, score from alerts where not notify) order by seq desc limit 100""")
def alerts_latest(spark, sf):
    """Every alert twice for notified ones (live log and archive); the newest record of an id stays."""
    a = v.alerts(spark, sf)
    again = a.where(al.notified()).withColumn("seq", F.col("seq") + 1000000)
    return al.latest(a.unionByName(again), 100).select("alert_id", "seq", "score")


@query("audit_apt_notify", v.cte("alerts") + """
select 'apt_notify' as event, alert_id, actor from alerts where notify""")
def audit_apt_notify(spark, sf):
    r = al.audit_rows(v.alerts(spark, sf))
    return r.select("event", F.col("fields")["alert_id"].alias("alert_id"), F.col("fields")["actor"].alias("actor"))


@query("fmt_syslog", v.cte("alerts") + """
select alert_id, '<134>' || strftime(make_timestamp(cast(ts * 1000000 as bigint)), '%b %d %H:%M:%S') || ' alert-score: '
 || substring(repeat('{"alert_id":"' || alert_id || '","dst_ip":"' || dst_ip || '"}', 250), 1, 8000) as line from alerts""")
def fmt_syslog(spark, sf):
    a = v.alerts(spark, sf)
    payload = F.repeat(F.to_json(F.struct("alert_id", "flow.dst_ip")), F.lit(250))
    return a.select("alert_id", sinks.syslog_line(payload, F.timestamp_seconds("flow.ts")).alias("line"))


@query("sink_alerts", v.cte("alerts") + """,
d as (select cast(make_timestamp(cast(ts * 1000000 as bigint)) as date) as day, count(*) as n from alerts group by 1)
select day, n from d order by day desc limit 10""")
def sink_alerts(spark, sf):
    """Two batches and one of them again; retention keeps the newest ten days."""
    path = _dir(spark, "alerts")
    a = v.alerts(spark, sf)
    emit = sinks.json_sink(path)
    for batch, part in ((0, a.where(al.notified())), (1, a.where(~al.notified())), (1, a.where(~al.notified()))):
        emit(part, batch)
    back = spark.read.json(path)
    return sinks.retained(back, 10).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("sink_fanout", v.cte("alerts") + "select count(*) as n, 1 as errors_broken, 0 as errors_json from alerts")
def sink_fanout(spark, sf):
    """A failing sink is counted; the other one still gets every alert."""
    path = _dir(spark, "fan")

    def broken(df, batch):
        raise OSError("unreachable")

    emit = sinks.fan_out({"broken": broken, "json": sinks.json_sink(path)})
    emit(v.alerts(spark, sf), 0)
    stored = spark.read.json(path).agg(F.count(F.lit(1)).alias("n"))
    return stored.withColumns({f"errors_{k}": F.lit(n) for k, n in emit.errors.items()})


@query("sink_tables", v.cte("alerts") + """
select proto, count(*) as n, count(*) / (select count(*) from alerts) as share, cast(count(*) as varchar) as n_csv from alerts group by 1""")
def sink_tables(spark, sf):
    path = _dir(spark, "tables")
    a = v.alerts(spark, sf)
    sinks.write_tables({"protocols": al.protocol_mix(a), "verdicts": al.verdict_tally(a)}, path)
    return spark.read.json(f"{path}/protocols.json").join(
        spark.read.option("header", True).csv(f"{path}/protocols.csv").select("proto", F.col("n").alias("n_csv")), "proto")


@query("alert_assemble", v.cte("flows") + """
select 'r1-' || flow_id as alert_id, ts, src_port, round_even(sbytes / 5000, 4) as score, round_even(sbytes / 7777, 4) as age
from flows where sbytes / 5000 >= 0.02""")
def alert_assemble(spark, sf):
    f = v.flows(spark, sf).withColumns({
        "score": F.col("sbytes") / 5000, "ioc_src_match": F.lit(0.0), "ioc_dst_match": F.lit(1.0),
        "feed_age_score": F.col("sbytes") / 7777, "feed_confidence": F.lit(0.8), "source_count": F.lit(1.0),
        "reasons": F.array().cast(f"array<{al.REASON}>")})
    a = al.assemble(al.over_threshold(f, 0.02), "live_netflow", 0.02, "", "now", "r1")
    return a.select("alert_id", "flow.ts", "flow.src_port", "score", F.col("cti.feed_age_score").alias("age"))


@query("dash_kpis", v.cte("alerts") + f"""
select count(*) as alerts, count(*) filter (where {HITS}) as ioc_hits,
 count(*) filter (where (select max(ts) from alerts) - ts <= 300) as recent, count(*) filter (where notify) as notified from alerts""")
def dash_kpis(spark, sf):
    a = v.alerts(spark, sf)
    return al.kpis(a, _now(a))


MINUTES = """m as (select cast(floor(max(ts) / 60) as bigint) as cur from alerts),
g as (select unnest(generate_series(cur - {k}, cur)) as minute from m),
b as (select cast(floor(ts / 60) as bigint) as minute, {hits} as hit, proto, {lead} as tactic from alerts)"""


def _minutes(n):
    return "," + MINUTES.format(k=n - 1, hits=HITS, lead=LEAD)


@query("dash_timeline", v.cte("alerts") + _minutes(240) + """,
p as (select minute, arg_min(proto, (-k, proto)) as lead_proto from (select minute, proto, count(*) k from b group by 1, 2) group by 1),
t as (select minute, arg_min(tactic, (-k, tactic)) as lead_tactic from (select minute, tactic, count(*) k from b group by 1, 2) group by 1)
select g.minute, count(b.minute) as n, count(*) filter (b.hit) as ioc, any_value(p.lead_proto) as lead_proto, any_value(t.lead_tactic) as lead_tactic
from g left join b using (minute) left join p using (minute) left join t using (minute) group by 1""")
def dash_timeline(spark, sf):
    a = v.alerts(spark, sf)
    return al.timeline(a, _now(a), 240)


@query("dash_velocity", v.cte("alerts") + """
, m as (select max(ts) as now, floor(max(ts) / 60) - 14 as f from alerts)
select count(*) filter (now - ts <= 300) as recent, count(*) filter (floor(ts / 60) >= f) as sum15,
 round(count(*) filter (now - ts <= 300) / (count(*) filter (floor(ts / 60) >= f) / 3), 6) as vs_15min,
 round((count(*) filter (now - ts <= 300) / 5) / (count(*) / count(distinct floor(ts / 60))), 6) as vs_session from alerts, m""")
def dash_velocity(spark, sf):
    a = v.alerts(spark, sf)
    r = al.velocity(a, _now(a))
    return r.withColumns({c: F.round(c, 6) for c in ("vs_15min", "vs_session")})


@query("dash_burst", v.cte("alerts") + _minutes(240) + """,
c as (select g.minute, count(b.minute) as n from g left join b using (minute) group by 1)
select minute, n, round(n / avg(n) over (), 6) as factor from c""")
def dash_burst(spark, sf):
    a = v.alerts(spark, sf)
    return al.minute_burst(a, _now(a), 240).withColumn("factor", F.round("factor", 6))


@query("dash_score_hist", v.cte("alerts") + """
select g.band, round(0.85 + g.band * ((1 - 0.85::double) / 5), 6) as lo, count(a.score) as n
from (select cast(unnest(range(5)) as int) as band) g left join
 (select score, cast(least(4, floor((score - 0.85::double) / ((1 - 0.85::double) / 5))) as int) as band from alerts) a using (band) group by 1""")
def dash_score_hist(spark, sf):
    return al.score_histogram(v.alerts(spark, sf), v.THETA).withColumn("lo", F.round("lo", 6))


@query("dash_protocols", v.cte("alerts") + """
select proto, count(*) as n, round(count(*) / (select count(*) from alerts), 6) as share from alerts group by 1""")
def dash_protocols(spark, sf):
    return al.protocol_mix(v.alerts(spark, sf)).withColumn("share", F.round("share", 6))


@query("dash_tactics", v.cte("alerts") + f"""
select {LEAD} as tactic, count(*) as n from alerts group by 1 order by n desc, tactic limit 6""")
def dash_tactics(spark, sf):
    return al.top_tactics(v.alerts(spark, sf))


@query("dash_targets", v.cte("alerts") + f""",
t as (select dst_ip, count(*) as n, bool_or({HITS}) as ioc, min(ts) as first_ts, max(ts) as last_ts from alerts group by 1
 order by n desc, dst_ip limit 6),
p as (select dst_ip, string_agg(v || ' (' || k || ')', ', ' order by r) as top_dst_port from (
 select dst_ip, cast(dst_port as varchar) as v, count(*) as k, row_number() over (partition by dst_ip order by count(*) desc, cast(dst_port as varchar)) as r
 from alerts group by 1, 2) where r <= 3 group by 1),
q as (select dst_ip, string_agg(v || ' (' || k || ')', ', ' order by r) as top_proto from (
 select dst_ip, proto as v, count(*) as k, row_number() over (partition by dst_ip order by count(*) desc, proto) as r
 from alerts group by 1, 2) where r <= 3 group by 1)
select * from t join p using (dst_ip) join q using (dst_ip)""")
def dash_targets(spark, sf):
    return al.top_targets(v.alerts(spark, sf))


@query("dash_actors", v.cte("alerts") + f"""
select actor, count(*) filter (notify) as notified, count(*) filter (not notify) as candidates,
 round(coalesce(avg(confidence) filter (notify), 0), 6) as mean_confidence, count(*) filter (notify and {HITS}) as ioc_backed
from alerts where actor is not null group by 1""")
def dash_actors(spark, sf):
    return al.actor_groups(v.alerts(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("dash_verdicts", v.cte("alerts") + """
select case when notify then 'notified' when verdict = 'apt-candidate' then 'candidate' else 'not-apt' end as tier, count(*) as n
from alerts group by 1""")
def dash_verdicts(spark, sf):
    return al.verdict_tally(v.alerts(spark, sf))


@query("lat_batches", v.cte("scored") + """,
r as (select *, (row_number() over (order by ts, flow_id) - 1) // 64 as batch from scored)
select batch, count(*) as rows, count(*) filter (score >= 0.02) as alerts, min(ts) as first_ts, max(ts) as last_ts
from r group by 1 having batch >= 3 and count(*) >= 32""")
def lat_batches(spark, sf):
    return al.batch_numbers(v.scored(spark, sf), 64, 0.02, 3)


@query("sort_time", v.cte("flows") + "select flow_id, ts, row_number() over (order by ts, flow_id) as pos from flows")
def sort_time(spark, sf):
    """Position in stable time order."""
    from ..operators.ranks import RANGE, ranked, with_ranges

    f = with_ranges(v.flows(spark, sf).select("flow_id", "ts", F.lit(1).alias("_all")), "ts")
    return ranked(f, ["_all"], RANGE, [F.col("ts"), F.col("flow_id")], "pos").select("flow_id", "ts", "pos")
