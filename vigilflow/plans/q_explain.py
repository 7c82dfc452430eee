"""Reason codes, ATT&CK mapping and stability audit."""

from pyspark.sql import functions as F

from ..functions import attack as at
from ..operators import explain as ex
from ..session import spread
from . import views as v
from .q_metrics import rounded
from .registry import query, table

# feature names to map, padded with a counter to make unseen ones
_NAMES = ("sttl", "mean_pkt_size", "service_http", "Flow Bytes/s", "proto_tcp", "ioc_src_match", "ct_dst_ltm", "ct_xyz", "dst_port",
          "is_sm_ips_ports", "Idle Time Max", "state", "smeansz", "synack", "trans_depth", "proto")
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "][1 + event_id % 16]"
_MAP_SQL = ("case feature " + " ".join(f"when '{n}' then '{{}}'" for n in _NAMES) + " end")


@query("attack_map", f"""
select feature, {_MAP_SQL.format(*[v.attack_of(n)[0] for n in _NAMES])} as tactic, {_MAP_SQL.format(*[v.attack_of(n)[1] for n in _NAMES])} as technique,
 count(*) as n from (select {_NAME_SQL} as feature from events) group by 1""")
def attack_map(spark, sf):
    e = table(spark, sf, "events").select(F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 16 + 1).cast("int")).alias("feature"))
    return e.join(F.broadcast(at.map_features(e)), "feature").groupBy("feature", "tactic", "technique").agg(F.count(F.lit(1)).alias("n"))


@query("reason_text", """
select event_id, case event_id % 7 when 0 then 'uplink bytes = ' || printf('%g', value * 1000) when 1 then 'connection state = FIN_x'
 when 2 then 'feed confidence ' || printf('%.2f', value) when 3 then 'flow duration = ' || printf('%g', value / 100000)
 when 4 then 'syn flag = ' || printf('%g', value) when 5 then 'mean pkt size = ' || printf('%g', value * 1e7) else 'destination IP appears on a live CTI feed' end as text from events""")
def reason_text(spark, sf):
    k, val = F.col("event_id") % 7, F.col("value")
    f = v._pick(k, {0: "sbytes", 1: "state_FIN_x", 2: "feed_confidence", 3: "dur", 4: "syn_flag", 5: "mean_pkt_size"}, "ioc_dst_match")
    x = F.when(k == 0, val * 1000).when(k == 3, val / 100000).when(k == 5, val * 1e7).otherwise(val)
    e = table(spark, sf, "events").select("event_id", f.alias("f"), x.alias("x"))
    return e.select("event_id", at.reason_text("f", "x").alias("text"))


# contributions: eight features per flow with values from the flow and a hashed contribution
FEATS = ("sbytes", "dbytes", "dur", "Spkts", "mean_pkt_size", "service_http", "feed_confidence", "ioc_dst_match")


def _phi_sql(i):
    return f"((flow_id * {7 + 6 * i} + {i * 13}) % 101 - 60) / 100"


v.CTES["contrib"] = (("flows",), "select flow_id, i as pos, feature, shap from (" + " union all ".join(
    f"select flow_id, {i} as i, '{f}' as feature, {_phi_sql(i)} as shap from flows" for i, f in enumerate(FEATS)) + ")")


def contrib(spark, sf):
    f, fid = spread(v.flows(spark, sf)), F.col("flow_id")
    phi = F.array(*[((fid * (7 + 6 * i) + i * 13) % 101 - 60) / 100 for i in range(len(FEATS))])
    vals = F.array("sbytes", "dbytes", "dur", "Spkts", F.col("sbytes") / F.col("Spkts"), F.lit(0.0), F.lit(0.8), F.lit(1.0))
    d = f.select("*", phi.alias("phi"), vals.alias("vals"), (fid % 3 == 0).cast("double").alias("ioc_dst_match"), F.lit(0.0).alias("ioc_src_match"),
                 F.lit(0.25).alias("feed_age_score"), F.lit(0.8).alias("feed_confidence"), F.lit(2.0).alias("source_count"))
    return d.withColumn("contribs", ex.contributions(FEATS, "vals", "phi"))


@query("reason_topk", v.cte("contrib") + """
select flow_id, string_agg(feature, ',' order by r) as top from (
 select *, row_number() over (partition by flow_id order by shap desc, pos) as r from contrib where shap > 0) where r <= 3 group by 1""")
def reason_topk(spark, sf):
    t = contrib(spark, sf).select("flow_id", F.array_join(F.transform(ex.top_positive("contribs"), lambda e: e["feature"]), ",").alias("top"))
    return t.where(F.col("top") != "")


_TAC = "case feature " + " ".join(f"when '{f}' then '{v.attack_of(f)[0]}'" for f in FEATS) + " end"


@query("reason_codes", v.cte("contrib") + f""",
r as (select *, row_number() over (partition by flow_id order by shap desc, pos) as r from contrib where shap > 0),
t as (select flow_id, string_agg(feature || '/' || printf('%.2f', shap) || '/' || {_TAC}, ';' order by r) as codes,
 bool_or(feature in ('feed_confidence', 'ioc_dst_match')) as named from r where r <= 3 group by 1)
select f.flow_id, case when f.flow_id % 3 = 0 and not coalesce(named, false) then coalesce(codes || ';', '') ||
  'ioc_dst_match/-/Command and Control/destination IP is on the live CTI feed (freshness 0.25, confidence 0.80, 2 source(s))'
 when codes is null then '-/0.00/Uncategorised' else codes end as codes from flows f left join t using (flow_id)""")
def reason_codes(spark, sf):
    r = ex.reason_codes(contrib(spark, sf))
    one = F.transform("reasons", lambda e: F.concat_ws(
        "/", e["feature"], F.when(e["shap"].isNull(), "-").otherwise(F.format_string("%.2f", e["shap"])), e["tactic"],
        F.when(e["shap"].isNull(), e["reason"])))
    return r.select("flow_id", F.array_join(one, ";").alias("codes"))


v.CTES["strength"] = (("contrib",), "select cast(1 + flow_id % 5 as int) as fold, feature, avg(abs(shap)) as strength from contrib group by 1, 2")
v.CTES["dist"] = (("strength",), f"""
select fold, {_TAC} as tactic, sum(strength) / sum(sum(strength)) over (partition by fold) as share from strength group by 1, 2""")


def _strength(spark, sf):
    c = contrib(spark, sf).withColumn("fold", (1 + F.col("flow_id") % 5).cast("int"))
    return ex.strength(c, FEATS, "phi", ["fold"])


@query("shap_strength", v.cte("strength") + "select fold, feature, round(strength, 8) as strength from strength")
def shap_strength(spark, sf):
    return rounded(_strength(spark, sf), "strength", digits=8)


_TOP = "select fold, list(feature order by strength desc, feature)[1:{k}] as top from strength group by 1"


@query("shap_top10", v.cte("strength") + "select fold, array_to_string(list(feature order by strength desc, feature)[1:10], ',') as top from strength group by 1")
def shap_top10(spark, sf):
    return ex.top_features(_strength(spark, sf), 10).select("fold", F.array_join("top", ",").alias("top"))


@query("shap_tactics", v.cte("dist") + "select fold, tactic, round(share, 8) as share from dist")
def shap_tactics(spark, sf):
    return rounded(ex.tactic_distribution(_strength(spark, sf)), "share", digits=8)


_JAC = "len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top)))"


@query("stab_pairs", v.cte("strength") + f", t as ({_TOP.format(k=3)}) select a.fold as a, b.fold as b, round({_JAC}, 8) as jaccard from t a join t b on a.fold < b.fold")
def stab_pairs(spark, sf):
    p = ex.fold_pairs(ex.top_features(_strength(spark, sf), 3))
    return p.select("a", "b", F.round(ex.jaccard(F.col("ta"), F.col("tb")), 8).alias("jaccard"))


@query("stab_jaccard", v.cte("strength") + f", t as ({_TOP.format(k=3)}) select round(avg({_JAC}), 8) as mean, round(min({_JAC}), 8) as min, count(*) as pairs from t a join t b on a.fold < b.fold")
def stab_jaccard(spark, sf):
    return rounded(ex.top_k_jaccard(ex.top_features(_strength(spark, sf), 3)), "mean", "min", digits=8)


@query("stab_tv", v.cte("dist") + f""",
t as (select fold, list(tactic order by share desc, tactic)[1:4] as top from dist group by 1),
x as (select a.fold as a, b.fold as b, sum(abs(a.share - b.share)) / 2 as tv from dist a join dist b on a.tactic = b.tactic and a.fold < b.fold group by 1, 2)
select round((select avg(tv) from x), 8) as mean_tv_distance, round((select avg({_JAC}) from t a join t b on a.fold < b.fold), 8) as mean_top4_jaccard""")
def stab_tv(spark, sf):
    return rounded(ex.tactic_stability(ex.tactic_distribution(_strength(spark, sf))), "mean_tv_distance", "mean_top4_jaccard", digits=8)


@query("stab_mean_dist", v.cte("dist") + "select tactic, round(sum(share) / 5, 8) as share from dist group by 1")
def stab_mean_dist(spark, sf):
    return rounded(ex.mean_distribution(ex.tactic_distribution(_strength(spark, sf))), "share", digits=8)


_CTI = "('ioc_src_match', 'ioc_dst_match', 'feed_age_score', 'feed_confidence', 'source_count', 'reputation_bucket')"


@query("reason_audit", v.cte("alerts") + f"""
select 'tactic' as kind, tactic as name, count(*)::double as value from (select unnest(reasons).tactic as tactic from alerts) group by 2
union all select 'share', 'with_cti', round(avg(case when reasons[1].feature in {_CTI} or reasons[2].feature in {_CTI} or reasons[3].feature in {_CTI} then 1 else 0 end), 8) from alerts""")
def reason_audit(spark, sf):
    tactics, share = ex.reason_audit(v.alerts(spark, sf))
    return tactics.select(F.lit("tactic").alias("kind"), F.col("tactic").alias("name"), F.col("n").cast("double").alias("value")).unionByName(
        share.select(F.lit("share").alias("kind"), F.lit("with_cti").alias("name"), F.round("share", 8).alias("value")))
