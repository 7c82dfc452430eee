"""Alert records and the operational summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASON = "struct<feature:string,value:double,shap:double,reason:string,tactic:string,technique:string>"
CANDIDATE = ("struct<id:string,name:string,mitre_id:string,origin:string,score:double,retrieval:double,"
             "tech_overlap:double,technique_hits:array<string>>")
ALERT = f"""alert_id string, emitted_at string, model struct<profile:string,theta:double,trained_at:string>,
 flow struct<ts:double,src_ip:string,dst_ip:string,src_port:int,dst_port:int,proto:string,dur:double,sbytes:double,
 dbytes:double>, score double, cti struct<ioc_src_match:double,ioc_dst_match:double,feed_age_score:double,
 feed_confidence:double,source_count:int>, reasons array<{REASON}>,
 attribution struct<verdict:string,notify:boolean,confidence:double,category:string,
 actor:struct<id:string,name:string,mitre_id:string,origin:string,score:double,retrieval:double,tech_overlap:double,
 technique_hits:array<string>,confidence:double,ambiguous:boolean>,candidates:array<{CANDIDATE}>,competitors:int,
 techniques:array<string>,ioc_backed:boolean,evidence:array<string>>"""


def over_threshold(scored: DataFrame, theta) -> DataFrame:
    return scored.where(F.col("score") >= theta)


def assemble(rows: DataFrame, profile: str, theta: float, trained_at: str, emitted_at, run_id: str) -> DataFrame:
    """Scored, explained flows to alert records, rounded half-even as the record format asks.

    The id is built from the flow, not from a batch position, so a replayed batch repeats its ids.
    """
    def num(c):
        return F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(0.0))

    emitted = emitted_at if isinstance(emitted_at, Column) else F.lit(emitted_at)
    return rows.select(
        F.concat_ws("-", F.lit(run_id), F.col("flow_id").cast("string")).alias("alert_id"),
        emitted.alias("emitted_at"),
        F.struct(F.lit(profile).alias("profile"), F.bround(F.lit(float(theta)), 4).alias("theta"),
                 F.lit(trained_at).alias("trained_at")).alias("model"),
        F.struct(num("ts").alias("ts"), "src_ip", "dst_ip", num("src_port").cast("int").alias("src_port"),
                 num("dst_port").cast("int").alias("dst_port"), "proto", num("dur").alias("dur"),
                 num("sbytes").alias("sbytes"), num("dbytes").alias("dbytes")).alias("flow"),
        F.bround("score", 4).alias("score"),
        F.struct(num("ioc_src_match").alias("ioc_src_match"), num("ioc_dst_match").alias("ioc_dst_match"),
                 F.bround(num("feed_age_score"), 4).alias("feed_age_score"),
                 F.bround(num("feed_confidence"), 4).alias("feed_confidence"),
                 num("source_count").cast("int").alias("source_count")).alias("cti"),
        "reasons", *([F.col("attribution")] if "attribution" in rows.columns else []),
    )


def ioc_hit() -> Column:
    return (F.coalesce("cti.ioc_src_match", F.lit(0.0)) > 0) | (F.coalesce("cti.ioc_dst_match", F.lit(0.0)) > 0)


def notified() -> Column:
    return F.coalesce("attribution.notify", F.lit(False))


def _ts() -> Column:
    return F.coalesce("flow.ts", F.lit(0.0))


def _proto() -> Column:
    return F.lower(F.coalesce(F.nullif("flow.proto", F.lit("")), F.lit("?")))


def lead_tactic() -> Column:
    """Tactic of the first reason that is not an indicator flag, else of the first reason."""
    named = F.filter("reasons", lambda r: (r["feature"] != "") & ~r["feature"].startswith("ioc_"))
    first = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at("reasons", F.lit(1)))
    return F.nullif(first["tactic"], F.lit(""))


def facet_filter(
    alerts: DataFrame, proto: str | None = None, minute: int | None = None, score: tuple[float, float] | None = None,
    ioc: bool = False, notified_only: bool = False, recent_at=None, text: str | None = None,
) -> DataFrame:
    """Conjunction of the given facets; score bands are half open, text matches anywhere in the record."""
    cond = F.lit(True)
    if proto:
        cond &= F.lower(F.coalesce("flow.proto", F.lit(""))) == proto
    if minute is not None:
        cond &= F.floor(_ts() / 60) == minute
    if score:
        cond &= (F.col("score") >= score[0]) & (F.col("score") < score[1])
    if ioc:
        cond &= ioc_hit()
    if notified_only:
        cond &= notified()
    if recent_at is not None:
        cond &= (recent_at if isinstance(recent_at, Column) else F.lit(float(recent_at))) - _ts() <= 300
    if text and text.strip():
        record = F.to_json(F.struct(*[F.col(c) for c in alerts.columns]))
        cond &= F.lower(record).contains(text.strip().lower())
    return alerts.where(cond)


def match_count(alerts: DataFrame, **facets) -> DataFrame:
    return facet_filter(alerts, **facets).agg(F.count(F.lit(1)).alias("n"))


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def latest(alerts: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """Newest ``limit`` alerts, each id once with its newest record."""
    fields = F.struct(*[F.col(c) for c in alerts.columns])
    one = alerts.groupBy("alert_id").agg(F.max_by(fields, order).alias("a")).select("a.*")
    return one.orderBy(F.col(order).desc(), "alert_id").limit(limit)


def audit_rows(alerts: DataFrame) -> DataFrame:
    """One audit event per notified alert."""
    return alerts.where(notified()).select(
        F.col("emitted_at").alias("ts"), F.lit("apt_notify").alias("event"),
        F.create_map(
            F.lit("alert_id"), F.col("alert_id"), F.lit("actor"), F.coalesce("attribution.actor.name", F.lit("")),
            F.lit("mitre_id"), F.coalesce("attribution.actor.mitre_id", F.lit("")),
            F.lit("confidence"), F.coalesce("attribution.confidence", F.lit(0.0)).cast("string")).alias("fields"))


# ------------------------------------------------------------------ summaries
def kpis(alerts: DataFrame, now: Column) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(ioc_hit()).alias("ioc_hits"),
        F.count_if(now - _ts() <= 300).alias("recent"), F.count_if(notified()).alias("notified"))


def _bins(alerts: DataFrame, now: Column, n: int) -> DataFrame:
    """Alerts of the last ``n`` minutes with their minute; pushes down to a range on time."""
    first = F.floor(now / 60) - (n - 1)
    return alerts.where((_ts() >= first * 60) & (_ts() < (first + n) * 60)).withColumn("minute", F.floor(_ts() / 60))


def timeline(alerts: DataFrame, now: Column, n: int = 15) -> DataFrame:
    """Alerts per minute, zero-filled, with indicator hits and the leading protocol and tactic."""
    b = _bins(alerts, now, n).select("minute", ioc_hit().alias("hit"), _proto().alias("proto"), lead_tactic().alias("tactic"))
    count = b.groupBy("minute").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("ioc"))

    def lead(c):
        per = b.where(F.col(c).isNotNull()).groupBy("minute", c).agg(F.count(F.lit(1)).alias("k"))
        return per.groupBy("minute").agg(F.min_by(c, F.struct((-F.col("k")).alias("k"), F.col(c).alias("v"))).alias(f"lead_{c}"))

    spark = alerts.sparkSession
    first = F.floor(now / 60) - (n - 1)
    grid = spark.range(n).select((first + F.col("id")).alias("minute"))
    return (grid.join(count, "minute", "left").join(lead("proto"), "minute", "left").join(lead("tactic"), "minute", "left")
            .select("minute", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ioc", F.lit(0)).alias("ioc"), "lead_proto", "lead_tactic"))


def velocity(alerts: DataFrame, now: Column) -> DataFrame:
    """Last five minutes against the 15-minute average, and against the whole session."""
    first = F.floor(now / 60) - 14
    a = alerts.select(_ts().alias("ts"), F.floor(_ts() / 60).alias("minute"))
    s = a.agg(F.count_if(now - F.col("ts") <= 300).alias("recent"),
              F.count_if((F.col("minute") >= first) & (F.col("minute") < first + 15)).alias("sum15"),
              F.count(F.lit(1)).alias("total"), F.count_distinct("minute").alias("minutes"))
    return s.select(
        "recent", "sum15", F.try_divide(F.col("recent"), F.col("sum15") / 3).alias("vs_15min"),
        F.try_divide(F.col("recent") / 5, F.try_divide(F.col("total"), F.col("minutes"))).alias("vs_session"))


def minute_burst(alerts: DataFrame, now: Column, n: int = 15) -> DataFrame:
    """Each minute against the average of the window."""
    t = timeline(alerts, now, n).select("minute", "n")
    avg = t.agg(F.avg("n")).scalar()
    return t.select("minute", "n", F.coalesce(F.try_divide(F.col("n"), avg), F.lit(0.0)).alias("factor"))


def score_histogram(alerts: DataFrame, theta: float, bands: int = 5) -> DataFrame:
    """Equal bands from theta to 1; the last one is closed."""
    step = (1 - theta) / bands
    band = F.least(F.lit(bands - 1), F.floor((F.col("score") - theta) / step)).cast("int")
    counts = alerts.where(F.col("score") >= theta).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    grid = alerts.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    return grid.join(counts, "band", "left").select(
        "band", (F.lit(theta) + F.col("band") * step).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def protocol_mix(alerts: DataFrame) -> DataFrame:
    per = alerts.groupBy(_proto().alias("proto")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / per.agg(F.sum("n")).scalar())


def top_tactics(alerts: DataFrame, k: int = 6) -> DataFrame:
    per = alerts.groupBy(lead_tactic().alias("tactic")).agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("tactic").isNotNull()).orderBy(F.col("n").desc(), "tactic").limit(k)


def top_targets(alerts: DataFrame, k: int = 6) -> DataFrame:
    """Most alerted destinations: indicator flag, time span, leading ports and protocols."""
    a = alerts.where(F.coalesce("flow.dst_ip", F.lit("")) != "").select(
        F.col("flow.dst_ip").alias("dst_ip"), "flow.dst_port", _proto().alias("proto"), _ts().alias("ts"), ioc_hit().alias("hit"))
    top = a.groupBy("dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("ioc"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ).orderBy(F.col("n").desc(), "dst_ip").limit(k)
    chosen = a.join(F.broadcast(top.select("dst_ip")), "dst_ip", "left_semi")  # k rows

    def leading(c, n):
        per = chosen.groupBy("dst_ip", F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("k"))
        w = Window.partitionBy("dst_ip").orderBy(F.col("k").desc(), "v")  # distinct values of at most k targets
        return per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("dst_ip").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "v", "k"))),
                                     lambda e: F.concat(e["v"], F.lit(" ("), e["k"], F.lit(")"))), ", ").alias(f"top_{c}"))

    return top.join(leading("dst_port", 3), "dst_ip").join(leading("proto", 3), "dst_ip")


def actor_groups(alerts: DataFrame) -> DataFrame:
    """Per actor: notified and candidate alerts, mean confidence and indicator backing of the notified ones."""
    a = alerts.where(F.col("attribution.actor").isNotNull())
    n = notified()
    out = a.groupBy(F.col("attribution.actor.name").alias("actor")).agg(
        F.count_if(n).alias("notified"), F.count_if(~n & (F.col("attribution.verdict") == "apt-candidate")).alias("candidates"),
        F.coalesce(F.avg(F.when(n, F.coalesce("attribution.confidence", F.lit(0.0)))), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(n & F.col("attribution.ioc_backed")).alias("ioc_backed"))
    return out.where((F.col("notified") > 0) | (F.col("candidates") > 0))


def verdict_tally(alerts: DataFrame) -> DataFrame:
    tier = F.when(notified(), "notified").when(F.col("attribution.verdict") == "apt-candidate", "candidate").otherwise("not-apt")
    return alerts.where(F.col("attribution").isNotNull()).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def batch_numbers(flows: DataFrame, size: int, theta: float, warmup: int, window: int | None = None, order_key: str = "flow_id") -> DataFrame:
    """Time-ordered batches of ``size`` rows: all of them, or those of a ``window`` of rows that shifts to the first alert when it
    holds none.

    Warm-up batches and a ragged tail under half a batch are left out. Ranks are exact and distributed.
    """
    from .ranks import RANGE, ranked, with_ranges

    slotted = with_ranges(flows.withColumn("_all", F.lit(1)), "ts")
    r = ranked(slotted, ["_all"], RANGE, [F.col("ts"), F.col(order_key)], "_r").withColumn("_r", F.col("_r") - 1)
    if window is None:
        w = r.withColumn("_p", F.col("_r"))
    else:
        first_alert = r.where(F.col("score") >= theta).agg(F.min("_r")).scalar()
        start = F.when(F.coalesce(first_alert, F.lit(0)) < window, 0).otherwise(first_alert)
        w = r.withColumn("_p", F.col("_r") - start).where((F.col("_p") >= 0) & (F.col("_p") < window))
    w = w.withColumn("batch", F.floor(F.col("_p") / size))
    fill = w.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") >= theta).alias("alerts"),
                                  F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return fill.where((F.col("batch") >= warmup) & (F.col("rows") >= size // 2))
