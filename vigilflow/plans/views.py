"""Flow, indicator, alert and actor views over the given tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

THETA = 0.85

# ------------------------------------------------------------------- flows
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(*names: str) -> str:
    """``with ...`` clause holding the named views and whatever they build on, in order."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in done) + "\n"


CTES["flows"] = ((), """
select event_id as flow_id,
 '10.0.' || (user_id // 256) || '.' || (user_id % 256) as src_ip,
 '172.16.' || (((event_id*31) % 97) // 256) || '.' || (((event_id*31) % 97) % 256) as dst_ip,
 cast(1024 + event_id % 60000 as int) as src_port,
 cast(case event_id % 5 when 0 then 53 when 1 then 80 when 2 then 443 when 3 then 22 else 4444 end as int) as dst_port,
 case event_id % 4 when 0 then 'udp' when 1 then 'icmp' else 'tcp' end as proto,
 cast(epoch_us(ts) // 1000000 as double) as ts,
 value / 100 as dur, floor(value * 10) as sbytes, floor(value * 3) as dbytes,
 cast(1 + event_id % 20 as double) as Spkts, cast(event_id % 7 as double) as Dpkts,
 case event_type when 'view' then 'http' when 'click' then 'dns' when 'purchase' then 'ssh' else '-' end as service,
 case event_id % 3 when 0 then 'FIN' when 1 then 'CON' else 'INT' end as state,
 cast(case when event_type = 'error' then 1 else 0 end as int) as label,
 case when event_type = 'error' then 'Generic' else 'Normal' end as attack_cat
from events""")


def _pick(c, pairs: dict, default):
    out = None
    for k, v in pairs.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One network flow per event."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    dst = (eid * 31) % 97
    return e.select(
        eid.alias("flow_id"),
        F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256).alias("src_ip"),
        F.concat(F.lit("172.16."), F.floor(dst / 256), F.lit("."), dst % 256).alias("dst_ip"),
        (1024 + eid % 60000).cast("int").alias("src_port"),
        _pick(eid % 5, {0: 53, 1: 80, 2: 443, 3: 22}, 4444).cast("int").alias("dst_port"),
        _pick(eid % 4, {0: "udp", 1: "icmp"}, "tcp").alias("proto"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("ts"),
        (F.col("value") / 100).alias("dur"),
        F.floor(F.col("value") * 10).cast("double").alias("sbytes"),
        F.floor(F.col("value") * 3).cast("double").alias("dbytes"),
        (1 + eid % 20).cast("double").alias("Spkts"),
        (eid % 7).cast("double").alias("Dpkts"),
        _pick(F.col("event_type"), {"view": "http", "click": "dns", "purchase": "ssh"}, "-").alias("service"),
        _pick(eid % 3, {0: "FIN", 1: "CON"}, "INT").alias("state"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.when(F.col("event_type") == "error", "Generic").otherwise("Normal").alias("attack_cat"),
    )


# -------------------------------------------------------------- indicators
CTES["iocs"] = (("flows",), """
select case when flow_id % 2 = 0 then dst_ip else src_ip end as value, 'ipv4' as ioc_type,
 case flow_id % 3 when 0 then 'feodo' when 1 then 'cins' else 'blocklist' end as source,
 'live' as provenance, ts - 3600 as first_seen, ts as last_seen,
 cast(0.5 + (flow_id % 5) * 0.1 as double) as confidence,
 case when flow_id % 4 = 0 then '' else 'tag' || (flow_id % 9) end as tags,
 cast(1 + flow_id % 3 as int) as sightings, flow_id as seq
from flows where label = 1 and sbytes > 400""")


def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator rows of three feeds, taken from the larger malicious flows."""
    fid = F.col("flow_id")
    return flows(spark, sf_dir).where((F.col("label") == 1) & (F.col("sbytes") > 400)).select(
        F.when(fid % 2 == 0, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("value"),
        F.lit("ipv4").alias("ioc_type"),
        _pick(fid % 3, {0: "feodo", 1: "cins"}, "blocklist").alias("source"),
        F.lit("live").alias("provenance"),
        (F.col("ts") - 3600).alias("first_seen"), F.col("ts").alias("last_seen"),
        (F.lit(0.5) + (fid % 5) * F.lit(0.1)).alias("confidence"),
        F.when(fid % 4 == 0, "").otherwise(F.concat(F.lit("tag"), fid % 9)).alias("tags"),
        (1 + fid % 3).cast("int").alias("sightings"), fid.alias("seq"),
    )


def start(df: DataFrame) -> float:
    """Replay start: the smallest flow time (one number)."""
    return float(df.agg(F.min("ts")).first()[0])


CTES["t0"] = (("flows",), "select min(ts) as t0 from flows")


# ------------------------------------------------------------ scored flows
CTES["scored"] = (("flows",), "select flow_id, ts, label, proto, sbytes / 5000 as score, cast(1 + flow_id % 5 as int) as fold from flows")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a score that has many ties."""
    return flows(spark, sf_dir).select(
        "flow_id", "ts", "label", "proto", (F.col("sbytes") / 5000).alias("score"), (1 + F.col("flow_id") % 5).cast("int").alias("fold"))


# ------------------------------------------------------------------ alerts
REASON_FEATURES = ("ioc_dst_match", "Dload", "mean_pkt_size", "dmeansz", "service_http", "state_FIN", "dur", "sttl",
                   "feed_confidence", "proto_tcp", "ct_srv_src", "byte_rate")


def attack_of(name: str) -> tuple[str, str]:
    import re

    from ..functions.attack import RULES, UNCATEGORISED

    for pattern, tactic, technique in RULES:
        if re.search(pattern, name):
            return tactic, technique
    return UNCATEGORISED


def _reason_list_sql() -> str:
    rows = []
    for f in REASON_FEATURES:
        tac, tech = attack_of(f)
        rows.append(f"{{'feature': '{f}', 'tactic': '{tac}', 'technique': '{tech}'}}")
    return "[" + ", ".join(rows) + "]"


CTES["alerts"] = (("flows",), f"""
select 'r1-' || flow_id as alert_id, flow_id, ts, src_ip, dst_ip, dst_port, proto, score, src_hit, dst_hit,
 case when src_hit + dst_hit > 0 then 0.5 + (flow_id % 5) * 0.1 else 0 end as feed_confidence,
 cast(case when src_hit + dst_hit > 0 then 1 + flow_id % 3 else 0 end as int) as source_count,
 [r[1 + flow_id % 12], r[1 + (flow_id * 5 + 1) % 12], r[1 + (flow_id * 7 + 3) % 12]] as reasons,
 case when src_hit + dst_hit > 0 and flow_id % 3 = 0 then 'apt-attributed' when src_hit + dst_hit > 0 then 'apt-candidate'
  else 'not-apt' end as verdict, src_hit + dst_hit > 0 and flow_id % 3 = 0 as notify,
 case when src_hit + dst_hit > 0 then 'Actor ' || (flow_id % 13) end as actor, 0.3 + score / 2 as confidence
from (select *, round(0.6 + 0.4 * (sbytes / (sbytes + 200)), 4) as score, {_reason_list_sql()} as r,
 case when label = 1 and flow_id % 2 = 0 then 1 else 0 end as dst_hit,
 case when label = 1 and flow_id % 2 = 1 and flow_id % 3 = 0 then 1 else 0 end as src_hit from flows)
where score >= {THETA}""")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert records of the flows that score over the threshold."""
    return alerts_of(flows(spark, sf_dir))


def alerts_of(flow_rows: DataFrame) -> DataFrame:
    """Alert records of flow rows, also of a micro-batch of them."""
    fid = F.col("flow_id")
    refs = {f: attack_of(f) for f in REASON_FEATURES}
    pool = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.lit(1.0).alias("value"), F.lit(0.1).alias("shap"), F.lit(f"{f} = 1").alias("reason"),
        F.lit(refs[f][0]).alias("tactic"), F.lit(refs[f][1]).alias("technique")) for f in REASON_FEATURES])
    f = flow_rows.withColumns({
        "score": F.round(F.lit(0.6) + F.lit(0.4) * (F.col("sbytes") / (F.col("sbytes") + 200)), 4),
        "dst_hit": ((F.col("label") == 1) & (fid % 2 == 0)).cast("int"),
        "src_hit": ((F.col("label") == 1) & (fid % 2 == 1) & (fid % 3 == 0)).cast("int"),
    }).where(F.col("score") >= THETA)
    hit = (F.col("src_hit") + F.col("dst_hit")) > 0

    def pick(i):
        return F.get(F.col("_pool"), (i % 12).cast("int"))

    conf = F.lit(0.3) + F.col("score") / 2
    null = F.lit(None)
    return f.withColumn("_pool", pool).select(
        F.concat(F.lit("r1-"), fid).alias("alert_id"), F.lit("2024-02-01T00:00:00+00:00").alias("emitted_at"),
        F.struct(F.lit("live_netflow").alias("profile"), F.lit(THETA).alias("theta"), F.lit("").alias("trained_at")).alias("model"),
        F.struct("ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "dur", "sbytes", "dbytes").alias("flow"), "score",
        F.struct(F.col("src_hit").cast("double").alias("ioc_src_match"), F.col("dst_hit").cast("double").alias("ioc_dst_match"),
                 F.when(hit, 0.5).otherwise(0.0).alias("feed_age_score"),
                 F.when(hit, F.lit(0.5) + (fid % 5) * F.lit(0.1)).otherwise(0.0).alias("feed_confidence"),
                 F.when(hit, 1 + fid % 3).otherwise(0).cast("int").alias("source_count")).alias("cti"),
        F.array(pick(fid), pick(fid * 5 + 1), pick(fid * 7 + 3)).alias("reasons"),
        F.struct(
            F.when(hit & (fid % 3 == 0), "apt-attributed").when(hit, "apt-candidate").otherwise("not-apt").alias("verdict"),
            (hit & (fid % 3 == 0)).alias("notify"), conf.alias("confidence"), null.cast("string").alias("category"),
            F.when(hit, F.struct(F.concat(F.lit("Actor "), fid % 13).alias("name"), F.lit("G0001").alias("mitre_id"))).alias("actor"),
            hit.alias("ioc_backed")).alias("attribution"),
        fid.alias("seq"),
    )


# ------------------------------------------------------------------ actors
TECHNIQUES = ("T1071", "T1571", "T1041", "T1090", "T1046", "T1021", "T1027", "T1190", "T1110", "T1562", "T1095", "T1005")
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "this", "that", "an", "or", "are",
              "from", "at", "be", "was", "over")

CTES["actors"] = ((), f"""
select cast(doc_id as varchar) as id, 'Actor ' || doc_id as name, 'G' || lpad(cast(doc_id % 10000 as varchar), 4, '0') as mitre_id,
 lang as origin, source as sector, 'Alias ' || (doc_id % 37) as alias, text as summary,
 list_filter([{", ".join(f"case when (doc_id * {2 * i + 3} + {i}) % 5 = 0 then '{t}' end" for i, t in enumerate(TECHNIQUES))},
  case when doc_id % 2 = 0 then 'T1071.001' end], lambda x: x is not null) as techniques
from documents""")


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One actor per document; the text is its summary."""
    d, did = table(spark, sf_dir, "documents"), F.col("doc_id")
    ts = [F.when((did * (2 * i + 3) + i) % 5 == 0, t) for i, t in enumerate(TECHNIQUES)]
    ts.append(F.when(did % 2 == 0, "T1071.001"))
    return d.select(
        did.cast("string").alias("id"), F.concat(F.lit("Actor "), did).alias("name"),
        F.concat(F.lit("G"), F.lpad((did % 10000).cast("string"), 4, "0")).alias("mitre_id"), F.col("lang").alias("origin"),
        F.lit("").alias("sponsor"), F.array("source").alias("sectors"), F.array(F.concat(F.lit("Alias "), did % 37)).alias("aliases"),
        F.col("text").alias("summary"), F.filter(F.array(*ts), lambda x: x.isNotNull()).alias("techniques"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def counts_cte(name: str, source: str, key: str) -> str:
    """(key, term, tf) over words and bigrams of ``source.text``."""
    return f"""{name} as (select {key}, term, count(*) as tf from (select {key}, unnest(list_concat(w,
 [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from (select {key}, list_filter(
 regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({_STOP})) as w from {source})) group by 1, 2)"""


CTES["docs"] = (("actors",), """
select id, trim(regexp_replace(concat_ws(' ', name, alias, origin, sector, nullif(summary, ''), nullif(array_to_string(techniques, ' '), '')), '\\s+', ' ', 'g')) as text
from actors""")
CTES["counts"] = (("docs",), counts_cte("x", "docs", "id")[len("x as ("):-1])
CTES["terms"] = (("counts",), """
select term, ln((1 + (select count(*) from docs)) / (1 + count(*))) + 1 as idf from counts group by term""")
CTES["postings"] = (("terms",), """
select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from (
 select id, term, (1 + ln(tf)) * idf as w from counts join terms using (term))""")
