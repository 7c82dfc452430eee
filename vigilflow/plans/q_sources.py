"""Reader, feed, knowledge-base and sink queries; raw text is formatted by Spark from the given tables."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..sources import feeds, flows as fl, sinks
from ..session import shared_dir, spread
from ..streaming import scoring as st
from . import views as v
from .registry import query, table


def _dir(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("src_sightings", v.cte("flows") + "select src_ip, dst_ip, ts, cast(label as tinyint) as label from flows")
def src_sightings(spark, sf):
    return fl.sighting_frame(v.flows(spark, sf))


@query("src_dataset", v.cte("flows") + """
select 'unsw_nb15' as dataset, count(*) as n, sum(label) as positives from flows""")
def src_dataset(spark, sf):
    return fl.finish_dataset(v.flows(spark, sf), "unsw_nb15").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


_UNSW = {"srcip": "src_ip", "sport": "src_port", "dstip": "dst_ip", "dsport": "dst_port", "proto": "proto",
         "state": "state", "dur": "dur", "sbytes": "sbytes", "dbytes": "dbytes", "service": "service",
         "Spkts": "Spkts", "Dpkts": "Dpkts", "Stime": "ts", "attack_cat": "attack_cat", "label": "label"}


@query("src_unsw_flows", v.cte("flows") + """
select flow_id, src_ip, cast(src_port as double) as src_port, proto, ts, cast(label as tinyint) as label, attack_cat,
 sbytes, service, case when flow_id % 7 = 0 then null else cast(flow_id % 250 as double) end as sttl from flows""")
def src_unsw_flows(spark, sf):
    """49 positional text columns, padded with blanks, with missing and broken numbers."""
    f, fid = v.flows(spark, sf), F.col("flow_id")
    raw = f.select(*[
        F.when(fid % 7 == 0, " ").otherwise((fid % 250).cast("string")).alias(c) if c == "sttl"
        else F.concat(F.lit(" "), F.col(_UNSW[c]).cast("string"), F.lit(" ")).alias(c) if c in _UNSW
        else fid.cast("string").alias(c) if c == "stcpb" else F.lit("x").alias(c)
        for c in fl.UNSW_COLUMNS])
    raw = raw.withColumn("attack_cat", F.when(F.trim("attack_cat") != "Normal", F.col("attack_cat")))
    return fl.parse_unsw(raw).select(
        F.col("stcpb").cast("bigint").alias("flow_id"), "src_ip", "src_port", "proto", "ts", "label", "attack_cat",
        "sbytes", "service", "sttl")


_CIC_TIME = """case flow_id % 3 when 0 then strftime(make_timestamp(cast(ts*1000000 as bigint)), '%d/%m/%Y %H:%M:%S')
 when 1 then strftime(make_timestamp(cast(ts*1000000 as bigint)), '%d/%m/%Y %H:%M') else 'bad' end"""


@query("src_cic_flows", v.cte("flows") + """
select flow_id, src_ip, case proto when 'tcp' then '6' when 'udp' then '17' else '1' end as proto,
 case flow_id % 3 when 0 then ts else floor(ts / 60) * 60 end as ts,
 cast(label as tinyint) as label, case when label = 1 then 'DoS Hulk' else 'Normal' end as attack_cat,
 round(dur * 1e6, 3) as duration_us from flows where flow_id % 3 <> 2""")
def src_cic_flows(spark, sf):
    f, fid = v.flows(spark, sf), F.col("flow_id")
    t = F.timestamp_seconds("ts")
    when = F.when(fid % 3 == 0, F.date_format(t, "d/M/yyyy HH:mm:ss")).when(
        fid % 3 == 1, F.date_format(t, "d/M/yyyy HH:mm")).otherwise("bad")
    raw = f.select(
        F.col("src_ip").alias(" Source IP"), F.col("dst_ip").alias("Destination IP "), F.col("src_port").cast("string").alias("Source Port"),
        F.col("dst_port").cast("string").alias("Destination Port"),
        v._pick(F.col("proto"), {"tcp": "6", "udp": "17"}, "1").alias(" Protocol"), when.alias("Timestamp"),
        F.when(F.col("label") == 1, " DoS Hulk ").when(fid % 2 == 0, "BENIGN").alias("Label"),
        fid.cast("string").alias("Row No."), (F.col("dur") * 1e6).cast("string").alias(" Flow Duration"),
        F.lit("text").alias("External"), F.concat(F.lit("f"), fid).alias("Flow ID"))
    out = fl.parse_cic(raw)
    return out.select(F.col("`Row No.`").cast("bigint").alias("flow_id"), "src_ip", "proto", "ts", "label", "attack_cat",
                      F.round("`Flow Duration`", 3).alias("duration_us"))


@query("src_cached_flows", v.cte("flows") + "select proto, count(*) as n from flows group by 1")
def src_cached_flows(spark, sf):
    """Written once under a parameter-keyed path, then read back."""
    path = _dir(spark, "flows_rows0_seed42")
    fl.cached(spark, path, lambda: v.flows(spark, sf))
    return fl.cached(spark, path, lambda: v.flows(spark, sf)).groupBy("proto").agg(F.count(F.lit(1)).alias("n"))


NATIVE_SQL = """
select flow_id, src_ip, dst_ip, src_port, dst_port, {proto} as proto, ts, {dur} as dur, {sb} as sbytes, {db} as dbytes,
 {sp} as Spkts, {dp} as Dpkts, round({sb} * 8 / greatest({dur}, 1e-6), 3) as Sload, round({db} * 8 / greatest({dur}, 1e-6), 3) as Dload,
 round(case when {sp} > 0 then {sb} / {sp} end, 6) as smeansz, round(case when {dp} > 0 then {db} / {dp} end, 6) as dmeansz,
 {service} as service, {state} as state from flows {where}"""


def native_sql(**kw):
    base = dict(proto="proto", dur="round(dur, 4)", sb="sbytes", db="dbytes", sp="Spkts", dp="Dpkts", service="service",
                state="state", where="")
    return v.cte("flows") + NATIVE_SQL.format(**{**base, **kw})


def native(df):
    return df.select("flow_id", *[F.round(c, 3 if c.endswith("load") else 6).alias(c) if c in
                                  ("Sload", "Dload", "smeansz", "dmeansz", "dur") else F.col(c) for c in fl.NATIVE])


@query("src_jsonl_flows", native_sql(
    proto="case when flow_id % 3 = 0 then 'tcp' else proto end",
    service="case when flow_id % 3 = 2 then '-' else service end",
    state="case when flow_id % 3 = 1 then 'UNK' else state end",
    where="where flow_id % 4 <> 1 or flow_id % 3 <> 1"))
def src_jsonl_flows(spark, sf):
    """Three spellings of the same record, other key case, numeric and ISO times, broken lines."""
    f, fid = v.flows(spark, sf), F.col("flow_id")
    dur = F.round("dur", 4)
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a = F.to_json(F.struct(fid.alias("flow_id"), "src_ip", "dst_ip", "src_port", "dst_port", F.lit("TCP").alias("proto"), "ts",
                           dur.alias("dur"), "sbytes", "dbytes", "Spkts", "Dpkts", "service", "state"))
    b = F.to_json(F.struct(fid.alias("flow_id"), F.col("src_ip").alias("SrcIP"), F.col("dst_ip").alias("dest_ip"),
                           F.col("src_port").cast("string").alias("sport"), F.col("dst_port").alias("dsport"),
                           F.col("proto").alias("protocol"), iso.alias("timestamp"), dur.alias("duration"),
                           F.col("sbytes").alias("bytes_toserver"), F.col("dbytes").alias("bytes_toclient"),
                           F.col("Spkts").alias("pkts_toserver"), F.col("Dpkts").alias("pkts_toclient"),
                           F.col("service").alias("app_proto"), F.lit("").alias("state")))
    c = F.to_json(F.struct(fid.alias("flow_id"), F.col("src_ip").alias("id.orig_h"), F.col("dst_ip").alias("id.resp_h"),
                           F.col("src_port").alias("sp"), F.col("dst_port").alias("dp"), F.col("proto").alias("PROTO"),
                           F.col("ts").cast("string").alias("start"), dur.cast("string").alias("flow_duration"),
                           F.col("sbytes").alias("src_bytes"), F.col("dbytes").alias("dst_bytes"),
                           F.col("Spkts").alias("orig_pkts"), F.col("Dpkts").alias("resp_pkts"),
                           F.col("state").alias("conn_state")))
    line = F.when(fid % 3 == 0, a).when((fid % 3 == 1) & (fid % 4 == 1), F.lit('{"src_ip": "1.2.3'))
    line = line.when(fid % 3 == 1, b).otherwise(c)
    return native(fl.parse_jsonl(s.pinned(spread(f), line.alias("value"), fid), keep=("flow_id",)))


@query("src_csv_flows", native_sql(service="'-'"))
def src_csv_flows(spark, sf):
    f = v.flows(spark, sf)
    rows = f.select("flow_id", F.col("src_ip").alias("SRC"), F.col("dst_ip").alias("da"), F.col("src_port").cast("string").alias("sport"),
                    F.col("dst_port").cast("string").alias("dp"), F.upper("proto").alias("Protocol"),
                    F.col("ts").cast("string").alias("time"), F.round("dur", 4).cast("string").alias("duration"),
                    F.col("sbytes").cast("string").alias("orig_bytes"), F.col("dbytes").cast("string").alias("resp_bytes"),
                    F.col("Spkts").cast("string").alias("spkts"), F.col("Dpkts").cast("string").alias("dpkts"),
                    F.lit("").alias("service"), F.col("state").alias("status"))
    return native(fl.parse_csv(rows, keep=("flow_id",)))


@query("src_zeek_flows", native_sql(
    service="case service when 'http' then 'http' when 'dns' then 'dns' when 'ssh' then 'ssh' else '-' end",
    state="case state when 'FIN' then 'FIN' when 'CON' then 'CON' else 'UNK' end",
    db="case when flow_id % 5 = 0 then 0 else dbytes end", where="where flow_id % 11 <> 3"))
def src_zeek_flows(spark, sf):
    """Two files with different column orders; comments, dashes, short rows and rows without a source."""
    f, fid = v.flows(spark, sf), F.col("flow_id")
    tab, file = F.lit("\t"), F.when(fid % 2 == 0, "a/conn.log").otherwise("b/conn.log")

    def t(c):
        return c.cast("string")

    src = F.when(fid % 11 == 3, "-").otherwise(F.col("src_ip"))
    dby = F.when(fid % 5 == 0, "-").otherwise(t(F.col("dbytes")))
    svc = F.when(F.col("service") == "-", "tls").otherwise(F.col("service"))
    st = v._pick(F.col("state"), {"FIN": "SF", "CON": "S1"}, "-")
    a = F.concat_ws("\t", t(F.col("ts")), F.lit("C1"), src, t(F.col("src_port")), F.col("dst_ip"), t(F.col("dst_port")),
                    F.col("proto"), svc, t(F.round("dur", 4)), t(F.col("sbytes")), dby, t(F.col("Spkts")), t(F.col("Dpkts")), st)
    b = F.concat_ws("\t", src, F.col("dst_ip"), t(F.col("src_port")), t(F.col("dst_port")), F.upper("proto"), t(F.col("ts")),
                    t(F.col("sbytes")), dby, t(F.round("dur", 4)), t(F.col("Spkts")), t(F.col("Dpkts")), svc, st)
    # a trailing dash column may be missing altogether
    b = F.when(st == "-", F.regexp_replace(b, "\t-$", "")).otherwise(b)
    head = {
        "a/conn.log": "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes "
                      "orig_pkts resp_pkts conn_state",
        "b/conn.log": "id.orig_h id.resp_h id.orig_p id.resp_p proto ts orig_bytes resp_bytes duration orig_pkts "
                      "resp_pkts service conn_state"}
    lines = spread(f).select(file.alias("file"), F.when(fid % 2 == 0, a).otherwise(b).alias("value"), fid)
    names = f.select(file.alias("file")).distinct()
    fields = F.concat(F.lit("#fields\t"), F.replace(
        v._pick(F.col("file"), {"a/conn.log": head["a/conn.log"]}, head["b/conn.log"]), F.lit(" "), tab))
    extra = names.select("file", F.explode(F.array(F.lit("#separator \\x09"), fields, F.lit(""))).alias("value"),
                         F.lit(-1).cast("bigint").alias("flow_id"))
    return native(fl.parse_zeek(s.pinned(lines, "*").unionByName(s.pinned(extra, "*")), keep=("flow_id",)))


_ZEEK_HEADS = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes orig_pkts resp_pkts conn_state",
    "id.resp_h id.orig_h conn_state id.orig_p id.resp_p proto ts orig_bytes duration resp_bytes orig_pkts resp_pkts service note")


def _zeek_logs(spark, sf):
    """Log files written by Spark from the flows; the columns of a file change in its middle, and change back."""
    f = v.flows(spark, sf)
    tab = F.lit("\t")
    cells = {"uid": F.lit("C1"), "note": F.lit("x"), "id.orig_h": F.col("src_ip"), "id.resp_h": F.col("dst_ip"), "id.orig_p": F.col("src_port"),
             "id.resp_p": F.col("dst_port"), "duration": F.round("dur", 4), "orig_bytes": F.col("sbytes"), "resp_bytes": F.col("dbytes"),
             "orig_pkts": F.col("Spkts"), "resp_pkts": F.col("Dpkts"), "conn_state": v._pick(F.col("state"), {"FIN": "SF", "CON": "S1"}, "-")}
    a, b = (F.concat_ws("\t", *[cells.get(c, F.col(c) if c in f.columns else None).cast("string") for c in h.split()]) for h in _ZEEK_HEADS)
    part, seg = F.pmod(F.xxhash64("src_ip"), F.lit(4)), (F.pmod(F.col("flow_id"), F.lit(3))).cast("int")
    rows = f.select(part.alias("part"), seg.alias("seg"), F.lit(1).alias("kind"), F.when(seg == 1, b).otherwise(a).alias("value"))
    names = F.when(F.col("seg") == 1, F.lit(_ZEEK_HEADS[1])).otherwise(F.lit(_ZEEK_HEADS[0]))
    heads = rows.select("part", "seg").distinct().select("part", "seg", F.lit(0).alias("kind"), F.concat(F.lit("#fields\t"), F.replace(names, F.lit(" "), tab)).alias("value"))
    path = _dir(spark, "zeek")
    rows.unionByName(heads).repartition(4, "part").sortWithinPartitions("part", "seg", "kind").select("value").write.text(path)
    return path


_ZEEK_FILE_SQL = native_sql(
    service="case service when 'http' then 'http' when 'dns' then 'dns' when 'ssh' then 'ssh' else '-' end",
    state="case state when 'FIN' then 'FIN' when 'CON' then 'CON' else 'UNK' end").replace("select flow_id, src_ip", "select src_ip")


@query("src_zeek_files", _ZEEK_FILE_SQL)
def src_zeek_files(spark, sf):
    """Files whose header changes inside, read back by position."""
    return native(fl.read_flows(spark, _zeek_logs(spark, sf), "zeek").withColumn("flow_id", F.lit(0))).drop("flow_id")


@query("stream_zeek_files", _ZEEK_FILE_SQL)
def stream_zeek_files(spark, sf):
    """The same files as a stream."""
    out, state = _dir(spark, "zeek-out"), _dir(spark, "zeek-state")
    lines = fl.zeek_line_stream(spark, _zeek_logs(spark, sf))
    st.replay(lines, fl.zeek_batches(st.upsert_table(out)), state)
    return native(spark.read.parquet(out).withColumn("flow_id", F.lit(0))).drop("flow_id")


@query("src_eve_flows", native_sql(
    dur="case when flow_id % 6 = 0 then 0 else round(dur) end", proto="proto",
    sb="sbytes", db="case when flow_id % 5 = 1 then 0 else dbytes end",
    dp="case when flow_id % 5 = 1 then 0 else Dpkts end",
    service="case service when 'http' then 'http' when 'dns' then 'dns' when 'ssh' then 'ssh' else '-' end",
    state="case state when 'FIN' then 'FIN' when 'CON' then 'CON' else 'UNK' end", where="where flow_id % 5 <> 2"))
def src_eve_flows(spark, sf):
    f, fid = v.flows(spark, sf), F.col("flow_id")

    def iso(c):
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")

    net = fid % 5 == 1
    flow = F.struct(
        iso(F.col("ts")).alias("start"), F.when(fid % 6 != 0, iso(F.col("ts") + F.round("dur"))).alias("end"),
        F.when(~net, F.col("sbytes")).alias("bytes_toserver"), F.when(~net, F.col("dbytes")).alias("bytes_toclient"),
        F.when(~net, F.col("Spkts")).alias("pkts_toserver"), F.when(~net, F.col("Dpkts")).alias("pkts_toclient"),
        F.when(net, F.col("sbytes")).alias("bytes"), F.when(net, F.col("Spkts")).alias("pkts"),
        v._pick(F.col("state"), {"FIN": "closed", "CON": "established"}, "other").alias("state"))
    line = F.to_json(F.struct(
        F.when(net, "netflow").when(fid % 5 == 2, "dns").otherwise("flow").alias("event_type"), iso(F.col("ts") + 5).alias("timestamp"),
        "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), F.upper("proto").alias("proto"),
        F.when(F.col("service") == "-", "tls").otherwise(F.col("service")).alias("app_proto"), flow.alias("flow")))
    return native(fl.parse_eve(s.pinned(spread(f), line.alias("value"), fid), keep=("flow_id",)))


@query("src_detect_format", """
with p as (select case event_id % 7 when 0 then '/in/conn.log' when 1 then '/in/x.LOG' when 2 then '/in/a.jsonl'
 when 3 then '/in/eve.json' when 4 then '/in/f.csv' when 5 then '/in/b.ndjson' else '/in/noext' end as path from events)
select path, case when path in ('/in/conn.log', '/in/x.LOG') then 'zeek' when path = '/in/eve.json' then 'eve'
 when path = '/in/f.csv' then 'csv' else 'jsonl' end as fmt, count(*) as n from p group by 1""")
def src_detect_format(spark, sf):
    path = v._pick(F.col("event_id") % 7, {0: "/in/conn.log", 1: "/in/x.LOG", 2: "/in/a.jsonl", 3: "/in/eve.json",
                                           4: "/in/f.csv", 5: "/in/b.ndjson"}, "/in/noext")
    e = table(spark, sf, "events").select(path.alias("path"))
    return e.groupBy("path", fl.format_of("path").alias("fmt")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ feeds
def _lines(df, *cols):
    return df.select(F.concat_ws(",", *cols).alias("value"))


_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query("feed_urlhaus", f"""
with r as (select page_id, url, {_HOST} as host, page_id % 3 as k, 1700000000 + page_id * 60.0 as t from pages)
select value, kind as ioc_type, 'urlhaus' as source, t as first_seen, case when k = 0 then t else t + 3600 end as last_seen,
 case when k = 1 then 0.75 else 0.5 end as confidence, case when k = 2 then 'malware_download' else 'malware_download,elf,x' end as tags
from (select host as value, 'domain' as kind, * from r union all select url, 'url', * from r)""")
def feed_urlhaus(spark, sf):
    p, pid = table(spark, sf, "pages"), F.col("page_id")
    t = F.timestamp_seconds(1700000000 + pid * 60)
    q = F.lit('"')

    def quoted(c):
        return F.concat(q, c, q)

    line = F.concat_ws(
        ",", quoted(pid.cast("string")), quoted(F.date_format(t, "yyyy-MM-dd HH:mm:ss")), quoted(F.col("url")),
        quoted(F.when(pid % 3 == 1, "Online").otherwise("offline")),
        F.when(pid % 3 == 0, F.lit("")).otherwise(quoted(F.date_format(F.timestamp_seconds(1700003600 + pid * 60), "yyyy-MM-dd HH:mm:ss 'UTC'"))),
        quoted(F.lit("malware_download")), F.when(pid % 3 == 2, F.lit("")).otherwise(quoted(F.lit("elf,x"))), quoted(F.lit("link")),
        quoted(F.regexp_extract("url", "://([^/?#]+)", 1)))
    lines = p.select(F.explode(F.array(line, F.lit("# comment"), F.lit("short,row"), F.lit("  "))).alias("value"))
    return feeds.parse_urlhaus(lines).select("value", "ioc_type", "source", "first_seen", "last_seen", "confidence", "tags")


@query("feed_threatfox", """
select src as value, 'ipv4' as ioc_type, 1700000000 + user_id * 86400.0 as first_seen, 1700000000 + user_id * 86400.0 as last_seen,
 case event_id % 4 when 0 then 0.3 when 1 then 0.6 when 2 then 0.9 else 0.5 end as confidence,
 case when event_id % 2 = 0 then event_type else event_type || ',t' || (event_id % 5) end as tags, count(*) as n
from (select *, '10.0.' || (user_id // 256) || '.' || (user_id % 256) as src from events) group by all""")
def feed_threatfox(spark, sf):
    e, eid, uid = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    at = F.date_format(F.timestamp_seconds(1700000000 + uid * 86400), "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(
        ",", at, F.lit(""), F.concat(F.lit(" 10.0."), F.floor(uid / 256), F.lit("."), uid % 256, F.when(eid % 3 == 0, ":8080").otherwise(""), F.lit(" ")),
        F.lit("v"), F.col("event_type"), F.lit("agent"), F.when(eid % 2 == 0, "").otherwise(F.concat(F.lit("t"), eid % 5)),
        F.lit("id"), F.lit("link"), v._pick(eid % 4, {0: "low", 1: " Medium", 2: "HIGH"}, "unknown"))
    r = feeds.parse_threatfox(e.select(line.alias("value")))
    return r.groupBy("value", "ioc_type", "first_seen", "last_seen", "confidence", "tags").agg(F.count(F.lit(1)).alias("n"))


@query("feed_feodo", """
with e as (select *, '10.0.' || (user_id // 256) || '.' || (user_id % 256) as ip from events)
select case when event_id % 5 = 4 then 'c2-' || (event_id % 10) || '.example.org' else ip end as value,
 case when event_id % 5 = 4 then 'domain' else 'ipv4' end as ioc_type,
 case event_id % 5 when 1 then 'note ' || event_type when 4 then 'feodo-dga' else 'feodo-ip' end as tags, 0.8 as confidence, count(*) as n
from e where event_id % 5 in (0, 1, 4) group by all""")
def feed_feodo(spark, sf):
    e, eid, uid = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    ip = F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256)
    line = (F.when(eid % 5 == 0, F.concat(F.lit("  "), ip)).when(eid % 5 == 1, F.concat(ip, F.lit("  # note "), "event_type"))
            .when(eid % 5 == 2, F.concat(ip, F.lit("/24"))).when(eid % 5 == 3, F.concat(F.lit("# "), ip))
            .otherwise(F.concat(F.lit("c2-"), eid % 10, F.lit(".example.org"))))
    lines = e.select(line.alias("value"), (eid % 5 == 4).alias("domains"))
    r = feeds.parse_all({"feodo": lines.where("not domains").select("value"), "feodo-dga": lines.where("domains").select("value")}, now=1700000000)
    return r.groupBy("value", "ioc_type", "tags", "confidence").agg(F.count(F.lit(1)).alias("n"))


_NAMES = list(feeds.PLAIN_LISTS)
_SRC_SQL = "case event_id % 9 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " else 'ipsum' end"


def _plain_lines(spark, sf):
    e, eid, uid = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    ip = F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256)
    line = (F.when(eid % 4 == 0, F.concat(ip, F.lit(","), eid % 12)).when(eid % 4 == 1, F.concat(ip, F.lit("\t"), eid % 12, F.lit(" seen")))
            .when(eid % 4 == 2, F.concat(F.lit(" "), ip)).otherwise("# comment"))
    return spread(e).select(line.alias("value"), eid.alias("line_no"),
                    v._pick(eid % 9, dict(enumerate(_NAMES)), "ipsum").alias("src"))


@query("feed_plainlist", f"""
with e as (select event_id, {_SRC_SQL} as source, '10.0.' || (user_id // 256) || '.' || (user_id % 256) as value from events where event_id % 4 <> 3),
r as (select *, case when source = 'ipsum' and event_id % 4 < 2 then greatest(1, event_id % 12) end as times,
 case source when 'ipsum' then 0.55 when 'blocklist' then 0.7 when 'emerging' then 0.8 when 'certpl' then 0.8 else 0.75 end as base from e)
select source, value, cast(coalesce(times, 1) as int) as sightings,
 round(case when times is not null then least(0.95, base + 0.05 * least(times, 8)) else base end, 6) as confidence, count(*) as n
from r group by all""")
def feed_plainlist(spark, sf):
    r = feeds.parse_plain(_plain_lines(spark, sf), F.col("src"), now=1700000000)
    return r.groupBy("source", "value", "sightings", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("lim_cap", f"""
select source, count(*) as n, count(*) filter (r <= 100) as first_100, max(event_id) filter (r <= 100) as last_line, sum(r) as numbers
from (select *, row_number() over (partition by source order by event_id) as r from
  (select event_id, {_SRC_SQL} as source from events where event_id % 4 <> 3)) group by source""")
def lim_cap(spark, sf):
    """Records are numbered within their list; taking the first of them is left to the caller."""
    r = feeds.record_numbers(feeds.parse_plain(_plain_lines(spark, sf), F.col("src"), now=1))
    first = F.col("record_no") <= 100
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("first_100"),
                                   F.max(F.when(first, F.col("line_no"))).alias("last_line"), F.sum("record_no").alias("numbers"))


@query("feed_otx", """
select '10.0.' || (user_id // 256) || '.' || (user_id % 256) as value, 1700000000 + 60.0 * event_id as first_seen,
 case when event_id % 2 = 0 then 1700000000 + 60.0 * event_id else 1700000000 + 60.0 * event_id + 3600 end as last_seen,
 round(case when event_id % 3 = 0 then 0.005 else (event_id % 3) * 30 / 100.0 end, 6) as confidence, 't0,t1,t2,t3,t4,t5,t6,t7' as tags
from events""")
def feed_otx(spark, sf):
    e, eid, uid = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")

    def iso(x):
        return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss")

    pulse = F.struct(
        iso(1700000000 + 60 * eid).alias("created"), F.when(eid % 2 == 1, iso(1700003600 + 60 * eid)).alias("modified"),
        F.when(eid % 3 > 0, (eid % 3) * 30).alias("confidence"), F.array(*[F.lit(f"t{i}") for i in range(8)]).alias("tags"),
        F.array(F.struct(F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256).alias("indicator"), F.lit("IPv4").alias("type")),
                F.struct(F.lit("no such thing").alias("indicator"), F.lit("YARA").alias("type"))).alias("indicators"))
    docs = e.select(F.to_json(F.struct(F.array(pulse).alias("results"), F.lit("next").alias("next"))).alias("value"))
    r = feeds.parse_otx(docs)
    return r.select("value", "first_seen", "last_seen", F.round("confidence", 6).alias("confidence"), "tags")


@query("feed_misp", f"""
select case when page_id % 2 = 0 then {_HOST} else url end as value, case when page_id % 2 = 0 then 'domain' else 'url' end as ioc_type,
 1700000000.0 + page_id as first_seen, case when page_id % 3 = 0 then 0.8 else 0.5 end as confidence,
 case when page_id % 5 = 0 then 'seen' when page_id % 2 = 0 then 'hostname|port' else 'url' end as tags from pages""")
def feed_misp(spark, sf):
    p, pid = table(spark, sf, "pages"), F.col("page_id")
    attr = F.struct(
        F.when(pid % 2 == 0, F.concat(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("|443"))).otherwise(F.col("url")).alias("value"),
        F.when(pid % 2 == 0, "hostname|port").otherwise("url").alias("type"), (1700000000 + pid).cast("string").alias("timestamp"),
        (pid % 3 == 0).alias("to_ids"), F.when(pid % 5 == 0, "seen").otherwise("").alias("comment"))
    docs = p.select(F.to_json(F.struct(F.struct(F.array(attr).alias("Attribute")).alias("response"))).alias("value"))
    return feeds.parse_misp(docs).select("value", "ioc_type", "first_seen", "confidence", "tags")


@query("feed_union", """
with e as (select '10.0.' || (user_id // 256) || '.' || (user_id % 256) as value from events)
select source, value, count(*) as n from (select 'cins' as source, value from e union all select 'feodo', value from e
 union all select 'openphish', url from pages) group by 1, 2""")
def feed_union(spark, sf):
    uid = F.col("user_id")
    ips = table(spark, sf, "events").select(F.concat(F.lit("10.0."), F.floor(uid / 256), F.lit("."), uid % 256).alias("value"))
    urls = table(spark, sf, "pages").select(F.col("url").alias("value"))
    r = feeds.parse_all({"cins": ips, "feodo": ips, "openphish": urls}, now=1700000000)
    return r.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


@query("feed_report", """
with p as (select event_type as source, value < 90 as ok, event_id % 100 as n_records, value / 10 as seconds from events)
select coalesce(source, '*') as source, count(*) as polls, count(*) filter (ok) as ok, sum(n_records) as n_records,
 round(sum(seconds), 4) as seconds from p group by rollup (source)""")
def feed_report(spark, sf):
    polls = table(spark, sf, "events").select(F.col("event_type").alias("source"), (F.col("value") < 90).alias("ok"),
                                              (F.col("event_id") % 100).alias("n_records"), (F.col("value") / 10).alias("seconds"))
    return feeds.poll_report(polls).withColumn("seconds", F.round("seconds", 4))


@query("flt_comments", "select count(*) as n, sum(length(value)) as chars from (select unnest(string_split(text, chr(10))) as value from documents)"
       " where trim(value, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' and not starts_with(trim(value, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '#')")
def flt_comments(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return feeds.data_lines(lines).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query("snap_write", v.cte("iocs") + """,
p as (select source, case when seq % 2 = 0 then 1 when source <> 'cins' then 2 end as poll_ts from iocs)
select source, poll_ts, count(*) as n from p join (select source, max(poll_ts) as poll_ts from p group by 1) using (source, poll_ts) group by 1, 2""")
def snap_write(spark, sf):
    path = _dir(spark, "snap")
    i = v.iocs(spark, sf)
    feeds.write_snapshot(i.where("seq % 2 = 0").select(*feeds.COLUMNS), path, 1)
    feeds.write_snapshot(i.where("seq % 2 = 1 and source <> 'cins'").select(*feeds.COLUMNS), path, 2)
    return feeds.latest_snapshot(feeds.read_snapshots(spark, path)).groupBy("source", "poll_ts").agg(F.count(F.lit(1)).alias("n"))


@query("snap_read", v.cte("iocs") + """
select source, value, first_seen, last_seen, round(confidence, 6) as confidence, sightings from iocs where seq % 6 <> 5""")
def snap_read(spark, sf):
    """CSV snapshot rows, some broken, with the source in the file name."""
    i, seq = v.iocs(spark, sf), F.col("seq")
    rows = i.select("value", "ioc_type", F.col("first_seen").cast("string").alias("first_seen"),
                    F.when(seq % 6 == 5, "oops").otherwise(F.col("last_seen").cast("string")).alias("last_seen"),
                    F.col("confidence").cast("string").alias("confidence"), "tags", "provenance", F.col("sightings").cast("string").alias("sightings"),
                    F.concat(F.lit("file:/snap/"), "source", F.lit("_1700000000.csv")).alias("file"))
    return feeds.parse_snapshot_csv(rows).select("source", "value", "first_seen", "last_seen", F.round("confidence", 6).alias("confidence"), "sightings")
