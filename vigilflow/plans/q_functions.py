"""Scalar functions and feature derivations."""

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import scalars as s
from ..operators import cti
from . import q_cti
from . import views as v
from .q_metrics import rounded
from .registry import query, table
from ..sources.flows import EVE_APP_PROTO, EVE_STATE, ZEEK_SERVICE, ZEEK_STATE, cic_label


def _n():
    return F.count(F.lit(1)).alias("n")


@query("fn_clean_strings", """
select event_id, event_type, md5(trim(props || chr(9), ' ' || chr(9) || chr(10))) as props from events""")
def fn_clean_strings(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias(" ﻿event_id "), F.concat(F.lit(" \t"), "event_type", F.lit("\n ")).alias("event_type "),
        F.concat(F.lit(" "), "props", F.lit("\t")).alias("props"))
    return s.clean_strings(e).withColumn("props", F.md5("props"))


@query("fn_try_numeric", """
select event_id, case when event_id % 3 = 1 or event_type = 'view' then null else value end as value from events""")
def fn_try_numeric(spark, sf):
    t = F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_type") == "view", F.col("event_type")).otherwise(
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return table(spark, sf, "events").select("event_id", s.number(t).alias("value"))


@query("fn_parse_ts", """
with d as (select o_orderkey, o_orderdate, day(o_orderdate) as d, month(o_orderdate) as m from orders),
k as (select o_orderkey, o_orderdate, o_orderkey % 3 as k, d, m from d)
select o_orderkey, case when k = 0 then epoch(o_orderdate) when k = 1 then
 epoch(make_date(year(o_orderdate), case when d <= 12 then d else m end, case when d <= 12 then m else d end)) end as t from k""")
def fn_parse_ts(spark, sf):
    """Day-first text, month-first text (read day-first when that is possible), and junk."""
    o, key, d = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(key % 3 == 0, F.date_format(d, "d/M/yyyy HH:mm:ss")).when(
        key % 3 == 1, F.date_format(d, "MM/dd/yyyy HH:mm")).otherwise("bad")
    return o.select("o_orderkey", s.epoch(s.flow_time(text)).alias("t"))


@query("fn_epoch", "select event_id, case when event_id % 5 > 0 then epoch_us(ts) / 1000000 end as t from events")
def fn_epoch(spark, sf):
    return table(spark, sf, "events").select("event_id", s.epoch(F.when(F.col("event_id") % 5 > 0, F.col("ts"))).alias("t"))


@query("fn_iso_ts", """
select event_id, case event_id % 4 when 3 then 0 when 2 then floor(epoch_us(ts) / 1000000) - 7200 else floor(epoch_us(ts) / 1000000) end as t from events""")
def fn_iso_ts(spark, sf):
    sec = F.date_trunc("second", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.unix_timestamp(sec).cast("string"))
            .when(k == 2, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'+0200'")).otherwise("junk"))
    return table(spark, sf, "events").select("event_id", s.iso_epoch(text).alias("t"))


@query("fn_feed_epoch", """
select event_id, case event_id % 6 when 0 then floor(epoch_us(ts) / 1000000) when 1 then floor(epoch_us(ts) / 1000000)
 when 2 then floor(epoch_us(ts) / 60000000) * 60 when 3 then floor(epoch_us(ts) / 86400000000) * 86400
 when 4 then floor(epoch_us(ts) / 1000000) end as t from events""")
def fn_feed_epoch(spark, sf):
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    fmts = ("yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
    text = F.lit("n/a")
    for i, f in enumerate(fmts):
        text = F.when(k == i, F.date_format(t, f)).otherwise(text)
    return table(spark, sf, "events").select("event_id", s.feed_epoch(text).alias("t"))


@query("fn_label", """
select event_type, cast(case when event_type = 'view' or event_type = 'click' then 0 else 1 end as tinyint) as label, count(*) as n from events group by 1""")
def fn_label(spark, sf):
    cat = F.when(F.col("event_type") == "view", "BENIGN").when(F.col("event_type") != "click", F.col("event_type"))
    return table(spark, sf, "events").groupBy("event_type", cic_label(cat).alias("label")).agg(_n())


@query("fn_downcast", """
select 'user_id' as col, case when max(user_id) < 128 then 'tinyint' when max(user_id) < 32768 then 'smallint' else 'int' end as type, sum(user_id)::double as total from events
union all select 'event_id', case when max(event_id) < 128 then 'tinyint' when max(event_id) < 32768 then 'smallint' else 'int' end, sum(event_id) from events
union all select 'value', 'float', round(sum(value), 0) from events""")
def fn_downcast(spark, sf):
    d = s.narrowest(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id", "event_id", "value"])
    types = dict(d.dtypes)
    return d.agg(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(types[c]).alias("type"), F.round(F.sum(F.col(c).cast("double")), 0).alias("total"))
                           for c in d.columns]).alias("a")).select(F.explode("a").alias("a")).select("a.*")


@query("flt_required", "select event_id from events where event_id % 4 > 0 and event_type <> 'view'")
def flt_required(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("ts"),
                                          F.when(F.col("event_type") != "view", F.col("event_type")).alias("src_ip"))
    return e.dropna(subset=["ts", "src_ip"]).select("event_id")


@query("fn_strip_port", """
select event_id, case event_id % 4 when 0 then '10.0.0.' || (user_id % 250) when 1 then '10.0.0.' || (user_id % 250)
 when 2 then 'a:b:' || user_id else '[::1' end as host, case when event_id % 2 = 0 then 'h' || user_id else 'h' || user_id || '|80' end as value from events""")
def fn_strip_port(spark, sf):
    k, uid = F.col("event_id") % 4, F.col("user_id")
    ip = F.concat(F.lit("10.0.0."), uid % 250)
    host = F.when(k == 0, F.concat(ip, F.lit(":8080"))).when(k == 1, ip).when(k == 2, F.concat(F.lit("a:b:"), uid)).otherwise("[::1")
    kind = F.when(F.col("event_id") % 2 == 0, "hostname|port").otherwise("hostname")
    return table(spark, sf, "events").select("event_id", s.strip_port(host).alias("host"),
                                             s.strip_piped_port(F.concat(F.lit("h"), uid, F.lit("|80")), kind).alias("value"))


@query("fn_confidence", """
select case event_id % 4 when 0 then 0.3 when 1 then 0.6 when 2 then 0.9 else 0.5 end as confidence, count(*) as n from events group by 1""")
def fn_confidence(spark, sf):
    from ..sources.feeds import THREATFOX_CONFIDENCE

    level = v._pick(F.col("event_id") % 4, {0: "low", 1: "medium", 2: "high"}, "n/a")
    m = F.create_map(*[F.lit(x) for kv in THREATFOX_CONFIDENCE.items() for x in kv])
    return table(spark, sf, "events").groupBy(F.coalesce(m[level], F.lit(0.5)).alias("confidence")).agg(_n())


@query("fn_first_token", """
select event_id, 'v' || event_id as value, case event_id % 3 when 0 then user_id || ' x,y' when 1 then 'a b' else '' end as tail from events""")
def fn_first_token(spark, sf):
    eid = F.col("event_id")
    val = F.concat(F.lit("v"), eid)
    line = F.when(eid % 3 == 0, F.concat(F.lit(" "), val, F.lit(","), "user_id", F.lit(" x,y "))).when(
        eid % 3 == 1, F.concat(val, F.lit(" \t a b"))).otherwise(val)
    return table(spark, sf, "events").select("event_id", s.first_token(line).alias("t")).select("event_id", "t.value", "t.tail")


@query("fn_alias", """
select event_id, case event_id % 3 when 0 then event_type when 1 then 'x' || user_id else 'low' end as src from events""")
def fn_alias(spark, sf):
    eid = F.col("event_id")
    m = (F.when(eid % 3 == 0, F.create_map(F.lit("src_ip"), F.col("event_type"), F.lit("sa"), F.lit("z")))
         .when(eid % 3 == 1, F.create_map(F.lit("src_ip"), F.lit(""), F.lit("srcip"), F.concat(F.lit("x"), "user_id")))
         .otherwise(F.create_map(F.lit("SRC_IP"), F.lit("up"), F.lit("Src_Ip"), F.lit("low"))))
    e = table(spark, sf, "events").select("event_id", m.alias("m")).withColumn("low", s.lowered_map("m"))
    return e.select("event_id", s.first_alias(s.map_lookup("m", "low"), ("src_ip", "srcip", "sa")).alias("src"))


def _vocab_sql(c, mapping, default):
    return f"case {c} " + " ".join(f"when '{k}' then '{x}'" for k, x in mapping.items()) + f" else '{default}' end"


_WORDS = ["http", "tls", "SF", "S1", "S0", "REJ", "OTH", "ftp_data", "http2", "established", "broke", "nope"]
_WORD_SQL = "case event_id % 12 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end"


@query("fn_vocab", f"""
select w, {_vocab_sql('w', ZEEK_SERVICE, '-')} as zeek_service, {_vocab_sql('w', ZEEK_STATE, 'UNK')} as zeek_state,
 {_vocab_sql('w', EVE_APP_PROTO, '-')} as eve_service, {_vocab_sql('w', EVE_STATE, 'UNK')} as eve_state, count(*) as n
from (select {_WORD_SQL} as w from events) group by all""")
def fn_vocab(spark, sf):
    w = table(spark, sf, "events").select(F.element_at(F.array(*[F.lit(x) for x in _WORDS]), (F.col("event_id") % 12 + 1).cast("int")).alias("w"))
    return w.groupBy("w", s.vocab("w", ZEEK_SERVICE, "-").alias("zeek_service"), s.vocab("w", ZEEK_STATE, "UNK").alias("zeek_state"),
                     s.vocab("w", EVE_APP_PROTO, "-").alias("eve_service"), s.vocab("w", EVE_STATE, "UNK").alias("eve_state")).agg(_n())


@query("fn_safe_num", """
select event_id, case event_id % 4 when 0 then value when 1 then 0 when 2 then 0 else 0 end as x, cast(case event_id % 4 when 0 then floor(value) else 7 end as int) as i from events""")
def fn_safe_num(spark, sf):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "-").when(k == 2, "")
    return table(spark, sf, "events").select("event_id", s.safe_double(t).alias("x"), s.safe_int(t, 7).alias("i"))


@query("fn_proto", """
select case event_id % 7 when 0 then 'tcp' when 1 then 'tcp' when 2 then 'udp' when 3 then 'udp' when 4 then 'icmp' when 5 then 'icmp' else 'other' end as family, count(*) as n
from events group by 1""")
def fn_proto(spark, sf):
    p = v._pick(F.col("event_id") % 7, {0: " TCP", 1: "6", 2: "udp", 3: "17", 4: "1", 5: "ICMP6"}, "gre")
    return table(spark, sf, "events").groupBy(s.proto_family(p).alias("family")).agg(_n())


@query("fn_finite", "select event_id, case when event_id % 5 in (0, 1, 2) then 0 else value end as x from events")
def fn_finite(spark, sf):
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", s.finite(x).alias("x"))


# ------------------------------------------------------------------ features
@query("feat_unsw_derived", v.cte("flows") + """
select flow_id, round(sbytes * 8 / greatest(dur, 1e-6), 3) as Sload, round(dbytes * 8 / greatest(dur, 1e-6), 3) as Dload,
 round(sbytes / Spkts, 6) as smeansz, round(case when Dpkts > 0 then dbytes / Dpkts end, 6) as dmeansz from flows""")
def feat_unsw_derived(spark, sf):
    from ..sources.flows import derive

    d = derive(v.flows(spark, sf))
    return d.select("flow_id", F.round("Sload", 3).alias("Sload"), F.round("Dload", 3).alias("Dload"),
                    F.round("smeansz", 6).alias("smeansz"), F.round("dmeansz", 6).alias("dmeansz"))


@query("feat_rates", v.cte("flows") + """
select flow_id, round((sbytes + dbytes) / greatest(dur, 1e-6), 4) as byte_rate, round((Spkts + Dpkts) / greatest(dur, 1e-6), 4) as pkt_rate,
 round((sbytes + dbytes) / greatest(Spkts + Dpkts, 1), 6) as mean_pkt_size, round(Spkts / greatest(Dpkts, 1), 6) as fwd_bwd_ratio from flows""")
def feat_rates(spark, sf):
    d = ft.add_rates(v.flows(spark, sf))
    return d.select("flow_id", F.round("byte_rate", 4).alias("byte_rate"), F.round("pkt_rate", 4).alias("pkt_rate"),
                    F.round("mean_pkt_size", 6).alias("mean_pkt_size"), F.round("fwd_bwd_ratio", 6).alias("fwd_bwd_ratio"))


def cic_like(f):
    """Flows under the column names and units of the other benchmark."""
    return f.select(
        "*", (F.col("dur") * 1e6).alias("Flow Duration"), F.col("Spkts").alias("Total Fwd Packets"),
        F.col("Dpkts").alias("Total Backward Packets"), F.col("sbytes").alias("Total Length of Fwd Packets"),
        F.col("dbytes").alias("Total Length of Bwd Packets"), (F.col("dur") * 1e5).alias("Flow IAT Mean"))


def unsw_like(f):
    return f.select("*", (F.col("dur") / 10).alias("Sintpkt"), (F.col("dur") / 5).alias("Dintpkt"))


def _bridge_sql(dataset, iat):
    return f"""select flow_id, '{dataset}' as dataset, round(ln(1 + dur), 6) as log_duration_s, round(ln(1 + Spkts + Dpkts), 6) as log_total_pkts,
 round(ln(1 + sbytes + dbytes), 6) as log_total_bytes, round(ln(1 + (sbytes + dbytes) / greatest(dur, 1e-6)), 6) as log_byte_rate,
 round(ln(1 + {iat}), 6) as log_iat_mean, round(ln(1 + Spkts / greatest(Dpkts, 1)), 6) as log_fwd_bwd_ratio,
 cast(proto = 'tcp' as double) as proto_tcp, cast(proto = 'icmp' as double) as proto_icmp from flows"""


def _bridge(df, dataset):
    b = ft.bridge(df, dataset, ("flow_id",))
    cols = ("duration_s", "total_pkts", "total_bytes", "byte_rate", "iat_mean", "fwd_bwd_ratio")
    return b.select("flow_id", F.lit(dataset).alias("dataset"), *[F.round(f"log_{c}", 6).alias(f"log_{c}") for c in cols], "proto_tcp", "proto_icmp")


@query("feat_bridge", v.cte("flows") + _bridge_sql("unsw_nb15", "(dur / 10 + dur / 5) / 2"))
def feat_bridge(spark, sf):
    return _bridge(unsw_like(v.flows(spark, sf)), "unsw_nb15")


@query("bridge_union", v.cte("flows") + _bridge_sql("unsw_nb15", "(dur / 10 + dur / 5) / 2") + " union all " + _bridge_sql("cicids2017", "dur / 10"))
def bridge_union(spark, sf):
    f = v.flows(spark, sf)
    return _bridge(unsw_like(f), "unsw_nb15").unionByName(_bridge(cic_like(f), "cicids2017"), allowMissingColumns=True)


CATS = "(select 'proto' as col, proto as value from flows union all select 'dst_port', cast(dst_port as varchar) from flows union all select 'src_ip', src_ip from flows)"
VOCAB = f"""voc as (select col, value, count(*) as n from {CATS} group by 1, 2
 having count(*) >= greatest(0.001 * (select count(*) from flows), 50))"""


@query("feat_vocab", v.cte("flows") + "," + VOCAB + " select * from voc")
def feat_vocab(spark, sf):
    return ft.build_vocabulary(v.flows(spark, sf), ["proto", "dst_port", "src_ip"])


@query("feat_pool", v.cte("flows") + "," + VOCAB + """
select flow_id, coalesce(v.value, 'OTHER') as pooled from flows left join (select value from voc where col = 'src_ip') v on src_ip = v.value""")
def feat_pool(spark, sf):
    f = v.flows(spark, sf)
    keep = ft.freeze(ft.build_vocabulary(f, ["src_ip"])).get("src_ip", [])
    return f.select("flow_id", ft.pooled("src_ip", keep).alias("pooled"))


@query("feat_onehot", v.cte("flows") + """
select flow_id, cast(proto = 'tcp' as double) as proto_tcp, cast(proto = 'udp' as double) as proto_udp, cast(proto not in ('tcp', 'udp') as double) as "proto_OTHER",
 0.0 as "proto_UNK" from flows""")
def feat_onehot(spark, sf):
    return v.flows(spark, sf).select("flow_id", *ft.one_hot("proto", ["tcp", "udp"]))


def design_frame(spark, sf, vocab_floor=50):
    """Enriched flows with rates, their vocabulary, and the design's numeric columns."""
    e = ft.add_rates(q_cti._enriched(spark, sf, injection=True)).drop("age_s")
    num, cat = ft.split_types(e, drop=("flow_id", "split", "fold"))
    vocab = ft.freeze(ft.build_vocabulary(e, cat, floor=vocab_floor))
    return e, num, vocab


@query("feat_design", v.cte("flows") + """
select flow_id, dur, sbytes, round((sbytes + dbytes) / greatest(dur, 1e-6), 4) as byte_rate, cast(state = 'FIN' as double) as "state_FIN", cast(service = 'http' as double) as service_http, 25 as n_features from flows""")
def feat_design(spark, sf):
    e = ft.add_rates(v.flows(spark, sf))
    num, cat = ft.split_types(e, drop=("flow_id",))
    vocab = ft.freeze(ft.build_vocabulary(e, cat))
    d = ft.design(e, num, vocab, ("flow_id",))
    return d.select("flow_id", "dur", "sbytes", F.round("byte_rate", 4).alias("byte_rate"), "state_FIN", "service_http",
                    F.lit(len(ft.design_names(num, vocab))).alias("n_features"))


@query("feat_align", v.cte("flows") + "select flow_id, dur, 0.0 as missing, sbytes from flows")
def feat_align(spark, sf):
    return ft.align(v.flows(spark, sf), ["dur", "missing", "sbytes"], ("flow_id",))


@query("feat_ablation", v.cte("entries", "t0") + "," + q_cti.enriched_cte() + """
select 'live_feeds_only' as variant, 1 as n_features, round(sum(dur), 3) as total from enriched
union all select 'traffic_only', 1, round(sum(dur), 3) from enriched
union all select 'traffic_cti', 3, round(sum(dur + ioc_dst_match + feed_confidence), 3) from enriched
union all select 'traffic_cti_no_match', 2, round(sum(dur + feed_confidence), 3) from enriched""")
def feat_ablation(spark, sf):
    e = q_cti._enriched(spark, sf).withColumn("feed_confidence", F.round(F.col("feed_confidence").cast("double"), 6))
    groups = ft.ablation_groups(["dur", "ioc_dst_match", "feed_confidence"])
    sums = [F.struct(F.lit(name).alias("variant"), F.lit(len(cols)).alias("n_features"),
                     F.round(F.sum(sum((F.col(c) for c in cols[1:]), F.col(cols[0]))), 3).alias("total")) for name, cols in groups.items()]
    return e.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")
