"""Hand-computed vectors."""

import pytest
from pyspark.sql import functions as F

from vigilflow.functions import attack, features, scalars as s
from vigilflow.operators import attribution as at
from vigilflow.operators import cti, explain as ex, ioc, metrics as m
from vigilflow.sources import feeds, flows as fl


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_classify(spark):
    vals = ["1.2.3.4", "999.1.1.1", "http://a.b/x", "http://a.b/" + "a" * 32, "b" * 40, "a-b.example.org", "foo", " ", "x" * 257, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(ioc.classify("v")).collect()]
    assert got == ["ipv4", "ipv4", "url", "hash", "hash", "domain", None, None, None, None]


def test_poll_grid(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (300.0,), (301.0,)], "ts double")
    assert [r[0] for r in df.select(cti.poll_grid("ts", 300, 0.0)).collect()] == [0, 300, 300, 600]
    assert [r[0] for r in df.select(cti.poll_grid("ts", 0, 0.0)).collect()] == [0, 1, 300, 301]


@pytest.mark.parametrize("both, sources", [(False, [1, 2, 2, 2, 3, 3, 3, 3, 3]), (True, [2, 3, 3, 3, 3, 3, 3, 3, 3])])
def test_evidence_rank(spark, both, sources):
    e = spark.createDataFrame([("a", float(i * 1000), None, 0, 0, 0, False, "injected") for i in range(9)],
                              "value string, ts double, confidence double, role int, seq long, ord int, live boolean, source string")
    roles = spark.createDataFrame([("a", both)], "ip string, multi_role boolean")
    r = cti.evidence(e, roles).orderBy("ts").collect()
    assert [round(x["conf"], 2) for x in r] == [.45, .52, .59, .66, .73, .80, .87, .94, .95]
    assert [x["sources"] for x in r] == sources


def test_age_and_reputation(spark):
    got = one(spark, *[cti.age_score(F.lit(a), 21600.0) for a in (0.0, 21600.0, 43200.0)], cti.age_score(F.lit(None).cast("double"), 21600.0))
    assert got == (1.0, .5, .25, 0.0)
    assert one(spark, *[cti.reputation(F.lit(c)) for c in (0.0, .5, .6, .8)]) == (0, 1, 2, 3)


def test_plain_list_counts(spark):
    df = spark.createDataFrame([("1.2.3.4 3",), ("1.2.3.5 20",), ("1.2.3.6",), ("# c",), ("",)], "value string")
    r = {x["value"]: (round(x["confidence"], 2), x["sightings"]) for x in feeds.parse_plain(df, "ipsum", 1.0).collect()}
    assert r == {"1.2.3.4": (.70, 3), "1.2.3.5": (.95, 20), "1.2.3.6": (.55, 1)}


def test_threatfox_strips_port(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00,,1.2.3.4:8080,v,mal,a,t,id,l,high",), ("too,short",)], "value string")
    (r,) = feeds.parse_threatfox(df).collect()
    assert (r["value"], r["confidence"], r["tags"], r["first_seen"]) == ("1.2.3.4", .9, "mal,t", 1704067200.0)


def test_upsert_and_expire(spark):
    cols = "value string, ioc_type string, source string, provenance string, first_seen double, last_seen double, confidence double, tags string, sightings int, seq int"
    rows = [("v", "ipv4", "s", "live", 10.0, 20.0, .5, "a", 5, 1), ("v", "ipv4", "s", "live", 5.0, 30.0, .8, "", 7, 2)]
    df = spark.createDataFrame(rows, cols)
    (r,) = ioc.upsert(df).collect()
    assert (r["sightings"], r["tags"], r["confidence"], r["first_seen"], r["last_seen"]) == (6, "a", .8, 5.0, 30.0)
    step = ioc.upsert(df.where("seq = 2"), ioc.upsert(df.where("seq = 1"))).first()
    assert step.asDict() == r.asDict()
    assert ioc.expire(df, 0, 20.0).count() == 2 and ioc.expire(df, 0, 21.0).count() == 1


def test_zeek_row(spark):
    head = "#fields\t" + "\t".join("ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto duration orig_bytes resp_bytes orig_pkts resp_pkts conn_state service".split())
    row = "1.5\tC\t10.0.0.1\t1234\t10.0.0.2\t80\tTCP\t2.5\t100\t200\t4\t5\tSF\thttp"
    df = spark.createDataFrame([("f", head), ("f", row), ("f", row.replace("10.0.0.1", "-", 1)), ("f", "#close")], "file string, value string")
    (r,) = fl.parse_zeek(df).collect()
    assert (r["state"], r["service"], r["dur"], r["proto"], r["Sload"], r["smeansz"]) == ("FIN", "http", 2.5, "tcp", 320.0, 25.0)


def test_eve_row(spark):
    line = ('{"event_type":"flow","timestamp":"2026-10-02T10:00:05.000000+0000","src_ip":"1.1.1.1","src_port":1,"dest_ip":"2.2.2.2","dest_port":443,'
            '"proto":"TCP","app_proto":"tls","flow":{"start":"2026-10-02T10:00:00.000000+0000","end":"2026-10-02T10:00:03.000000+0000",'
            '"bytes_toserver":10,"bytes_toclient":20,"pkts_toserver":7,"pkts_toclient":1,"state":"established"}}')
    (r,) = fl.parse_eve(spark.createDataFrame([(line,), ("{bad",), ('{"event_type":"dns"}',)], "value string")).collect()
    assert (r["service"], r["state"], r["dur"], r["Spkts"], r["ts"]) == ("-", "CON", 3.0, 7.0, 1790935200.0)


def test_generic_json(spark):
    line = '{"src":"1.1.1.1","da":"2.2.2.2","bytes_toserver":120,"orig_pkts":2,"app_proto":"dns","ts":"1700000000"}'
    (r,) = fl.parse_jsonl(spark.createDataFrame([(line,), ("nope",), ('{"src":"x"}',)], "value string")).collect()
    assert (r["smeansz"], r["service"], r["state"], r["ts"], r["dmeansz"]) == (60.0, "dns", "UNK", 1700000000.0, None)


def test_times(spark):
    t = [s.epoch(s.flow_time(F.lit(x))) for x in ("3/7/2017 8:55", "07/31/2017 01:02", "bad")]
    assert one(spark, *t) == (1499072100.0, 1501462920.0, None)
    assert one(spark, s.iso_epoch(F.lit("1700000000")), s.iso_epoch(F.lit("2026-10-02T10:00:00Z")), s.iso_epoch(F.lit("x"))) == (
        1700000000.0, 1790935200.0, 0.0)


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(1, .9), (0, .8), (1, .7), (0, .1)], "label int, score double")
    c = m.curve(df)
    assert abs(m.average_precision(c).first()[0] - 5 / 6) < 1e-12
    assert m.roc_auc(c).first()[0] == .75
    assert m.theta_of(df, .96) == .7 and m.theta_of(df, .5) == .9
    r = m.metrics_at(df, .7).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["recall"], r["fpr"]) == (2, 1, 1, 0, 1.0, .5)
    none = m.confusion(df, 2.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0, 0, 0)


def test_jaccard_and_tv(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    assert one(spark, ex.jaccard(a("a", "b", "c"), a("b", "c", "d")), ex.jaccard(a(), a())) == (.5, 1.0)
    d = spark.createDataFrame([(1, "x", .6), (1, "y", .4), (2, "x", .5), (2, "y", .5)], "fold int, tactic string, share double")
    assert abs(ex.tactic_stability(d).first()["mean_tv_distance"] - .1) < 1e-12


def test_attack_map(spark):
    names = spark.createDataFrame([(n,) for n in ("sttl", "mean_pkt_size", "service_http", "Flow Bytes/s", "proto_tcp")], "feature string")
    got = {r["feature"]: r["tactic"] for r in attack.map_features(names).collect()}
    assert got == {"sttl": "Defense Evasion", "mean_pkt_size": "Exfiltration", "service_http": "Discovery",
                   "Flow Bytes/s": "Uncategorised", "proto_tcp": "Uncategorised"}


def test_general_number_text(spark):
    vals = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, 999999.5, 57.0, 0.1, 7.6e7, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in df.select(attack.general(F.col("v"))).collect()] == [f"{v:g}" for v in vals]


def test_reason_codes_fallbacks(spark):
    base = spark.createDataFrame([(0.0,), (1.0,)], "ioc_dst_match double").select(
        "ioc_dst_match", F.lit(0.0).alias("ioc_src_match"), F.lit(.5).alias("feed_age_score"), F.lit(.8).alias("feed_confidence"),
        F.lit(2.0).alias("source_count"), F.array(F.lit(1.0)).alias("vals"), F.array(F.lit(-.1)).alias("phi"))
    r = ex.reason_codes(base.withColumn("contribs", ex.contributions(["dur"], "vals", "phi"))).orderBy("ioc_dst_match").collect()
    assert [x["feature"] for x in r[0]["reasons"]] == ["-"]
    assert [(x["feature"], x["shap"]) for x in r[1]["reasons"]] == [("ioc_dst_match", None)]


def test_attribution_pieces(spark):
    cti_s = "struct<ioc_src_match:double,ioc_dst_match:double,feed_confidence:double,source_count:int>"
    df = spark.createDataFrame([((0.0, 1.0, .8, 1),), ((0.0, 0.0, .8, 3),)], f"cti {cti_s}")
    assert [round(r[0], 6) for r in df.select(at.ioc_strength()).collect()] == [.88, 0.0]
    t = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    got = one(spark, at.category(t("T1110"), F.lit(False)), at.category(t("T1041"), F.lit(False)), at.category(t(), F.lit(True)),
              at.category(t(), F.lit(False)))
    assert [g.split(" ")[0] for g in got] == ["Credential", "Suspected", "Known", "Unclassified"]
    r = spark.createDataFrame([([("T1071.001 · X",), ("-",)],)], "reasons array<struct<technique:string>>")
    assert r.select(at.techniques()).first()[0] == ["T1071"]


def test_pooling(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 50, "a").when(F.col("id") < 99, "b").otherwise("c").alias("p"))
    keep = features.freeze(features.build_vocabulary(df, ["p"]))["p"]
    assert keep == ["a", "c"]
    got = {r["k"]: r["n"] for r in df.groupBy(features.pooled("p", keep).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 50, "OTHER": 49, "c": 901}
