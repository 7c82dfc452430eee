"""Evidence and what is told of it are worked out once per kind; JSON lines are read once."""

import json

from pyspark.sql import functions as F

from vigilflow.operators import attribution as at
from vigilflow.operators import retrieval as re_
from vigilflow.plans import q_attribution, q_streaming
from vigilflow.sources import flows as fl

from .test_attribution_once import actors, alerts


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ranks_of_kinds_equal_those_of_alerts(spark):
    a, many = actors(spark), alerts(spark, 66)
    kinds = at.kinds_of(many)
    assert kinds.count() == kinds.select("_kind").distinct().count() < many.count()
    model = re_.fit(a.select("id", "text"), ())
    got, want = (at.rank_actors(e, a, model) for e in (kinds, at.evidence_keys(many)))
    assert rows(got.top.drop("score", "retrieval")) == rows(want.top.drop("score", "retrieval"))
    assert rows(got.close.select("query", "competitors")) == rows(want.close.select("query", "competitors"))


def test_columns_in_place_of_an_attribution(spark):
    a, many = actors(spark), alerts(spark, 40)
    model = re_.fit(a.select("id", "text"), ())
    got = at.attribute(many, a, model, columns=q_attribution.verdict_fields())
    want = q_attribution.verdict_columns(at.attribute(many, a, model))
    assert rows(got.select(want.columns)) == rows(want)
    join = [x for x in got.select("alert_id", "scores")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    # numbers are made text before alerts are joined
    assert join and "format_string" not in got._jdf.queryExecution().optimizedPlan().toString()


PLAIN = {"flow_id": 7, "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "src_port": 1, "dst_port": 443, "proto": "TCP", "ts": 5.0, "dur": 0.5, "sbytes": 8,
         "dbytes": 4, "Spkts": 2, "Dpkts": 1, "service": "http", "state": "FIN", "label": 1}
ODD = [{**PLAIN, "service": ""}, {**PLAIN, "state": None}, {k: x for k, x in PLAIN.items() if k not in ("src_ip", "label")} | {"SRCIP": "3.3.3.3"},
       {k.upper(): x for k, x in PLAIN.items()}, {**PLAIN, "PROTO": "udp", "flow_id": None}]


def test_fields_of_a_line_come_from_its_one_parse(spark):
    lines = spark.createDataFrame([(json.dumps(x),) for x in [PLAIN, *ODD]] + [(json.dumps(PLAIN)[:30],), ("[1]",), (None,)], "value string")
    got = q_streaming.labelled(lines)
    keep = lines.withColumn("flow_id", F.get_json_object("value", "$.flow_id").cast("bigint")).withColumn("label", F.get_json_object("value", "$.label").cast("int"))
    want = fl.parse_jsonl(keep, keep=("flow_id", "label"))
    assert rows(got.select(want.columns)) == rows(want) and got.count() == 6
    assert "get_json_object" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_other_spellings_are_looked_up_where_a_first_one_is_missing(spark):
    by = lambda x: fl.parse_jsonl(spark.createDataFrame([(json.dumps(x),)], "value string")).first()
    plain = by(PLAIN)
    assert by(ODD[3]) == plain
    assert by(ODD[2]).src_ip == "3.3.3.3" and by(ODD[4]).proto == "tcp"
    assert (by(ODD[0]).service, by(ODD[1]).state) == ("-", "UNK")
