"""Brute-force and invariance checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow.operators import alerts as al
from vigilflow.operators import cti, models as ml, ranks, shap, splits
from vigilflow.sources import sinks

TTL = 5000.0


def world(spark, seed=7, n=400):
    """Flows and sightings where one address owns a third of everything."""
    rnd = random.Random(seed)
    ip = lambda: "hot" if rnd.random() < .34 else f"ip{rnd.randrange(12)}"
    flows = [(i, ip(), ip(), float(rnd.randrange(0, 40000)), rnd.randrange(2)) for i in range(n)]
    sight = [(ip(), float(rnd.randrange(0, 40000)), rnd.choice([.4, .6, .8]), rnd.randrange(1, 4), i) for i in range(n // 2)]
    f = spark.createDataFrame(flows, "flow_id long, src_ip string, dst_ip string, ts double, label int")
    s = spark.createDataFrame(sight, "value string, ts double, conf double, sources int, seq long").select(
        "*", F.lit(0).alias("role"), F.lit(0).alias("ord"))
    return flows, sight, f, s


def brute(flows, sight, dt, strict=False):
    grid = (lambda t: t) if dt == 0 else (lambda t: float(np.ceil(t / dt) * dt))
    out = {}
    for fid, src, dst, ts, _ in flows:
        best = []
        for side in (src, dst):
            seen = [(grid(t), t, q, c, k) for v, t, c, k, q in sight if v == side and (grid(t) < ts if strict else grid(t) <= ts)]
            last = max(seen, key=lambda e: (e[0], e[1], e[2])) if seen else None
            best.append(None if last is None or ts - last[0] > TTL else (ts - last[0], last[3], last[4]))
        s, d = best
        use_d = d is not None and (s is None or d[1] >= s[1])
        pick = d if use_d else s
        out[fid] = (int(s is not None and not use_d), int(use_d), *(pick or (None, 0.0, 0)))
    return out


@pytest.mark.parametrize("dt, strict, limit, parts", [(300.0, False, 10 ** 6, 4), (300.0, True, 10 ** 6, 3), (60.0, False, 1, 7), (0.0, False, 10 ** 6, 4),
                                                      (0.0, True, 10 ** 6, 2), (7000.0, False, 10 ** 6, 4)])
def test_enrich_against_brute_force(spark, dt, strict, limit, parts):
    flows, sight, f, s = world(spark)
    e = cti.enrich(f.repartition(parts), cti.timeline(s.repartition(parts), dt, 0.0), dt, TTL, 3600.0, 0.0, strict=strict, broadcast_rows=limit)
    rows = e.collect()
    assert len(rows) == len(flows)
    got = {r["flow_id"]: (int(r["ioc_src_match"]), int(r["ioc_dst_match"]), r["age_s"], round(r["feed_confidence"], 4), int(r["source_count"])) for r in rows}
    assert got == brute(flows, sight, dt, strict)


def test_ttl_edge_and_own_sighting(spark):
    f = spark.createDataFrame([(1, "a", "x", 5000.0, 1), (2, "a", "x", 5001.0, 1), (3, "b", "x", 0.0, 1)], "flow_id long, src_ip string, dst_ip string, ts double, label int")
    s = spark.createDataFrame([("a", 0.0, .8, 1, 0, 0, 0), ("b", 0.0, .8, 1, 1, 0, 0)], "value string, ts double, conf double, sources int, seq int, role int, ord int")
    tl = cti.timeline(s, 300.0, 0.0)
    got = {r["flow_id"]: r["ioc_src_match"] for r in cti.enrich(f, tl, 300.0, 5000.0, 1.0, 0.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}
    strict = {r["flow_id"]: r["ioc_src_match"] for r in cti.enrich(f, tl, 300.0, 5000.0, 1.0, 0.0, strict=True).collect()}
    assert strict[3] == 0.0


def test_percentiles_match_numpy(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([1.0, 1.0, 1.0, rnd.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    r = ranks.exact_percentiles(df, "v", {"a": .5, "b": .9, "c": .973}).first()
    assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(vals, [50, 90, 97.3]))


def test_rank_is_exact_with_a_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), "id", F.floor(F.col("id") / 50).alias("slot"))
    r = ranks.ranked(df.repartition(6), ["k"], "slot", [F.col("id")], "r").collect()
    for k in ("hot", "cold"):
        got = [x["r"] for x in sorted((x for x in r if x["k"] == k), key=lambda x: x["id"])]
        assert got == list(range(1, len(got) + 1))


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = {r["id"]: r["split"] for r in splits.train_val_test(df.repartition(3), "id").collect()}
    b = {r["id"]: r["split"] for r in splits.train_val_test(df.repartition(9), "id").collect()}
    assert a == b and len(a) == 1003
    pos = [s for i, s in a.items() if i % 10 == 0]
    assert pos.count("test") == 20 and pos.count("val") == 20
    folds = splits.k_folds(df, "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_shap_is_additive_and_matches_subset_enumeration(spark):
    import itertools
    import math

    rnd = random.Random(3)
    rows = [(i, int(a + 2 * b * c > 1.2), a, b, c) for i, (a, b, c) in enumerate((rnd.random(), rnd.random(), rnd.random()) for _ in range(300))]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    vec = ml.prepare(df, ["a", "b", "c"], ("id", "label"))
    model = ml.fit(vec, ml.random_forest(ml.Settings(trees=3, max_depth=4, min_leaf=5)))
    nodes = shap.node_table(model, spark)
    e = shap.explainer(nodes, 3)
    out = shap.explain(ml.score(model, vec), e).collect()
    assert max(abs(sum(r["phi"]) + e.base - r["score"]) for r in out) < 1e-9

    pdf = nodes.toPandas()

    def value(x, known, tree, i=0):
        r = tree[i]
        w = sum(r.stats)
        if r.left < 0:
            return r.stats[1] / w
        if r.feature in known:
            return value(x, known, tree, r.left if x[r.feature] <= r.threshold else r.right)
        return sum(sum(tree[k].stats) / w * value(x, known, tree, k) for k in (r.left, r.right))

    x = np.array([rows[0][2:]])
    want = np.zeros(3)
    trees = [{int(r.node): r for r in t.itertuples()} for _, t in pdf.groupby("tree")]
    for t in trees:
        for j in range(3):
            rest = [k for k in range(3) if k != j]
            for n in range(3):
                for sub in itertools.combinations(rest, n):
                    weight = math.factorial(n) * math.factorial(2 - n) / 6
                    want[j] += weight * (value(x[0], {*sub, j}, t) - value(x[0], set(sub), t)) / len(trees)
    assert np.allclose(shap.shap_matrix(e, x)[0], want)


def test_fan_out_survives_a_broken_sink(spark):
    got = []

    def bad(df, b):
        raise OSError

    emit = sinks.fan_out({"bad": bad, "good": lambda df, b: got.append(df.count())})
    emit(spark.range(5), 0)
    assert got == [5] and emit.errors == {"bad": 1, "good": 0}


def test_latest_keeps_newest_record(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "alert_id string, seq int")
    assert [tuple(r) for r in al.latest(df, 5).collect()] == [("a", 3), ("b", 2)]


def test_bundle_aligns_any_batch(spark):
    b = ml.Bundle("p", ["dur", "ghost"], {"proto": ["tcp"], "service": ["http"]}, .5)
    df = spark.createDataFrame([(1, 2.0, "tcp"), (2, float("inf"), None)], "id int, dur double, proto string")
    rows = b.design(df, ("id",)).orderBy("id").collect()
    assert rows[0].asDict() == {"id": 1, "dur": 2.0, "ghost": 0.0, "proto_tcp": 1.0, "proto_OTHER": 0.0, "proto_UNK": 0.0,
                                "service_http": 0.0, "service_OTHER": 0.0, "service_UNK": 0.0}
    assert rows[1]["dur"] == 0.0 and rows[1]["proto_UNK"] == 1.0


def test_address_filter_keeps_all_members(spark):
    """No member is lost, null is none, and few others pass."""
    for n in (1, 700, 5000):
        values = spark.range(n).select(F.concat(F.lit("10.0."), F.col("id").cast("string")).alias("value"))
        may = cti.address_filter(values, n)
        others = spark.range(20000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("value"))
        assert values.where(may("value")).count() == n
        assert others.where(may("value")).count() < 20000 * 0.03
        assert spark.sql("select cast(null as string) as value").where(F.coalesce(may("value"), F.lit(False))).count() == 0
