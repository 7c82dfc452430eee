"""Model, explanation and experiment queries. ``ml_rf`` and ``exp_baseline`` fit models of full size, the others small
ones; sizes are settings."""

from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import explain as ex
from ..operators import metrics as m
from ..operators import models as ml
from ..operators import shap
from . import experiments as xp
from . import q_cti
from . import views as v
from .q_functions import cic_like, unsw_like
from .q_metrics import CONF, RATES, rounded
from .q_sources import _dir
from .registry import query, table

S = ml.Settings(trees=10, max_depth=6, boost_rounds=5, folds=5)
FULL = ml.Settings()


def _design(spark, sf):
    e = ft.add_rates(q_cti._enriched(spark, sf, ttl=604800.0, injection=True))
    return xp.designed(e)


def _forest(spark, sf):
    d, feats, num, vocab = _design(spark, sf)
    p = xp.parts(d, feats)
    return d, feats, num, vocab, p, ml.fit(p.where("split = 'train'"), ml.random_forest(S))


def _one(spark, sf, make, s=S):
    d, feats, _, _ = _design(spark, sf)
    _, _, r = ml.fit_and_score(xp.parts(d, feats), make(s), s.target_recall)
    return r.select(*m.NAMES, "theta", "n", "n_alerts")


@query("ml_rf")
def ml_rf(spark, sf):
    return _one(spark, sf, ml.random_forest, FULL)


@query("ml_gbt")
def ml_gbt(spark, sf):
    return _one(spark, sf, ml.gradient_boosting)


@query("ml_svm")
def ml_svm(spark, sf):
    return _one(spark, sf, ml.linear_svm)


@query("ml_fit_score")
def ml_fit_score(spark, sf):
    """Scores of the test rows at the threshold tuned on the validation rows."""
    d, feats, _, _ = _design(spark, sf)
    p = xp.parts(d, feats)
    model, theta, _ = ml.fit_and_score(p, ml.random_forest(S), S.target_recall)
    return ml.score(model, p.where("split = 'test'")).select("flow_id", "label", "score", (F.col("score") >= theta).alias("alert"))


@query("ml_cv")
def ml_cv(spark, sf):
    d, feats, _, _ = _design(spark, sf)
    p = ml.prepare(d, feats, ("flow_id", "label"))
    return m.fold_aggregate(ml.cross_validate(p, "flow_id", ml.random_forest, S))


@query("ml_importance")
def ml_importance(spark, sf):
    _, feats, _, _, _, model = _forest(spark, sf)
    return ml.importance(model, feats, spark)


@query("ml_bundle", v.cte("flows") + "select count(*) as n, count(*) as equal from flows")
def ml_bundle(spark, sf):
    """Saved, loaded, and applied to raw enriched flows: the scores of both must agree."""
    d, feats, num, vocab, p, model = _forest(spark, sf)
    path = _dir(spark, "bundle")
    ml.save_bundle(ml.Bundle("unsw_full", num, vocab, 0.5, {"seed": S.seed}), model, path)
    bundle, loaded = ml.load_bundle(spark, path)
    e = ft.add_rates(q_cti._enriched(spark, sf, ttl=604800.0, injection=True))
    served = ml.score(loaded, ml.prepare(bundle.design(e, ("flow_id",)), bundle.features, ("flow_id",)))
    trained = ml.score(model, p).select("flow_id", F.col("score").alias("trained"))
    return served.select("flow_id", "score").join(trained, "flow_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("score") - F.col("trained")) < 1e-12).alias("equal"))


@query("ml_tree_stats")
def ml_tree_stats(spark, sf):
    _, _, _, _, _, model = _forest(spark, sf)
    return shap.tree_stats(shap.node_table(model, spark))


@query("shap_values")
def shap_values(spark, sf):
    """Contributions of every flow, with their sum against the model's probability."""
    _, feats, _, _, p, model = _forest(spark, sf)
    e = shap.explainer(shap.node_table(model, spark), len(feats))
    phi = shap.explain(ml.score(model, p), e)
    total = F.aggregate("phi", F.lit(e.base), lambda a, x: a + x)
    return phi.select("flow_id", "score", total.alias("rebuilt"), (F.abs(total - F.col("score")) < 1e-9).alias("additive"))


@query("explain_alerts")
def explain_alerts(spark, sf):
    d, feats, _, _, p, model = _forest(spark, sf)
    theta = m.theta_of(xp.cut(ml.score(model, p.where("split = 'val'")).select("label", "score")), S.target_recall)
    r = xp.explain_alerts(model, d.where("split = 'test'"), feats, theta)
    return r.select("flow_id", "label", "attack_cat", "ts", F.bround("score", 4).alias("score"), F.explode("reasons").alias("r")).select(
        "flow_id", "label", "attack_cat", "ts", "score", "r.*")


@query("exp_baseline")
def exp_baseline(spark, sf):
    d, feats, _, _ = _design(spark, sf)
    return xp.baseline(d, {k: x for k, x in ft.ablation_groups(feats).items() if k in ("traffic_only", "traffic_cti")}, FULL)


@query("exp_ablation")
def exp_ablation(spark, sf):
    """Feature groups under controlled injection, the traffic-only control, and true live-feed features."""
    d, feats, num, vocab = _design(spark, sf)
    live = ft.add_rates(q_cti._enriched(spark, sf, ttl=604800.0))
    live_d = xp.cut(ft.design(live, num, vocab, ("flow_id", "label")).join(d.select("flow_id", "split"), "flow_id"))
    rows = xp.ablation(d, feats, S, {"traffic_plus_live_cti": live_d})
    return rows.join(m.fpr_reduction(rows, "traffic_only").select("variant", "relative_reduction"), "variant", "left")


def _fresh(spark, sf):
    f = v.flows(spark, sf)
    t0 = v.start(f)
    s = q_cti.cti.build_sightings(v.iocs(spark, sf), f)
    return xp.freshness(f, xp.cut(s), (1, 5, 60, 360, 1440), 604800.0, 21600.0, t0, S)


@query("exp_freshness")
def exp_freshness(spark, sf):
    return _fresh(spark, sf)


@query("exp_stability")
def exp_stability(spark, sf):
    d, feats, _, _ = _design(spark, sf)
    st = xp.stability(d, feats, S)  # one row per fold and feature
    jac = ex.top_k_jaccard(ex.top_features(st, 10)).withColumnsRenamed({"mean": "mean_top10_jaccard", "min": "min_top10_jaccard"})
    tac = ex.tactic_stability(ex.tactic_distribution(st))
    return jac.withColumns({c: tac.select(c).scalar() for c in tac.columns})


@query("exp_transfer")
def exp_transfer(spark, sf):
    e = xp.cut(q_cti._enriched(spark, sf, ttl=604800.0, injection=True))
    sides = {"unsw_nb15": ft.bridge(unsw_like(e), "unsw_nb15", ("flow_id", "label")),
             "cicids2017": ft.bridge(cic_like(e), "cicids2017", ("flow_id", "label"))}
    feats = [c for c in sides["unsw_nb15"].columns if c not in ("flow_id", "label")]
    rows = xp.transfer(sides, feats, S)
    gap = m.transfer_gap(rows.where("kind <> 'cross_full'"))
    full = rows.where("kind = 'cross_full'").unpivot("direction", list(m.NAMES), "metric", "cross_full")
    return gap.join(full, ["direction", "metric"], "left")


@query("report_status", v.cte("scored") + f""",
c as ({CONF.format(by='proto,', group='group by proto')}),
r as (select proto as "row", {RATES} from c)
select 'by_protocol' as experiment, "row", metric, round(value, 6) as value from (unpivot r on accuracy, precision, recall, f1, fpr into name metric value value)
union all select 'flows', proto, 'n', count(*) from scored group by proto""")
def report_status(spark, sf):
    sc = v.scored(spark, sf)
    a = m.confusion(sc, 0.02, ["proto"]).select("proto", "accuracy", "precision", "recall", "f1", "fpr")
    b = sc.groupBy("proto").agg(F.count(F.lit(1)).alias("n"))
    return rounded(xp.report({"by_protocol": a, "flows": b}), "value")


# the sweep's coverage side alone, which SQL can state
_SWEEP = (1, 5, 60, 360, 1440)


def _cov_sql(minutes):
    return (f"(with {q_cti.enriched_cte(minutes * 60.0, 86400.0)} select {minutes}.0 as interval_min, avg(ioc_src_match + ioc_dst_match) as recall, "
            "avg(ioc_src_match + ioc_dst_match) filter (label = 1) as coverage_malicious, "
            "avg(ioc_src_match + ioc_dst_match) filter (label = 0) as matched_fpr from enriched)")


@query("fresh_sweep", v.cte("entries", "t0") + ", s as (" + " union all ".join(_cov_sql(x) for x in _SWEEP) + """),
o as (select *, lag(recall) over (order by interval_min) as r, lag(coverage_malicious) over (order by interval_min) as c from s),
a as (select * from s where interval_min = 5), b as (select * from s where interval_min = 1440)
select round(a.recall - b.recall, 6) as recall_gap, round(a.coverage_malicious - b.coverage_malicious, 6) as coverage_gap,
 round(b.matched_fpr - a.matched_fpr, 6) as matched_fpr_gap, round(b.matched_fpr / a.matched_fpr, 6) as matched_fpr_ratio,
 (select bool_and(coalesce(r >= recall - 1e-6, true)) from o) as monotone_recall,
 (select bool_and(coalesce(c >= coverage_malicious - 1e-6, true)) from o) as monotone_coverage from a, b""")
def fresh_sweep(spark, sf):
    """Flag-as-detector sweep: an indicator match counts as the alert."""
    rows = None
    for minutes in _SWEEP:
        c = q_cti._enriched(spark, sf, dt=minutes * 60.0, ttl=86400.0).withColumn("hit", q_cti.cti.matched().cast("int"))
        r = c.agg(F.lit(float(minutes)).alias("interval_min"), F.avg("hit").alias("recall"),
                  F.avg(F.when(F.col("label") == 1, F.col("hit"))).alias("coverage_malicious"),
                  F.avg(F.when(F.col("label") == 0, F.col("hit"))).alias("matched_fpr"))
        rows = r if rows is None else rows.unionByName(r)
    return rounded(m.sweep_summary(rows), "recall_gap", "coverage_gap", "matched_fpr_gap", "matched_fpr_ratio")
