"""Detection metrics, experiment summaries, sampling and splits."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import splits as sp
from . import views as v
from .registry import query, table

THETA = 0.02
CURVE = """,
per as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1),
cv as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
 sum(pos) over () as n_pos, sum(neg) over () as n_neg from per)
"""
FOLD_CURVE = """,
per as (select fold, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1, 2),
cv as (select *, sum(pos) over (partition by fold order by score desc) as tp, sum(neg) over (partition by fold order by score desc) as fp,
 sum(pos) over (partition by fold) as n_pos, sum(neg) over (partition by fold) as n_neg from per)
"""
AP = "sum(pos / n_pos * (tp / (tp + fp)))"
AUC = "sum(neg * (tp - pos / 2)) / (max(n_pos)::double * max(n_neg))"
CONF = """select {by} count(*) filter (score < 0.02 and label = 0) as tn, count(*) filter (score >= 0.02 and label = 0) as fp,
 count(*) filter (score < 0.02 and label = 1) as fn, count(*) filter (score >= 0.02 and label = 1) as tp from scored {group}"""
RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
 round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(fp / (fp + tn), 6) as fpr"""


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("met_confusion", v.cte("scored") + f", c as ({CONF.format(by='', group='')}) select tn, fp, fn, tp, tp + fp + tn + fn as n,"
       f" tp + fp as n_alerts, 0.02 as theta, {RATES} from c")
def met_confusion(spark, sf):
    return rounded(m.confusion(v.scored(spark, sf), THETA), "accuracy", "precision", "recall", "f1", "fpr")


@query("met_pr_curve", v.cte("scored") + CURVE + """select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
 round(tp / (tp + fp), 6) as precision, round(tp / n_pos, 6) as recall from cv""")
def met_pr_curve(spark, sf):
    return rounded(m.curve(v.scored(spark, sf)), "precision", "recall").select("score", "tp", "fp", "precision", "recall")


@query("met_ap", v.cte("scored") + CURVE + f"select round({AP}, 8) as pr_auc from cv")
def met_ap(spark, sf):
    return rounded(m.average_precision(m.curve(v.scored(spark, sf))), "pr_auc", digits=8)


@query("met_auc", v.cte("scored") + CURVE + f"select round({AUC}, 8) as roc_auc from cv")
def met_auc(spark, sf):
    return rounded(m.roc_auc(m.curve(v.scored(spark, sf))), "roc_auc", digits=8)


@query("met_theta", v.cte("scored") + CURVE + "select max(score) filter (tp / n_pos >= 0.96) as theta from cv")
def met_theta(spark, sf):
    return m.threshold_at_recall(m.curve(v.scored(spark, sf)), 0.96)


FOLDS = FOLD_CURVE + f""", c as ({CONF.format(by='fold,', group='group by fold')}),
f as (select fold, {RATES}, pr_auc, roc_auc from c join (select fold, {AP} as pr_auc, {AUC} as roc_auc from cv group by fold) using (fold))"""


@query("met_folds", v.cte("scored") + FOLDS + " select * replace (round(pr_auc, 6) as pr_auc, round(roc_auc, 6) as roc_auc) from f")
def met_folds(spark, sf):
    r = m.metrics_at(v.scored(spark, sf), THETA, ["fold"])
    return rounded(r, *m.NAMES).select("fold", *m.NAMES)


@query("met_cv_agg", v.cte("scored") + FOLDS.replace(", 6) as", ", 12) as") + """
select metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(*) as n_folds
from (unpivot f on accuracy, precision, recall, f1, pr_auc, roc_auc, fpr into name metric value value) group by 1""")
def met_cv_agg(spark, sf):
    r = m.metrics_at(v.scored(spark, sf), THETA, ["fold"])
    return rounded(m.fold_aggregate(r), "mean", "std")


@query("abl_reduction", v.cte("scored") + """,
c as (select proto as variant, count(*) filter (score >= 0.02 and label = 0) / count(*) filter (label = 0) as fpr from scored group by 1)
select variant, round(b.fpr, 6) as base_fpr, round(c.fpr, 6) as fpr, round((b.fpr - c.fpr) / b.fpr, 6) as relative_reduction
from c, (select fpr from c where variant = 'tcp') b where variant <> 'tcp'""")
def abl_reduction(spark, sf):
    rows = m.confusion(v.scored(spark, sf), THETA, ["proto"]).withColumnRenamed("proto", "variant")
    return rounded(m.fpr_reduction(rows, "tcp"), "base_fpr", "fpr", "relative_reduction")


@query("fresh_score_q", v.cte("scored") + """
select label, round(quantile_cont(score, 0.5), 8) as p50, round(quantile_cont(score, 0.9), 8) as p90,
 round(quantile_cont(score, 0.96), 8) as p96, round(quantile_cont(score, 0.99), 8) as p99 from scored group by 1""")
def fresh_score_q(spark, sf):
    return rounded(m.score_quantiles(v.scored(spark, sf)), "p50", "p90", "p96", "p99", digits=8)


@query("lat_percentiles", """
with t as (select case event_id % 3 when 0 then 16 when 1 then 64 else 256 end as batch_size, value as enrich, value * 2 as design,
 value + event_id % 10 as predict from events),
l as (unpivot t on enrich, design, predict into name stage value seconds)
select batch_size, stage, round(avg(seconds), 6) as mean, round(max(seconds), 6) as max, count(*) as n,
 round(quantile_cont(seconds, 0.5), 6) as p50, round(quantile_cont(seconds, 0.95), 6) as p95 from l group by all""")
def lat_percentiles(spark, sf):
    e, eid = table(spark, sf, "events"), F.col("event_id")
    t = e.select(v._pick(eid % 3, {0: 16, 1: 64}, 256).alias("batch_size"), F.col("value").alias("enrich"),
                 (F.col("value") * 2).alias("design"), (F.col("value") + eid % 10).alias("predict"))
    return rounded(m.latency_percentiles(t, ["enrich", "design", "predict"]), "mean", "max", "p50", "p95")


@query("xfer_gap", v.cte("scored") + FOLDS + """,
k as (select 'd' || ((fold + 1) // 2) as direction, case when fold % 2 = 1 then 'cross' else 'in_domain' end as kind, * from f),
l as (unpivot k on recall, fpr, precision, pr_auc, roc_auc, f1 into name metric value value)
select direction, metric, round(max(value) filter (kind = 'cross'), 6) as "cross", round(max(value) filter (kind = 'in_domain'), 6) as in_domain,
 round(max(value) filter (kind = 'in_domain') - max(value) filter (kind = 'cross'), 5) as gap from l group by all""")
def xfer_gap(spark, sf):
    """Folds stand in for the evaluations of the directions; the last has no in-domain side."""
    r = rounded(m.metrics_at(v.scored(spark, sf), THETA, ["fold"]), *[n for n in m.NAMES if n not in ("pr_auc", "roc_auc")])
    rows = r.select(
        F.concat(F.lit("d"), F.floor((F.col("fold") + 1) / 2)).alias("direction"),
        F.when(F.col("fold") % 2 == 1, "cross").otherwise("in_domain").alias("kind"), *m.NAMES)
    return rounded(rounded(m.transfer_gap(rows), "cross", "in_domain"), "gap", digits=5)


@query("prof_delta", v.cte("scored") + FOLDS + """,
l as (unpivot (select fold, accuracy, recall, pr_auc, fpr from f) on accuracy, recall, pr_auc, fpr into name metric value value)
select cast(b.fold as int) as fold, metric, round(case when metric = 'fpr' then b.value - a.value else round((b.value - a.value) * 100, 3) end, 5) as delta
from l b join (select metric, value from l where fold = 1) a using (metric) where b.fold > 1""")
def prof_delta(spark, sf):
    """Every other fold's profile against the first."""
    r = rounded(m.metrics_at(v.scored(spark, sf), THETA, ["fold"]), "accuracy", "recall", "fpr").withColumn(
        "profile", F.concat(F.lit("p"), "fold"))
    rows = [m.profile_delta(r, "p1", f"p{f}").select(F.lit(f).alias("fold"), "metric", "delta") for f in range(2, 6)]
    return rounded(reduce(DataFrame.unionByName, rows), "delta", digits=5)


@query("ml_class_weight", v.cte("flows") + """
select label, count(*) as n_c, round((select count(*) from flows) / (2 * count(*)), 8) as weight from flows group by 1""")
def ml_class_weight(spark, sf):
    return rounded(m.class_weights(v.flows(spark, sf)), "weight", digits=8)


# ------------------------------------------------------------------ sampling
RANKED = """, h as (select *, row_number() over (partition by label order by md5('42:' || flow_id)) as r,
 count(*) over (partition by label) as n_c, count(*) over () as n from flows)
"""


@query("smp_stratified", v.cte("flows") + RANKED + "select flow_id, label from h where r <= greatest(1, round_even(n_c * (3000 / n), 0))")
def smp_stratified(spark, sf):
    return sp.stratified_subsample(v.flows(spark, sf), 3000, 42, "flow_id").select("flow_id", "label")


@query("split_tvt", v.cte("flows") + RANKED + """
select flow_id, case when r <= round_even(n_c * 0.2, 0) then 'test' when r <= 2 * round_even(n_c * 0.2, 0) then 'val' else 'train' end as split from h""")
def split_tvt(spark, sf):
    return sp.train_val_test(v.flows(spark, sf), "flow_id").select("flow_id", "split")


@query("split_kfold", v.cte("flows") + RANKED + """
select flow_id, cast((r - 1) % 5 + 1 as int) as fold, round(((r - 1) // 5) / ceil(n_c / 5), 8) as "inner" from h""")
def split_kfold(spark, sf):
    return rounded(sp.k_folds(v.flows(spark, sf), "flow_id").select("flow_id", "fold", "inner"), "inner", digits=8)


@query("smp_alerts", v.cte("alerts") + "select alert_id from alerts order by md5('42:' || alert_id) limit 300")
def smp_alerts(spark, sf):
    return sp.seeded_sample(v.alerts(spark, sf), 300, "alert_id").select("alert_id")


@query("smp_folds", v.cte("scored") + """
select flow_id, fold from (select *, row_number() over (partition by fold order by md5('42:' || flow_id)) as r from scored) where r <= 500""")
def smp_folds(spark, sf):
    return sp.seeded_sample(v.scored(spark, sf), 500, "flow_id", 42, ["fold"]).select("flow_id", "fold")
