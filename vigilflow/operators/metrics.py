"""Exact detection metrics over distributed scores.

Everything starts from one row per distinct score, so ties are merged map-side and ordered work is cut
into score ranges (see :mod:`ranks`). ``by`` computes the same per group, e.g. per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_percentiles, running_totals, with_ranges

NAMES = ("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "fpr")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, theta, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Counts and rates at a threshold; a zero denominator gives 0. ``theta`` is a number or a column."""
    theta = theta if isinstance(theta, Column) else F.lit(float(theta))
    hit, bad = F.col(score) >= theta, F.col(label) == 1
    c = scored.groupBy(*by).agg(
        F.count_if(~hit & ~bad).alias("tn"), F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"), F.count_if(hit & bad).alias("tp"),
        F.max(theta).alias("theta"),
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(
        *by, "theta", "tn", "fp", "fn", "tp", (tn + fp + fn + tp).alias("n"), (tp + fp).alias("n_alerts"),
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("fpr"),
    )


def curve(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score with cumulative hits, precision and recall at that threshold."""
    per = scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    cum = running_totals(with_ranges(per, "score"), [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, by, True)
    totals = per.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        cum = cum.join(F.broadcast(totals), list(by))  # one row per group
    else:
        cum = cum.withColumn("_t", totals.select(F.struct("n_pos", "n_neg")).scalar()).select("*", "_t.*").drop("_t")
    return cum.select(
        *by, "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(1.0).alias("recall"),
    )


def average_precision(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall increments."""
    return c.groupBy(*by).agg(
        F.coalesce(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("precision")), F.lit(0.0)).alias("pr_auc"))


def roc_auc(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid over tied scores; NULL when a class is missing."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return c.groupBy(*by).agg(
        F.sum(F.try_divide(area, F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"))


def threshold_at_recall(c: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Largest score that still reaches the target recall; else the one of highest recall."""
    reach = F.max(F.when(F.col("recall") >= target, F.col("score")))
    best = F.max_by("score", F.struct("recall", -F.col("score")))
    return c.groupBy(*by).agg(F.coalesce(reach, best, F.lit(0.5)).alias("theta"))


def theta_of(scored: DataFrame, target: float, label: str = "label", score: str = "score") -> float:
    """The tuned threshold as a number (one row leaves the cluster)."""
    return float(threshold_at_recall(curve(scored, (), label, score), target).first()["theta"])


def metrics_at(scored: DataFrame, theta, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts, rates, average precision and ROC area: one row per group."""
    c = curve(scored, by, label, score)
    ranks = c.groupBy(*by).agg(
        F.coalesce(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("precision")), F.lit(0.0)).alias("pr_auc"),
        F.sum(F.try_divide(F.col("neg") * (F.col("tp") - F.col("pos") / 2),
                           F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"))
    conf = confusion(scored, theta, by, label, score)
    if by:
        return conf.join(ranks, list(by))
    return conf.withColumn("_r", ranks.select(F.struct("pr_auc", "roc_auc")).scalar()).select("*", "_r.*").drop("_r")


def fold_aggregate(folds: DataFrame, by: Sequence[str] = (), names: Sequence[str] = NAMES) -> DataFrame:
    """Mean and sample standard deviation of each metric; the deviation of one fold is 0."""
    long = folds.unpivot([*by], list(names), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_folds"))


def fpr_reduction(variants: DataFrame, base: str, by: Sequence[str] = ()) -> DataFrame:
    """Relative false-positive reduction of every variant against ``base``; NULL when the base is 0."""
    b = variants.where(F.col("variant") == base).select(*by, F.col("fpr").alias("base_fpr"))
    rest = variants.where(F.col("variant") != base)
    joined = rest.join(F.broadcast(b), list(by)) if by else rest.withColumn("base_fpr", b.select("base_fpr").scalar())
    return joined.select(
        *by, "variant", "base_fpr", "fpr",
        F.try_divide(F.col("base_fpr") - F.col("fpr"), F.col("base_fpr")).alias("relative_reduction"))


def sweep_summary(rows: DataFrame, short: float = 5.0, slack: float = 1e-6) -> DataFrame:
    """Gaps between the short and the longest interval and monotone flags; one row per interval comes in."""
    w = Window.orderBy("interval_min")  # a handful of swept intervals
    r = rows.select("*", F.lag("recall").over(w).alias("_r"), F.lag("coverage_malicious").over(w).alias("_c"))
    long = F.max_by(F.struct("recall", "coverage_malicious", "matched_fpr"), "interval_min")
    near = F.coalesce(
        F.max(F.when(F.col("interval_min") == short, F.struct("recall", "coverage_malicious", "matched_fpr"))),
        F.min_by(F.struct("recall", "coverage_malicious", "matched_fpr"), "interval_min"))
    a = r.agg(
        near.alias("s"), long.alias("l"),
        F.bool_and(F.coalesce(F.col("_r") >= F.col("recall") - slack, F.lit(True))).alias("monotone_recall"),
        F.bool_and(F.coalesce(F.col("_c") >= F.col("coverage_malicious") - slack, F.lit(True))).alias("monotone_coverage"))
    return a.select(
        (F.col("s.recall") - F.col("l.recall")).alias("recall_gap"),
        (F.col("s.coverage_malicious") - F.col("l.coverage_malicious")).alias("coverage_gap"),
        (F.col("l.matched_fpr") - F.col("s.matched_fpr")).alias("matched_fpr_gap"),
        F.try_divide(F.col("l.matched_fpr"), F.col("s.matched_fpr")).alias("matched_fpr_ratio"),
        "monotone_recall", "monotone_coverage")


def score_quantiles(scored: DataFrame, qs=(0.5, 0.9, 0.96, 0.99), label: str = "label", score: str = "score") -> DataFrame:
    return exact_percentiles(scored, score, {f"p{round(q * 100)}": q for q in qs}, [label])


def latency_percentiles(timings: DataFrame, stages: Sequence[str], by: Sequence[str] = ("batch_size",)) -> DataFrame:
    """p50, p95, mean, max and count per stage and batch size."""
    long = timings.unpivot([*by], list(stages), "stage", "seconds")
    keys = [*by, "stage"]
    basic = long.groupBy(*keys).agg(F.avg("seconds").alias("mean"), F.max("seconds").alias("max"),
                                    F.count("seconds").alias("n"))
    return basic.join(exact_percentiles(long, "seconds", {"p50": 0.5, "p95": 0.95}, keys), keys)


def transfer_gap(rows: DataFrame) -> DataFrame:
    """In-domain minus cross value per direction and metric; wants ``direction, kind, <metrics>``."""
    names = ("recall", "fpr", "precision", "pr_auc", "roc_auc", "f1")
    long = rows.unpivot(["direction", "kind"], list(names), "metric", "value")
    wide = long.groupBy("direction", "metric").pivot("kind", ["cross", "in_domain"]).agg(F.max("value"))
    return wide.withColumn("gap", F.col("in_domain") - F.col("cross"))


def profile_delta(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Profile ``b`` minus profile ``a``: percentage points, and the absolute difference for fpr."""
    long = rows.where(F.col("profile").isin(a, b)).unpivot(
        ["profile"], ["accuracy", "recall", "pr_auc", "fpr"], "metric", "value")
    wide = long.groupBy("metric").pivot("profile", [a, b]).agg(F.max("value"))
    diff = F.col(f"`{b}`") - F.col(f"`{a}`")
    return wide.select("metric", F.when(F.col("metric") == "fpr", diff).otherwise(F.bround(diff * 100, 3)).alias("delta"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.agg(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n_c", (F.col("_t.n") / (F.col("_t.k") * F.col("n_c"))).alias("weight"))
