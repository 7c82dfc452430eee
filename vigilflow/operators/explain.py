"""Reason codes from feature contributions, and the stability of explanations across folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attack import attack_ref, map_features, reason_text
from .cti import FEATURES as CTI

PLACEHOLDER = "model score driven by negative (risk-reducing) contributions only"


def contributions(features: Sequence[str], values, phi) -> Column:
    """array of struct(pos, feature, value, shap) from a literal name list and two arrays."""
    names = F.array(*[F.lit(f) for f in features])
    return F.transform(
        F.arrays_zip(names.alias("feature"), F.col(values).alias("value"), F.col(phi).alias("shap")),
        lambda e, i: F.struct(i.alias("pos"), e["feature"].alias("feature"), e["value"].alias("value"), e["shap"].alias("shap")))


def top_positive(contribs, k: int = 3) -> Column:
    """The ``k`` largest positive contributions; ties keep feature order. A per-row sort, no shuffle."""
    c = F.col(contribs) if isinstance(contribs, str) else contribs
    keyed = F.transform(F.filter(c, lambda e: e["shap"] > 0), lambda e: F.struct(
        (-e["shap"]).alias("k"), e["pos"].alias("pos"), e["feature"].alias("feature"), e["value"].alias("value"),
        e["shap"].alias("shap")))
    return F.slice(F.array_sort(keyed), 1, k)


def _code(feature: Column, value: Column, shap: Column, text: Column) -> Column:
    ref = attack_ref(feature)
    return F.struct(feature.alias("feature"), F.bround(value, 4).alias("value"), F.bround(shap, 5).alias("shap"),
                    text.alias("reason"), ref["tactic"].alias("tactic"), ref["technique"].alias("technique"))


def reason_codes(df: DataFrame, contribs: str = "contribs", k: int = 3, out: str = "reasons") -> DataFrame:
    """Add the ranked reasons of each row.

    A matched indicator is always named, even when traffic features contribute more; a row without any
    positive contribution gets a placeholder. Wants the indicator features next to ``contribs``.
    """
    d = df.withColumn("_top", top_positive(contribs, k))
    codes = F.transform("_top", lambda e: _code(e["feature"], e["value"], e["shap"], reason_text(e["feature"], e["value"])))
    src, dst = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("ioc_src_match", "ioc_dst_match"))

    def num(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    side = F.when(dst != 0, "destination").otherwise("source")
    name = F.when(dst != 0, "ioc_dst_match").otherwise("ioc_src_match")
    text = F.format_string("%s IP is on the live CTI feed (freshness %.2f, confidence %.2f, %d source(s))",
                           side, num("feed_age_score"), num("feed_confidence"), num("source_count").cast("int"))
    forced = F.array(_code(name, F.lit(1.0), F.lit(None).cast("double"), text))
    named = F.exists("_top", lambda e: e["feature"].isin(*CTI))
    nothing = F.array(F.struct(
        F.lit("-").alias("feature"), F.lit(0.0).alias("value"), F.lit(0.0).alias("shap"), F.lit(PLACEHOLDER).alias("reason"),
        F.lit("Uncategorised").alias("tactic"), F.lit("-").alias("technique")))
    matched = (src != 0) | (dst != 0)
    reasons = (
        F.when(matched & ~named, F.concat(codes, forced)).when(F.size("_top") == 0, nothing).otherwise(codes))
    return d.withColumn(out, reasons).drop("_top")


# ------------------------------------------------------------------ audit
def strength(phi_rows: DataFrame, features: Sequence[str], phi: str = "phi", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature: one aggregate over the arrays, without exploding rows."""
    means = [F.avg(F.abs(F.get(phi, F.lit(i)))).alias(f"_{i}") for i in range(len(features))]
    wide = phi_rows.groupBy(*by).agg(*means)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("strength")) for i, f in enumerate(features)])
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.feature", "p.strength")


def top_features(s: DataFrame, k: int = 10, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Top-k per fold as a list; ``s`` holds one row per fold and feature."""
    w = Window.partitionBy(*by).orderBy(F.col("strength").desc(), "feature")
    r = s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return r.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "feature"))), lambda e: e["feature"]).alias("top"))


def tactic_distribution(s: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Share of the absolute contribution mass per tactic."""
    m = s.join(F.broadcast(map_features(s)), "feature")  # one row per feature name
    per = m.groupBy(*by, "tactic").agg(F.sum(F.abs("strength")).alias("mass"))
    w = Window.partitionBy(*by)  # a dozen tactics per fold
    total = F.sum("mass").over(w)
    return per.select(*by, "tactic", F.coalesce(F.try_divide("mass", total), F.lit(0.0)).alias("share"))


def fold_pairs(tops: DataFrame) -> DataFrame:
    """Each pair of folds once; one row per fold comes in."""
    a, b = tops.select(F.col("fold").alias("a"), F.col("top").alias("ta")), tops.select(F.col("fold").alias("b"), F.col("top").alias("tb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def top_k_jaccard(tops: DataFrame) -> DataFrame:
    j = fold_pairs(tops).select(jaccard(F.col("ta"), F.col("tb")).alias("j"))
    return j.agg(F.coalesce(F.avg("j"), F.lit(1.0)).alias("mean"), F.coalesce(F.min("j"), F.lit(1.0)).alias("min"),
                 F.count(F.lit(1)).alias("pairs"))


def tactic_stability(dist: DataFrame) -> DataFrame:
    """Mean top-4 Jaccard and mean total-variation distance between fold distributions."""
    ranked = dist.select("fold", F.col("tactic").alias("feature"), F.col("share").alias("strength"))
    jac = top_k_jaccard(top_features(ranked, 4)).select("mean").scalar()
    # folds x tactics is a small grid; missing cells count as 0
    a = dist.select(F.col("fold").alias("a"), "tactic", F.col("share").alias("sa"))
    b = dist.select(F.col("fold").alias("b"), "tactic", F.col("share").alias("sb"))
    folds = dist.select("fold").distinct()
    pairs = folds.select(F.col("fold").alias("a")).join(folds.select(F.col("fold").alias("b")), F.col("a") < F.col("b"))
    grid = pairs.join(a, "a").unionByName(pairs.join(b, "b"), allowMissingColumns=True)
    cell = grid.groupBy("a", "b", "tactic").agg(F.sum("sa").alias("sa"), F.sum("sb").alias("sb"))
    tv = cell.groupBy("a", "b").agg((F.sum(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0)))) / 2).alias("tv"))
    return tv.agg(F.coalesce(F.avg("tv"), F.lit(0.0)).alias("mean_tv_distance")).withColumn("mean_top4_jaccard", jac)


def mean_distribution(dist: DataFrame) -> DataFrame:
    n = dist.agg(F.count_distinct("fold")).scalar()
    return dist.groupBy("tactic").agg(F.sum("share").alias("s")).select("tactic", (F.col("s") / n).alias("share"))


def reason_audit(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes per tactic, share of alerts with an indicator reason)."""
    tactics = alerts.select(F.explode("reasons.tactic").alias("tactic")).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))
    has = F.exists("reasons", lambda r: r["feature"].isin(*CTI))
    share = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(has).alias("with_cti"),
                       F.coalesce(F.avg(has.cast("int")), F.lit(0.0)).alias("share"))
    return tactics, share
