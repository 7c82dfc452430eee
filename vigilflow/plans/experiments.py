"""The evaluation protocols: baselines, ablation, freshness sweep, explanation stability, transfer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import cti, explain as ex, metrics as m, models as ml, shap
from ..operators.splits import seeded_sample, split_alike, train_val_test
from ..session import cut

METRICS = ("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "fpr", "theta", "n", "n_alerts")


def _union(rows) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _tag(df: DataFrame, **lits) -> DataFrame:
    return df.select(*[F.lit(x).alias(k) for k, x in lits.items()], *METRICS)


def designed(enriched: DataFrame, key: str = "flow_id", pool_floor: int = 50, seed: int = 42, skip=(), stored: bool = False):
    """(design with ids, label and split; feature names). The vocabulary comes from the given rows."""
    # vocabulary, ranks of the split and design each read the enriched rows: the as-of join runs once
    enriched = enriched if stored else cut(enriched)
    num, cat = ft.split_types(enriched, drop=(key, "age_s", *skip))
    vocab = ft.freeze(ft.build_vocabulary(enriched, cat, floor=pool_floor))
    d = ft.design(enriched, num, vocab, (key, "ts", "label", "attack_cat"))
    # every fit and score below reads this: materialise it once
    return cut(train_val_test(d, key, seed)), ft.design_names(num, vocab), num, vocab


def parts(design: DataFrame, features, key: str = "flow_id") -> DataFrame:
    return ml.prepare(design, features, (key, "label", "split"))


def baseline(design: DataFrame, variants: dict[str, list[str]], s: ml.Settings, models=tuple(ml.COMPARATORS)) -> DataFrame:
    """Every comparator on every feature set, thresholds at matched recall."""
    rows = []
    for name, feats in variants.items():
        p = parts(design, feats)
        for model in models:
            _, _, r = ml.fit_and_score(p, ml.COMPARATORS[model](s), s.target_recall)
            rows.append(cut(_tag(r, variant=name, model=model)))
    return _union(rows)


def ablation(design: DataFrame, features, s: ml.Settings, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Forest per feature group. ``extra`` designs (e.g. live feeds only) are scored with all features."""
    rows = []
    todo = [(n, design, f) for n, f in ft.ablation_groups(features).items()]
    todo += [(n, d, list(features)) for n, d in (extra or {}).items()]
    for name, d, feats in todo:
        p = parts(ft.align(d, feats, ("flow_id", "label", "split")), feats)
        _, _, r = ml.fit_and_score(p, ml.random_forest(s), s.target_recall)
        rows.append(cut(_tag(r, variant=name, n_features=len(feats))))
    return _union(rows)


def freshness(
    flows: DataFrame, sightings: DataFrame, intervals_min, ttl_s: float, half_life_s: float, t0: float, s: ml.Settings,
    reference_min: float = 5.0, retrain: bool = False, pool_floor: int = 50,
) -> DataFrame:
    """One model trained at the reference interval, evaluated while the poll interval is swept."""
    def enriched(minutes):
        dt = minutes * 60.0
        return cti.enrich(flows, cti.timeline(sightings, dt, t0), dt, ttl_s, half_life_s, t0)

    at_reference = cut(enriched(reference_min))
    ref, feats, num, vocab = designed(at_reference, pool_floor=pool_floor, seed=s.seed, stored=True)
    model, theta, _ = ml.fit_and_score(parts(ref, feats), ml.random_forest(s), s.target_recall)
    split = ref.select("flow_id", "label", "split")
    rows = []
    for minutes in intervals_min:
        e = at_reference if minutes == reference_min else enriched(minutes)
        e = split_alike(e, split, flows, "flow_id", s.seed)
        d = cut(ft.align(ft.design(e, num, vocab, ("flow_id", "label", "split", "age_s")), feats,
                         ("flow_id", "label", "split", "age_s")))
        p = parts(d, feats)
        sc = cut(ml.score(model, p).select("label", "split", "score"))
        test = sc.where("split = 'test'")
        theta_i = m.theta_of(sc.where("split = 'val'"), s.target_recall)
        # one row each
        found = {c: x for c, x in m.metrics_at(test, theta).first().asDict().items() if c in METRICS}
        found |= {f"matched_{c}": x for c, x in m.confusion(test, theta_i).first().asDict().items()
                  if c in ("recall", "precision", "f1", "fpr", "theta")}
        found |= cti.coverage(d.where("split = 'test'")).first().asDict()
        if retrain:
            again = ml.fit_and_score(p, ml.random_forest(s), s.target_recall)[2].first().asDict()
            found |= {f"retrain_{c}": again[c] for c in ("recall", "precision", "f1", "fpr", "pr_auc")}
        rows.append({"interval_min": float(minutes), **found})
    schema = ", ".join(f"{c} {'bigint' if c in ('n', 'n_alerts') else 'double'}" for c in rows[0])
    return flows.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


def explain_alerts(model, design: DataFrame, features, theta: float, limit: int | None = None, top_k: int = 3, seed: int = 42) -> DataFrame:
    """Score, keep alerts, attach reasons to all of them, or to a seeded sample of ``limit``."""
    p = ml.prepare(design, features, [c for c in design.columns if c in ("flow_id", "label", "attack_cat", "ts", *cti.FEATURES)])
    alerts = ml.score(model, p).where(F.col("score") >= theta)
    chosen = seeded_sample(alerts, limit, "flow_id", seed) if limit else alerts
    e = shap.explainer(shap.node_table(model, design.sparkSession), len(features))
    phi = shap.explain(chosen, e)
    return ex.reason_codes(phi.withColumn("contribs", ex.contributions(features, "vals", "phi")), k=top_k)


def stability(design: DataFrame, features, s: ml.Settings, sample: int | None = None) -> DataFrame:
    """Per fold and feature: mean absolute contribution over the fold's test rows, or a seeded sample of them."""
    from ..operators.splits import k_folds

    d = ml.prepare(cut(k_folds(design.where("split <> 'test'"), "flow_id", s.folds, s.seed)), features,
                   ("flow_id", "label", "fold", "inner"))
    rows = []
    for f in range(1, s.folds + 1):
        model = ml.fit(d.where((F.col("fold") != f) & (F.col("inner") >= 0.2)), ml.random_forest(s))
        test = d.where(F.col("fold") == f).select("flow_id", "features")
        test = seeded_sample(test, sample, "flow_id", s.seed + f) if sample else test
        e = shap.explainer(shap.node_table(model, design.sparkSession), len(features))
        st = ex.strength(shap.explain(test, e), features)
        rows.append(cut(st.select(F.lit(f).alias("fold"), "feature", "strength")))
    return _union(rows)


def transfer(designs: dict[str, DataFrame], features, s: ml.Settings) -> DataFrame:
    """Train on one dataset, test on the other, against a model trained in-domain; both directions. The designs are read
    several times: give stored ones, or projections of such."""
    ready = {n: ml.prepare(cut(train_val_test(d, "flow_id", s.seed)), features, ("flow_id", "label", "split"))
             for n, d in designs.items()}
    fitted = {n: ml.fit_and_score(p, ml.random_forest(s), s.target_recall) for n, p in ready.items()}
    rows = []
    for src in designs:
        for tgt in designs:
            if src == tgt:
                continue
            model, theta, _ = fitted[src]
            direction = f"{src}_to_{tgt}"
            full = cut(ml.score(model, ready[tgt]).select("label", "split", "score"))
            test, full = full.where("split = 'test'").select("label", "score"), full.select("label", "score")
            rows += [cut(_tag(m.metrics_at(test, theta), direction=direction, kind="cross")),
                     cut(_tag(m.metrics_at(full, theta), direction=direction, kind="cross_full")),
                     cut(_tag(fitted[tgt][2], direction=direction, kind="in_domain"))]
    return _union(rows)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables of several experiments stacked into (experiment, row, metric, value)."""
    out = []
    for name, df in tables.items():
        text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        nums = [c for c in df.columns if c not in text]
        label = F.concat_ws("/", *text) if text else F.lit("all")
        long = df.select(label.alias("row"), *[F.col(c).cast("double").alias(c) for c in nums]).unpivot(["row"], nums, "metric", "value")
        out.append(long.select(F.lit(name).alias("experiment"), "row", "metric", "value"))
    return _union(out)
