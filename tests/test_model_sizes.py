"""The baseline queries fit models of full size."""

from pyspark.sql import functions as F

from vigilflow.operators import models as ml
from vigilflow.plans import q_models


def fitted(spark, monkeypatch, query):
    """Estimators that ``query`` fits, by name of their class."""
    names = ["dur", "ioc_src_match"]
    d = spark.range(8).select(
        F.col("id").alias("flow_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("train").alias("split"),
        *[F.col("id").cast("double").alias(c) for c in names])
    zero = spark.range(1).select(*[F.lit(0.0).alias(c) for c in q_models.xp.METRICS])
    seen = []
    monkeypatch.setattr(q_models, "_design", lambda *_: (d, names, names, {}))
    monkeypatch.setattr(ml, "fit_and_score", lambda parts, estimator, recall: seen.append(estimator) or (None, 0.0, zero))
    query(spark, "")
    return {k: [x for x in seen if type(x).__name__ == k] for k in {type(x).__name__ for x in seen}}


def whole(forest):
    return (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (200, 30, 20)


def test_forest_of_ml_rf(spark, monkeypatch):
    assert all(map(whole, fitted(spark, monkeypatch, q_models.ml_rf)["RandomForestClassifier"]))


def test_models_of_exp_baseline(spark, monkeypatch):
    got = fitted(spark, monkeypatch, q_models.exp_baseline)
    assert all(map(whole, got["RandomForestClassifier"])) and len(got["RandomForestClassifier"]) == 2
    assert [x.getMaxIter() for x in got["GBTClassifier"]] == [250, 250] and len(got["LinearSVC"]) == 2
