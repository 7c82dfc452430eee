"""Classifiers, thresholds at matched recall, cross-validation and bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import align, design, design_names
from ..session import cut
from . import metrics as m
from .splits import k_folds


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    min_leaf: int = 20
    max_depth: int = 30  # the most Spark grows; the leaf size ends a tree before
    max_bins: int = 64
    boost_rounds: int = 250
    target_recall: float = 0.96
    folds: int = 5
    seed: int = 42


def random_forest(s: Settings) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=s.trees, minInstancesPerNode=s.min_leaf, maxDepth=s.max_depth, maxBins=s.max_bins,
        featureSubsetStrategy="sqrt", weightCol="weight", seed=s.seed)


def gradient_boosting(s: Settings) -> GBTClassifier:
    return GBTClassifier(maxIter=s.boost_rounds, stepSize=0.1, maxBins=s.max_bins, seed=s.seed)


def linear_svm(s: Settings) -> LinearSVC:
    return LinearSVC(regParam=1e-4, maxIter=100)


COMPARATORS = {"random_forest": random_forest, "gradient_boosting": gradient_boosting, "linear_svm": linear_svm}


def weighted(df: DataFrame) -> DataFrame:
    """Balanced class weights; one row per class is broadcast."""
    return df.join(F.broadcast(m.class_weights(df).select("label", "weight")), "label")


def prepare(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature vector next to ``keep`` (ids, label, split)."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df).select(*keep, "features")


def fit(train: DataFrame, estimator):
    """Fit with balanced weights. The rows are joined and assembled once, in their partitions and order, and kept (on disk
    where memory is short) while the estimator reads them for counts, borders and its own form."""
    rows = weighted(train).select("label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def score(model, df: DataFrame) -> DataFrame:
    """Add ``score``: probability of class 1, or the decision value of a model without probabilities."""
    col = "probability" if getattr(model, "hasParam", lambda p: False)("probabilityCol") else "rawPrediction"
    out = model.transform(df)
    keep = [c for c in df.columns]
    return out.select(*keep, F.get(vector_to_array(col), F.lit(1)).alias("score"))


def fit_and_score(parts: DataFrame, estimator, target_recall: float):
    """Fit on ``split = train``, tune the threshold on ``val``, measure on ``test``: (model, theta, metrics row)."""
    model = fit(parts.where("split = 'train'"), estimator)
    # narrow and stored: curves and counts read the scores several times
    scores = cut(score(model, parts.where("split <> 'train'")).select("label", "split", "score"))
    theta = m.theta_of(scores.where("split = 'val'").select("label", "score"), target_recall)
    return model, theta, m.metrics_at(scores.where("split = 'test'").select("label", "score"), theta)


def cross_validate(df: DataFrame, key: str, make, s: Settings) -> DataFrame:
    """One metrics row per fold; the threshold is tuned on an inner part of the training folds."""
    folds = cut(k_folds(df, key, s.folds, s.seed))
    rows = None
    for f in range(1, s.folds + 1):
        split = F.when(F.col("fold") == f, "test").when(F.col("inner") < 0.2, "val").otherwise("train")
        _, _, r = fit_and_score(folds.withColumn("split", split), make(s), s.target_recall)
        r = cut(r.withColumn("fold", F.lit(f)))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def importance(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    pairs = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, weight double")


@dataclass(frozen=True)
class Bundle:
    """Everything serving needs to repeat the training design."""

    profile: str
    numeric: list[str]
    vocabulary: dict[str, list[str]]
    theta: float
    meta: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return design_names(self.numeric, self.vocabulary)

    def design(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Same columns in the same order as in training, whatever the batch holds."""
        have = [c for c in self.numeric if c in df.columns]
        cats = {c: v for c, v in self.vocabulary.items() if c in df.columns}
        return align(design(df, have, cats, keep), self.features, keep)


def save_bundle(bundle: Bundle, model, path: str) -> None:
    spark = SparkSession.getActiveSession()
    PipelineModel([model]).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(asdict(bundle)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str):
    raw = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
    return Bundle(**raw), PipelineModel.load(f"{path}/model").stages[0]
