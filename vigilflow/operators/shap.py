"""Exact path-dependent TreeSHAP for Spark ML tree ensembles.

A leaf adds its value times a product over the features on its path: a feature counts 1 or 0 when it is
known (the row does or does not satisfy the path's interval) and the share of training weight that took
the path when it is not. The Shapley sum over feature subsets of such a product is the integral over t in
[0, 1] of the product of ``t * known + (1 - t) * unknown`` without the feature, which Gauss-Legendre
quadrature evaluates exactly. Leaves are numpy arrays, rows are processed in Arrow batches by
``mapInPandas``; Spark partitions the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_dir


@dataclass(frozen=True)
class Leaves:
    """All leaves whose paths touch the same number of features, as arrays (leaf, feature on path)."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Explainer:
    groups: tuple[Leaves, ...]
    base: float
    n_features: int


def node_table(model, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Nodes of a saved forest: tree, node id, weights per class, split."""
    path = path or f"{shared_dir(spark)}/forest-{uuid.uuid4().hex[:8]}"
    model.write().overwrite().save(path)
    n = spark.read.parquet(f"{path}/data")
    d = "nodeData"
    return n.select(
        F.col("treeID").alias("tree"), F.col(f"{d}.id").alias("node"), F.col(f"{d}.impurityStats").alias("stats"),
        F.col(f"{d}.leftChild").alias("left"), F.col(f"{d}.rightChild").alias("right"),
        F.col(f"{d}.split.featureIndex").alias("feature"),
        F.try_element_at(f"{d}.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves and depth per tree. Depth follows the parent links level by level."""
    child = nodes.select("tree", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent")).where("node >= 0")
    level = nodes.where("node = 0").select("tree", "node")
    depths, depth = level.select("tree", F.lit(0).alias("depth")), 0
    links = cut(child.select("tree", F.col("parent"), "node"))
    while True:
        level = links.join(level.withColumnRenamed("node", "parent"), ["tree", "parent"]).select("tree", "node")
        level = cut(level)
        if level.isEmpty():
            break
        depth += 1
        depths = depths.unionByName(level.select("tree", F.lit(depth).alias("depth")).distinct())
    size = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves"))
    return size.join(depths.groupBy("tree").agg(F.max("depth").alias("depth")), "tree")


def explainer(nodes: DataFrame, n_features: int, klass: int = 1) -> Explainer:
    """Leaf arrays of a fitted model; their size is the model's, whatever the data."""
    pdf = nodes.toPandas()
    n_trees = pdf["tree"].nunique()
    found: dict[int, list] = {}
    base = 0.0
    for _, t in pdf.groupby("tree"):
        by = {int(r.node): r for r in t.itertuples()}
        stack = [(0, {})]
        while stack:
            i, path = stack.pop()
            r = by[i]
            total = float(np.sum(r.stats))
            if r.left < 0:
                value = float(r.stats[klass]) / total / n_trees if total else 0.0
                base += value * float(np.prod([c for _, _, c in path.values()])) if path else value
                if path:
                    found.setdefault(len(path), []).append((path, value))
                continue
            f, thr = int(r.feature), float(r.threshold)
            low, high, cover = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(r.left), (low, min(high, thr))), (int(r.right), (max(low, thr), high))):
                share = float(np.sum(by[child].stats)) / total if total else 0.0
                stack.append((child, {**path, f: (*bounds, cover * share)}))
    groups = []
    for d in sorted(found):
        paths = [list(p.items()) for p, _ in found[d]]
        groups.append(Leaves(
            np.array([[f for f, _ in p] for p in paths]), np.array([[b[0] for _, b in p] for p in paths]),
            np.array([[b[1] for _, b in p] for p in paths]), np.array([[b[2] for _, b in p] for p in paths]),
            np.array([v for _, v in found[d]])))
    return Explainer(tuple(groups), base, n_features)


def _gains(g: Leaves, on: np.ndarray) -> np.ndarray:
    """What each leaf gives to each feature on its path (feature, row, leaf), for rows that are ``on`` its intervals or not
    (row, leaf, feature)."""
    d = g.feature.shape[1]
    t, w = np.polynomial.legendre.leggauss(d // 2 + 1)
    t, w = (t + 1) / 2, w / 2
    miss = g.cover[:, :, None] * (1 - t)  # leaf, feature, node: factor when the row is off the interval
    factor = miss[None] + on[..., None] * t
    prod = factor.prod(axis=2)
    return np.stack([((prod / factor[:, :, j]) * w).sum(axis=2) * (on[:, :, j] - g.cover[:, j]) * g.value for j in range(d)])


def shap_matrix(ex: Explainer, x: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    """Contributions (rows, features) to the class probability.

    A leaf sees of a row only which of its intervals hold it. Where there are fewer such patterns than rows, the sums are
    worked out for every pattern and looked up by the rows.
    """
    phi = np.zeros((len(x), ex.n_features))
    for g in ex.groups:
        n_leaf, d = g.feature.shape
        orders = [np.argsort(g.feature[:, j], kind="stable") for j in range(d)]
        nodes, table = d // 2 + 1, None
        if (1 << d) < len(x) and (n_leaf * d << d) <= cells:
            every = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1
            at_once = max(1, cells // (n_leaf * d * nodes))
            table = np.concatenate([_gains(g, np.broadcast_to(every[p:p + at_once, None], (len(every[p:p + at_once]), n_leaf, d)))
                                    for p in range(0, 1 << d, at_once)], axis=1)
        step = max(1, cells // (n_leaf * d * (8 if table is not None else nodes)))
        for s in range(0, len(x), step):
            xs = x[s:s + step]
            if table is None:
                v = xs[:, g.feature]
                gains = _gains(g, (v > g.low) & (v <= g.high))
            else:
                held = np.zeros((len(xs), n_leaf), np.int64)
                for j in range(d):
                    v = xs[:, g.feature[:, j]]
                    held |= ((v > g.low[:, j]) & (v <= g.high[:, j])).astype(np.int64) << j
                held = held * n_leaf + np.arange(n_leaf)
                gains = [of.ravel().take(held) for of in table]
            for j in range(d):
                o = orders[j]
                f = g.feature[o, j]
                first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                phi[s:s + step, f[first]] += np.add.reduceat(gains[j][:, o], first, axis=1)
    return phi


def explain(df: DataFrame, ex: Explainer, features: str = "features", out: str = "phi") -> DataFrame:
    """Add ``vals`` (feature values) and ``phi`` (their contributions). Filter to alerts before calling."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ex)  # as large as the model
    arr = df.withColumn("vals", vector_to_array(features)).drop(features)
    schema = T.StructType([*arr.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["vals"].to_numpy()) if len(b) else np.zeros((0, shared.value.n_features))
            b[out] = list(shap_matrix(shared.value, x))
            yield b

    return arr.mapInPandas(run, schema)
