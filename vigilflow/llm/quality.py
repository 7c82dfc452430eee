"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled text train an additive model: every document becomes a row of
text statistics, each statistic falls into one of a few bins, and each bin has a weight. Training minimises the
non-negative unbiased risk ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])`` with the logistic loss;
negative labels are never read. The class prior is estimated from the unlabelled sample: the least ratio, over
score thresholds, of the unlabelled share above the threshold to the positives' share above it, with
Dvoretzky-Kiefer-Wolfowitz terms for the samples' errors.

Defined cases: a null text counts as empty; an empty text gets the score of its statistics (all zero) like any
other; long texts are read whole; repeated rows are scored alike; without any positive every score is 0.5; other
columns of the inputs are ignored and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, hash_share, sigmoid, texts

PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
N_STATS = 12 + len(PUNCT)


def statistics(text: str) -> np.ndarray:
    """Sizes, repetition and the shares of byte classes of the whole text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(N_STATS)
    if not len(data):
        return out
    shares = np.bincount(data, minlength=256) / len(data)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    out[:12] = (
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n, len(counts) / n, len(counts) / n**0.75,
        max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        shares[65:91].sum(), shares[97:123].sum(), shares[48:58].sum(), shares[10], shares[128:].sum(),
    )
    out[12:] = shares[PUNCT]
    return out


def matrix(batch: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in batch]).reshape(len(batch), N_STATS)


@dataclass
class Model:
    """Bin borders and bin weights per statistic; ``score`` is the posterior of a trusted document."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, w) in enumerate(zip(self.edges, self.weights)):
            z += w[np.searchsorted(e, x[:, j], side="right")]
        return sigmoid(z)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantile borders; a border just above zero keeps absent characters apart."""
    full = x[x > 0]
    cut = np.quantile(full, np.linspace(0, 1, bins + 1)[1:-1]) if len(full) else np.zeros(0)
    return np.unique(np.concatenate([[1e-12], cut]))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Least upper bound on the positives' share of the unlabelled scores."""
    if not len(pos) or not len(unl):
        return 0.5
    t = np.quantile(pos, np.linspace(0, 0.99, 200))
    p = 1 - np.searchsorted(np.sort(pos), t, side="left") / len(pos)
    u = 1 - np.searchsorted(np.sort(unl), t, side="left") / len(unl)
    eps = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    keep = p > 2 * eps
    if not keep.any():
        return 0.5
    p, u = p[keep], u[keep]
    best = np.argmin((u + eps) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _gradient(w: np.ndarray, code: np.ndarray, pos: np.ndarray, prior: float | None, ridge: float) -> np.ndarray:
    """Of the risk, where its negative part is at least zero; below, the way back up. With ``prior`` None, of the plain
    loss of positives against unlabelled rows. The last weight is the bias."""
    width = len(w) - 1
    p, u = np.flatnonzero(pos), np.flatnonzero(~pos)
    s = sigmoid(w[code].sum(1) + w[width])
    g = np.zeros(len(code))
    if prior is None:
        g[p], g[u] = (s[p] - 1) * 0.5 / len(p), s[u] * 0.5 / len(u)
    else:
        loss = -np.log(np.maximum(1 - s, 1e-12))
        negative = loss[u].mean() - prior * loss[p].mean()
        if negative >= 0:
            g[p] = (prior * (s[p] - 1) - prior * s[p]) / len(p)
            g[u] = s[u] / len(u)
        else:  # step back up the part that became negative
            g[p], g[u] = prior * s[p] / len(p), -s[u] / len(u)
    grad = np.bincount(code.ravel(), np.repeat(g, code.shape[1]), minlength=width + 1)
    grad[width] += g.sum()
    grad[:width] += ridge * w[:width]
    return grad


def _descend(code: np.ndarray, width: int, pos: np.ndarray, prior: float | None, steps: int, ridge: float):
    """Adam on the risk; with ``prior`` None, on the plain loss of positives against unlabelled rows."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        grad = _gradient(w, code, pos, prior, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_arrays(pos: np.ndarray, unl: np.ndarray, bins: int = 6, steps: int = 300, ridge: float = 1e-4) -> Model:
    x = np.vstack([pos, unl])
    is_pos = np.arange(len(x)) < len(pos)
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    width = int(starts[-1])
    if not len(pos) or not len(unl):
        return Model(edges, [np.zeros(len(e) + 1) for e in edges], 0.0, 0.5)
    code = np.stack([starts[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
    # the prior comes from rows that the first, plain fit has not seen
    half = np.fromiter((crc32(r.tobytes()) & 1 for r in x), bool, len(x))  # equal texts fall into the same half
    first = _descend(code[half], width, is_pos[half], None, steps // 2, ridge) if (is_pos & half).any() and (~is_pos & half).any() else np.zeros(width + 1)
    rest = first[code[~half]].sum(1)
    prior = estimate_prior(rest[is_pos[~half]], rest[~is_pos[~half]])
    w = _descend(code, width, is_pos, prior, steps, ridge)
    return Model(edges, [w[a:b] for a, b in zip(starts, starts[1:])], float(w[width]), prior)


def fit(docs: DataFrame, positives: DataFrame, max_positive: int = 8000, max_unlabelled: int = 16000) -> Model:
    """Train on documents whose ids ``positives`` (doc_id) lists against a sample of all documents.

    ``max_positive`` and ``max_unlabelled`` bound the two samples, drawn by the hash of id and text; a row that is repeated
    counts once. Only the samples' statistics reach the driver.
    """
    ids = positives.select("doc_id").where("doc_id is not null").distinct()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    named = rows.join(ids, "doc_id", "left_semi")

    def sample(of: DataFrame, bound: int, salt: int, pos: bool) -> DataFrame:
        return of.where(hash_share(F.col("key"), of.count(), bound, salt)).dropDuplicates(["key"]).withColumn("pos", F.lit(pos))

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "pos": b["pos"], "x": list(matrix(texts(b["text"])))})

    both = sample(named, max_positive, 1, True).unionByName(sample(rows, max_unlabelled, 2, False))
    got = both.mapInPandas(stats, "key long, pos boolean, x array<double>").toPandas().sort_values(["pos", "key"])
    x = np.array(got["x"].tolist()).reshape(len(got), N_STATS)
    pos = got["pos"].to_numpy(bool)
    return fit_arrays(x[pos], x[~pos])


def scorer(model: Model):
    """Column function: the score of a text column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(matrix(texts(b))))

    return run


def trusted(labels: DataFrame) -> DataFrame:
    """Ids labelled good that may be learned from."""
    return labels.where((F.col("quality") == 1) & (bucket("doc_id") != 2)).select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, trusted(labels))
    scored = docs.select("doc_id", scorer(model)("text").alias("score"))
    return scored.select("doc_id", (bucket("doc_id") == 2).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they are."""
    return docs.where(scorer(fit(docs, trusted(labels)))("text") >= threshold)
