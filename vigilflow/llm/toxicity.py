"""Toxicity by nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over indicative terms (words and short word beginnings whose
document frequency differs between toxic and clean examples beyond chance). A block-max inverted index over the
examples finds the exact k nearest by cosine: a document adds up each block's term maxima, visits blocks from the
highest bound down and stops when a bound falls below the kth similarity. Neighbours vote with a weight that falls
with distance, and the vote is calibrated by a monotone fit on the examples' own votes, each without itself.

Defined cases: null and empty texts, and texts without any indicative term, have no neighbours and score the
smoothed rate of toxic examples that have none either; equal similarities rank by the smaller example id; repeated
rows score alike; without examples every score is 0; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, hash_share, texts

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
CACHE = 200_000


def terms_of(word: str) -> list[str]:
    """A word's terms: itself and its beginnings, marked so that they differ from words."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


@dataclass
class Vectorizer:
    """TF-IDF over the chosen terms; ``weights`` gives (term ids ascending, unit-length values)."""

    ids: dict[str, int]
    idf: np.ndarray
    _seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def counts(self, text: str) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        if not self.ids:
            return out
        seen = self._seen
        for w, n in words_of(text).items():
            hit = seen.get(w)
            if hit is None:
                if len(seen) > CACHE:
                    seen.clear()
                hit = seen[w] = tuple(self.ids[t] for t in terms_of(w) if t in self.ids)
            for t in hit:
                out[t] += n
        return out

    def weights(self, text: str) -> tuple[tuple[int, ...], np.ndarray]:
        got = self.counts(text)
        if not got:
            return (), np.zeros(0)
        t = sorted(got)
        v = (1 + np.log([got[i] for i in t])) * self.idf[t]
        return tuple(t), v / np.sqrt((v * v).sum())


class BlockMaxIndex:
    """Inverted lists of per-block maxima and, within each block, inverted lists of its vectors."""

    def __init__(self, vectors: list[tuple[tuple[int, ...], np.ndarray]], block: int = 32):
        # vectors that share their heaviest terms stand together, so that few blocks have high bounds
        self.order = sorted(range(len(vectors)), key=lambda i: [t for _, t in sorted(zip(-vectors[i][1], vectors[i][0]))][:3] + [i])
        self.n_blocks = -(-len(vectors) // block)
        tops: dict[int, dict[int, float]] = defaultdict(dict)
        self.inside: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        self.members: list[np.ndarray] = []
        for b in range(self.n_blocks):
            own = self.order[b * block:(b + 1) * block]
            lists: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for j, i in enumerate(own):
                for t, v in zip(*vectors[i]):
                    lists[t][0].append(j)
                    lists[t][1].append(v)
                    tops[t][b] = max(tops[t].get(b, 0.0), v)
            self.inside.append({t: (np.array(a), np.array(v)) for t, (a, v) in lists.items()})
            self.members.append(np.array(own))
        self.tops = {t: (np.array(list(x)), np.array(list(x.values()))) for t, x in tops.items()}

    def search(self, terms: tuple[int, ...], values: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k most similar vectors as (similarity, number), ties to the smaller number; similarity 0 is none."""
        bound = np.zeros(self.n_blocks)
        for t, v in zip(terms, values):
            if t in self.tops:
                at, top = self.tops[t]
                bound[at] += v * top
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] + 1e-9 < best[-1][0]):
                break
            scores = np.zeros(len(self.members[b]))
            for t, v in zip(terms, values):
                if t in self.inside[b]:
                    at, w = self.inside[b][t]
                    scores[at] += v * w
            best += [(round(float(scores[j]), 12), int(self.members[b][j])) for j in np.flatnonzero(scores) if self.members[b][j] != skip]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    vectorizer: Vectorizer
    index: BlockMaxIndex
    ids: np.ndarray  # the smallest document id with the example's vector
    toxic: np.ndarray  # weight of toxic documents with that vector
    total: np.ndarray
    k: int
    none: float  # score without neighbours
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    _seen: dict = field(default_factory=dict)

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([1 / (1.05 - s) for s, _ in near])
        i = [j for _, j in near]
        return float((w * self.toxic[i]).sum() / (w * self.total[i]).sum())

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        t, v = self.vectorizer.weights(text)
        if not t:
            return self.none, [], []
        key = (t, v.tobytes())
        if key not in self._seen:
            if len(self._seen) > CACHE:
                self._seen.clear()
            near = self.index.search(t, v, self.k)
            raw = self.vote(near) if near else self.none
            self._seen[key] = (float(np.interp(raw, *self.steps)) if near and len(self.steps[0]) else raw,
                               [int(self.ids[j]) for _, j in near], [s for s, _ in near])
        return self._seen[key]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares non-decreasing fit (pool adjacent violators), as points to interpolate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([y[i] * w[i], w[i], x[i] * w[i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    # half a toxic example's weight each way keeps scores off 0 and 1
    return (np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.01) / (p[1] + 0.02) for p in pools]))


def choose_terms(sample: DataFrame, least: float = 24.0, ratio: float = 3.0) -> pd.DataFrame:
    """Terms whose document frequency differs between classes (likelihood-ratio statistic at least ``least``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = (Counter(), Counter())
        for b in batches:
            for text, y in zip(texts(b["text"]), b["toxic"]):
                n[int(y)].update({t for w in words_of(text) for t in terms_of(w)})
        both = sorted(n[0].keys() | n[1].keys())
        for at in range(0, len(both), 50_000):
            part = both[at:at + 50_000]
            yield pd.DataFrame({"term": part, "clean": [n[0][t] for t in part], "bad": [n[1][t] for t in part]})

    totals = sample.groupBy("toxic").count().collect()
    have = {r["toxic"]: r["count"] for r in totals}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    if not n0 or not n1:
        return pd.DataFrame({"term": [], "clean": [], "bad": []})
    c = sample.mapInPandas(count, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    df = F.col("clean") + F.col("bad")

    def part(seen, n):
        """observed * ln(observed / expected) of one cell"""
        return F.when(seen > 0, seen * F.log(seen / (df * F.lit(n / (n0 + n1))))).otherwise(0.0)

    def rest(seen, n):
        missing = F.lit(n) - seen
        return F.when(missing > 0, missing * F.log(missing / ((F.lit(n0 + n1) - df) * F.lit(n / (n0 + n1))))).otherwise(0.0)

    g = 2 * (part(F.col("clean"), n0) + part(F.col("bad"), n1) + rest(F.col("clean"), n0) + rest(F.col("bad"), n1))
    odds = ((F.col("bad") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    return c.where((df >= 3) & (g >= least) & ((odds >= ratio) | (odds <= 1 / ratio))).toPandas().sort_values("term")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 8000, k: int = 15) -> Model:
    """Learn from labelled rows (doc_id, toxic). ``max_toxic`` and ``max_clean`` bound the examples, drawn by the
    hash of the id; terms and vectors of the examples are all that reaches the driver."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    have = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    bounds = {0: max_clean, 1: max_toxic}
    drawn = F.lit(False)
    for c, n in have.items():
        drawn = drawn | ((F.col("toxic") == c) & hash_share(F.col("doc_id"), n, bounds[c], 3))
    chosen = y.where(drawn)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        terms = choose_terms(sample)
        n = sample.count()
        df = (terms["clean"] + terms["bad"]).to_numpy(float)
        vectorizer = Vectorizer({t: i for i, t in enumerate(terms["term"])}, np.log((1 + n) / (1 + df)) + 1 if len(df) else np.zeros(0))

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [vectorizer.weights(t) for t in texts(b["text"])]
                yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "t": [list(t) for t, _ in got], "v": [list(v) for _, v in got]})

        rows = sample.mapInPandas(vectors, "doc_id long, toxic int, t array<int>, v array<double>").groupBy("t", "v", "toxic").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).collect()
    finally:
        sample.unpersist()
    drawn_n = {c: sum(r["n"] for r in rows if r["toxic"] == c) for c in (0, 1)}
    weight = {c: have.get(c, 0) / max(1, drawn_n[c]) for c in (0, 1)}
    return build(vectorizer, [(r["doc_id"], tuple(r["t"]), np.array(r["v"]), r["toxic"], r["n"]) for r in rows], weight, k)


def build(vectorizer: Vectorizer, rows: list[tuple], weight: dict[int, float], k: int) -> Model:
    """Index examples (doc id, terms, values, class, how many); ``weight`` undoes the sampling of each class."""
    groups: dict[tuple, list] = {}
    for doc_id, t, v, c, n in rows:
        g = groups.setdefault((t, v.tobytes()), [doc_id, t, v, [0.0, 0.0], [0, 0]])
        g[0] = min(g[0], doc_id)
        g[3][c] += n * weight[c]
        g[4][c] += n
    empty = groups.pop(((), b""), [0, (), np.zeros(0), [0.0, 0.0], [0, 0]])
    found = sorted(groups.values(), key=lambda g: g[0])
    m = Model(vectorizer, BlockMaxIndex([(g[1], g[2]) for g in found]), np.array([g[0] for g in found], np.int64),
              np.array([g[3][1] for g in found]), np.array([sum(g[3]) for g in found]), k,
              empty[3][1] / (sum(empty[3]) + 2))
    x, y, w = [], [], []
    for i, g in enumerate(found):
        for c in (0, 1):
            if g[4][c]:  # the vote on one of these documents, without itself
                near = m.index.search(g[1], g[2], k + 1)
                if sum(g[4]) == 1:
                    near = [x for x in near if x[1] != i]
                near = near[:k]
                if near:
                    own = (m.toxic[i], m.total[i])
                    m.toxic[i], m.total[i] = own[0] - c * weight[c], own[1] - weight[c]
                    x.append(m.vote(near))
                    m.toxic[i], m.total[i] = own
                    y.append(float(c))
                    w.append(g[3][c])
    if x:
        m.steps = monotone(np.array(x), np.array(y), np.array(w))
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the evidence (ids and similarities of the nearest examples) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.score(t) for t in texts(b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [g[0] for g in got],
                                "evidence": [g[1] for g in got], "similarity": [g[2] for g in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, evidence array<long>, similarity array<double>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, similarity for every document."""
    model = fit(docs, labels.where(bucket("doc_id") != 2))
    return score(docs, model).select(
        "doc_id", (bucket("doc_id") == 2).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", "similarity")
