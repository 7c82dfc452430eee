"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are cut into document ranges: blocks of neighbouring vectors (by nearest centroid, then id) that carry their
components as a forward index and, per dimension (the "term"), the largest and smallest component. A query bounds
what a block can reach by its summed term extremes, visits blocks from the highest bound down, scores a block through
its forward index, and stops when the bounds fall below its kth score. A kth score that a query starts with comes
from rows of other ids in a bounded sample; it can only be too low, so pruning stays exact.

Blocks form chunks and queries form groups. Each pair of a chunk and a query group is one task's work of bounded
size, whatever the number of vectors or queries, and contributes at most k candidates per query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null
id as queries; vectors meet only vectors of their own length; rows with the query's id are its own; equal scores
rank by the smaller id; repeated rows are results each; scores beyond the range of long are cut to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .vectors import drawn, kmeans, rows_of, squares, usable

BLOCK = 128
CHUNK = 8192  # vectors of a chunk
GROUP = 1024  # queries of a group
LONG = (1 << 63) - 1


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered float rows with q; as Python integers when floats would round."""
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < 2**52:
        return v @ q
    qs = [int(x) for x in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, qs)))) for row in v], object)


@dataclass
class Blocks:
    """Blocks of one chunk: ids and forward index of each, and all their extremes per dimension."""

    ids: list[list[int]]
    data: list[np.ndarray]
    top: np.ndarray
    low: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What the scores of each block cannot exceed."""
        with np.errstate(over="ignore", invalid="ignore"):
            got = self.top @ np.maximum(q, 0) + self.low @ np.minimum(q, 0)
            # sums of large floats round; a bound may then only grow
            slack = 1e-9 * (np.maximum(np.abs(self.top), np.abs(self.low)) @ np.abs(q))
            return np.where(np.isfinite(got + slack), got + slack, np.inf)


def visit(blocks: Blocks, query_id, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
    """The k best (score, id) of the blocks for one query; ``floor`` is a score that its kth reaches for sure."""
    bounds = blocks.bounds(q)
    best: list[tuple[int, int]] = []
    for i in np.argsort(-bounds, kind="stable"):
        kth = best[-1][0] if len(best) == k else -np.inf
        if bounds[i] < max(kth, floor):
            break
        scores = inner(blocks.data[i], q)
        best += [(int(scores[j]), int(blocks.ids[i][j])) for j in np.flatnonzero(scores >= kth) if blocks.ids[i][j] != query_id]
        best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    return best


def floor_of(scores: np.ndarray, others: np.ndarray, k: int) -> float:
    """The kth best sample score among rows of other ids than the query's, however often its own rows are repeated."""
    scores = scores[others]
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", col: str = "embedding", scale: int = 1024, max_sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows by the inner product of floor(scale * x).

    ``max_sample`` bounds the vectors that train the order of documents and start the thresholds.
    """
    base = store(df.where(usable(col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.transform(F.col(col), lambda x: x.cast("double")).alias("v")), "topk-vectors")
    have = {r["d"]: r["n"] for r in base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    seen = {d: (ids, np.floor(x * scale)) for d, (ids, x) in drawn(base, "id", "v", total, max_sample).items()}
    order = {d: kmeans(x, max(1, min(256, len(x) // 8))) for d, (_, x) in seen.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole-numbered vectors, the centroid that orders them, and a query's starting threshold."""
        for b in batches:
            n = b["v"].map(len)
            for d, part in b.groupby(n):
                x = np.floor(np.array(part["v"].tolist(), float).reshape(len(part), d) * scale)
                near = np.zeros(len(part), int)
                if d in order:
                    near = np.concatenate([squares(x[i:i + 2048], order[d]).argmin(1) for i in range(0, len(x), 2048)])
                start = np.full(len(part), -np.inf)
                if d in seen and len(seen[d][0]) >= k:
                    of, vectors = seen[d]
                    own = part["id"].to_numpy()
                    for i in np.flatnonzero(part["is_query"].to_numpy(bool)):
                        start[i] = floor_of(np.asarray(inner(vectors, x[i]), float), of != own[i], k)
                yield pd.DataFrame({"id": part["id"], "is_query": part["is_query"], "d": d, "near": near, "start": start, "x": [r.tobytes() for r in x]})

    placed = store(base.mapInPandas(place, "id long, is_query boolean, d int, near int, start double, x binary"), "topk-placed")
    chunks = max(1, -(-total // CHUNK))
    n_queries = placed.where("is_query").count()
    groups = max(1, -(-n_queries // GROUP))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of consecutive rows of one vector length."""
        chunk, rest = TaskContext.get().partitionId(), None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b])
            out = []
            for d, part in rest.groupby("d", sort=True):
                whole = len(part) // BLOCK * BLOCK
                out += [(d, part.iloc[i:i + BLOCK]) for i in range(0, whole, BLOCK)]
            if out:
                yield blocks_of(out, chunk)
            rest = pd.concat([p.iloc[len(p) // BLOCK * BLOCK:] for _, p in rest.groupby("d", sort=True)])
        if rest is not None and len(rest):
            yield blocks_of([(d, p) for d, p in rest.groupby("d", sort=True)], chunk)

    def blocks_of(parts: list, chunk: int) -> pd.DataFrame:
        rows = [(d, chunk, p["id"].tolist(), b"".join(p["x"]), rows_of(p["x"])) for d, p in parts]
        return pd.DataFrame({"d": [r[0] for r in rows], "chunk": [r[1] for r in rows], "ids": [r[2] for r in rows], "data": [r[3] for r in rows],
                             "top": [r[4].max(0).tobytes() for r in rows], "low": [r[4].min(0).tobytes() for r in rows]})

    ordered = placed.select("id", "d", "near", "x").repartitionByRange(chunks, "d", "near", "id").sortWithinPartitions("d", "near", "id")
    blocks = store(ordered.mapInPandas(cut, "d int, chunk int, ids array<long>, data binary, top binary, low binary"), "topk-blocks")
    where = store(blocks.select("d", "chunk").distinct(), "topk-chunks")
    queries = placed.where("is_query").select("id", "d", "x", "start").distinct().withColumn("g", F.pmod(F.xxhash64("id", "x"), F.lit(groups)).cast("int"))
    queries = queries.join(where, "d").repartition(F.col("chunk"), F.col("g"))
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = [list(i) for i in left["ids"]]
            mine = Blocks(ids, [np.frombuffer(x, np.float64).reshape(len(i), -1) for i, x in zip(ids, left["data"])], rows_of(left["top"]), rows_of(left["low"]))
            for i, x, start in zip(right["id"], right["x"], right["start"]):
                q = np.frombuffer(x, np.float64)
                out += [(i, x, s, j) for s, j in visit(mine, i, q, k, start)]
        return pd.DataFrame(out, columns=["query_id", "x", "score", "vec_id"])

    found = blocks.groupBy("d", "chunk", "g").cogroup(queries.groupBy("d", "chunk", "g")).applyInPandas(both, "query_id long, x binary, score long, vec_id long")
    best = Window.partitionBy("query_id", "x").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
