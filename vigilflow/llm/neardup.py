"""Embedding near-duplicates by product quantisation.

Unit vectors are dealt to coarse inverted lists (nearest centroid, trained on a bounded sample and thinned so that no
two stand closer than the link distance). In its list a vector is kept as subspace codes of its residual. A list is
searched by its own members and by the vectors for which it is one of the nearest ``probes`` lists: table lookups of
squared distances from the searching vector to the codewords give a distance to each coded member, which, less that
member's known coding error, is a lower bound; pairs whose bound allows a link are confirmed by the cosine in double
precision. Within a list and for the probed lists nothing else is skipped, so only pairs that no probe brings together
are missed; recall is measured by the tests and in the README.

Equal vectors are one node with a count. Lists longer than ``PART`` are cut into parts that are searched against each
other, so a hot list is many tasks of bounded size. A task returns link counts and a spanning forest of the links it
confirmed, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors link only with vectors of their own length; rows with a null id take no part and are kept;
repeated rows are vectors of their own that link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import components
from .vectors import kmeans, rows_of, sample, squares, usable

PART = 2048
SUBSPACES, CODES = 8, 256
MOST_LISTS = 4096


@dataclass
class Quantizer:
    centroids: np.ndarray
    books: list[np.ndarray]  # codewords of each subspace of the residual

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each residual to what they stand for."""
        codes = np.zeros((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            d = squares(residual[:, a:b], book)
            codes[:, m] = d.argmin(1)
            left += d[np.arange(len(d)), codes[:, m]]
        return codes, np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: per residual a table of its distances to the codewords, looked up by code."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out += squares(residual[:, a:b], book).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(out)


def train(x: np.ndarray, lists: int, radius: float) -> Quantizer:
    c = kmeans(x, lists)
    keep: list[int] = []
    for i in range(len(c)):
        if not keep or squares(c[i:i + 1], c[keep]).min() > radius * radius:
            keep.append(i)
    c = c[keep]
    near = np.concatenate([squares(x[i:i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
    residual = x - c[near]
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return Quantizer(c, [kmeans(residual[:, p], CODES, 6, m) for m, p in enumerate(parts)])


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def forest(link: np.ndarray) -> np.ndarray:
    """The least column reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def search_part(rows: pd.DataFrame, model: Quantizer, list_no: int, alone: bool, least: float) -> pd.DataFrame:
    """Links within side 0 (``alone``) or between side 0 and side 1 of one part of a list.

    Side 0 may come from other lists. A pair whose ends probe each other's lists counts in the list with the smaller
    number only.
    """
    nothing = pd.DataFrame({"node": [], "n": [], "root": []})
    a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if alone:
        b = a
    if not len(a) or not len(b):
        return nothing
    xa, xb = rows_of(a["v"]), rows_of(b["v"])
    codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
    error = b["error"].to_numpy()
    far = np.sqrt(2 - 2 * least)
    residual = xa - model.centroids[list_no]
    hit = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 256):
        bound = model.distances(residual[i:i + 256], codes) - error[None, :]
        maybe = bound <= far + 1e-4
        if maybe.mean() > 0.05:
            hit[i:i + 256] = maybe & (xa[i:i + 256] @ xb.T >= least)
        else:
            p, q = np.nonzero(maybe)
            hit[i + p, q] = (xa[i + p] * xb[q]).sum(1) >= least
    na, nb = a["node"].to_numpy(), b["node"].to_numpy()
    if alone:
        np.fill_diagonal(hit, False)
    else:
        own = a["own"].to_numpy()
        asks = [set(p) for p in b["probes"]]
        back = np.zeros_like(hit)
        for o in np.unique(own[own < list_no]):
            back[np.ix_(own == o, np.array([o in p for p in asks]))] = True
        hit &= ~back
    if not hit.any():
        return nothing
    ca, cb = a["copies"].to_numpy(), b["copies"].to_numpy()
    if alone:
        on = np.flatnonzero(hit.any(1))
        label = forest(hit[np.ix_(on, on)])
        return pd.DataFrame({"node": na[on], "n": hit[on] @ ca, "root": na[on][label]})
    pa, pb = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    sub = hit[np.ix_(pa, pb)]
    n = len(pa)
    square = np.zeros((n + len(pb),) * 2, bool)
    square[:n, n:], square[n:, :n] = sub, sub.T
    nodes = np.concatenate([na[pa], nb[pb]])
    return pd.DataFrame({"node": nodes, "n": np.concatenate([hit[pa] @ cb, ca @ hit[:, pb]]), "root": nodes[forest(square)]})


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", col: str = "embedding", probes: int = 8, max_sample: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. ``max_sample`` bounds the vectors that train the quantiser."""
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(col), lambda x: x.cast("double")).alias("v"))
    base = base.withColumn("v", F.when(usable("v") & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0), F.col("v")))
    distinct = base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = store(distinct.withColumn("node", F.monotonically_increasing_id()), "pq-nodes")
    n = nodes.count()
    lists = max(1, min(MOST_LISTS, int(2 * np.sqrt(n))))
    radius = float(np.sqrt(2 - 2 * least))
    models = {d: train(_unit(x), lists, radius) for d, x in sample(nodes, "node", "v", n, max_sample).items()}

    def model_of(d: int) -> Quantizer:
        """Lengths that the sample lacks have one list."""
        return models.get(d) or Quantizer(np.zeros((1, d)), [np.zeros((1, d))])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len)):
                x, m = _unit(np.array(part["v"].tolist(), float)), model_of(d)
                dist = squares(x, m.centroids)
                order = np.argsort(dist, axis=1, kind="stable")[:, :probes + 1]
                codes, error = m.encode(x - m.centroids[order[:, 0]])
                yield pd.DataFrame({"node": part["node"], "copies": part["copies"], "d": d, "own": order[:, 0], "probes": [o[1:].tolist() for o in order],
                                    "v": [r.tobytes() for r in x], "code": [c.tobytes() for c in codes], "error": error})

    kept = "node long, copies long, d int, own int, probes array<int>, v binary, code binary, error double"
    coded = store(nodes.select("node", "copies", "v").mapInPandas(assign, kept), "pq-coded")
    probe = coded.select("node", "d", F.explode("probes").alias("list"))
    size = coded.groupBy("d", F.col("own").alias("list")).agg(F.count("*").alias("members")).join(
        probe.groupBy("d", "list").agg(F.count("*").alias("probing")), ["d", "list"], "left")
    size = store(size.select("d", "list", F.ceil(F.col("members") / PART).cast("int").alias("parts"),
                             F.coalesce(F.ceil(F.col("probing") / PART), F.lit(0)).cast("int").alias("rounds")), "pq-lists")
    # at most MOST_LISTS rows for each length of vector
    size = F.broadcast(size)
    mine = coded.withColumn("list", F.col("own")).join(size, ["d", "list"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *coded.columns, "list", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    asked = mine.where("rounds > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("rounds")))).select(
        *coded.columns, "list", (-F.col("j")).alias("x"), F.col("i").alias("y"), F.lit(1).alias("side"))
    asking = coded.withColumn("list", F.explode("probes")).join(size, ["d", "list"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *coded.columns, "list", (-1 - F.pmod(F.xxhash64("node"), F.col("rounds"))).cast("int").alias("x"), "y", F.lit(0).alias("side"))

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, list_no, x, y = key
        return search_part(rows, model_of(int(d)), int(list_no), x == y, least)

    found = store(own.unionByName(asked).unionByName(asking).groupBy("d", "list", "x", "y").applyInPandas(task, "node long, n long, root long"), "pq-links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = named.join(names, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = base.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = base.where("v is not null").join(result, "v").select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
