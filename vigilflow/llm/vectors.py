"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def rows_of(cells) -> np.ndarray:
    """A matrix from a pandas column of equally long float64 byte strings."""
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids of a bounded sample; fewer than k if the sample has fewer different rows."""
    x = np.asarray(x, float)
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    c = different[np.random.default_rng(seed).choice(len(different), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squares(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def drawn(df: DataFrame, by: str, col: str, have: int, bound: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """At most about ``bound`` vectors, drawn by the hash of ``by``: their ids and matrices by vector length."""
    from .common import hash_share

    got = df.where(hash_share(F.col(by), have, bound, 7)).select(by, col).toPandas().sort_values(by)
    out: dict[int, list] = {}
    for i, v in zip(got[by], got[col]):
        out.setdefault(len(v), []).append((i, v))
    return {d: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], float).reshape(len(rows), d)) for d, rows in out.items()}


def sample(df: DataFrame, by: str, col: str, have: int, bound: int) -> dict[int, np.ndarray]:
    """The matrices of ``drawn``."""
    return {d: x for d, (_, x) in drawn(df, by, col, have, bound).items()}
