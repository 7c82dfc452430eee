"""Top-k search and embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import neardup, topk

from .conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def world(n=600, d=12, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(40, d))
    rows = []
    for i in range(n):
        x = base[0] if i % 3 == 0 else base[rnd.integers(40)]  # a third near one vector
        x = x + rnd.normal(size=d) * rnd.choice([0, 0.05, 0.3, 1])
        rows.append((i, [float(v) for v in np.float32(x)], 0))
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * d, 0), (n + 3, [float("nan")] * d, 0), (n + 4, [None] + [1.0] * (d - 1), 0),
           (n + 5, [float("inf")] + [1.0] * (d - 1), 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float(v) for v in np.float32(base[0])], 0), (None, [1.0, 2.0], 0)]
    return rows, odd


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_search_equals_brute_force(spark):
    rows, odd = world()
    df = with_clashes(spark.createDataFrame(rows + odd, SCHEMA))
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v, _ in rows + odd if i is not None and usable(v)]
    want = {}
    for i, q in full:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in full if j != i and len(v) == len(q)))[:10]
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("copies", [2, 12])
def test_search_with_repeated_queries(spark, copies):
    # the query's own rows lie far from the others, in a block of their own
    rnd = np.random.default_rng(4)
    rows = [(0, [4.0, 4.0, 0.0], 0)] * copies + [(i, [float(x) for x in np.float32(rnd.normal(size=3))], 0) for i in range(1, 400)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    q = [4096, 4096, 0]
    want = sorted((-sum(a * int(np.floor(1024 * b)) for a, b in zip(q, v)), i) for i, v, _ in rows if i != 0)[:10]
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_large_numbers_stay_exact():
    v = np.array([[2.0**40, 3.0], [2.0**40, 4.0]])
    assert list(topk.inner(v, np.array([2.0**20, 1.0]))) == [2**60 + 3, 2**60 + 4]
    assert list(topk.inner(v * 2.0**60, np.array([2.0**60, 1.0]))) == [topk.LONG] * 2


@pytest.mark.parametrize("part", [2048, 50])
def test_links_equal_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(neardup, "PART", part)  # small parts: a list is searched in several tasks
    rows, odd = world()
    df = with_clashes(spark.createDataFrame(rows + odd + rows[:2], SCHEMA))
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect() if r.vec_id is not None)
    items = [(i, np.array(v, float)) for i, v, _ in rows + odd + rows[:2] if i is not None and usable(v) and any(v)]
    alone = [i for i, v, _ in rows + odd if i is not None and not (usable(v) and any(v))]
    links = [[b for b, (_, y) in enumerate(items) if b != a and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9] for a, (_, x) in enumerate(items)]
    label = list(range(len(items)))
    todo = True
    while todo:
        new = [min([label[a], *(label[b] for b in links[a])]) for a in range(len(items))]
        todo, label = new != label, new
    least = {}
    for a, c in enumerate(label):
        least[c] = min(least.get(c, 1 << 60), items[a][0])
    want = sorted([(items[a][0], len(links[a]), least[label[a]], items[a][0] == least[label[a]]) for a in range(len(items))] + [(i, 0, i, True) for i in alone])
    recall = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert recall >= 0.99 and all(a[1] <= b[1] for a, b in zip(got, want))
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.search(df, F.col("vec_id") % 100 == 0).collect() == []
    assert neardup.near_duplicates(df).collect() == []
