import random

import numpy as np

from vigilflow.llm import toxicity as t

from .conftest import plain, prose, with_clashes


def test_search_is_exact():
    rnd = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        terms = np.sort(rnd.choice(40, rnd.integers(1, 6), replace=False))
        v = rnd.random(len(terms)).round(1) + 0.1
        vectors.append((tuple(int(x) for x in terms), v / np.sqrt((v * v).sum())))
    index = t.BlockMaxIndex(vectors, block=8)
    dense = np.zeros((300, 40))
    for i, (a, v) in enumerate(vectors):
        dense[i, list(a)] = v
    for i in range(0, 300, 7):
        want = sorted(((-round(float(s), 12), j) for j, s in enumerate(dense @ dense[i]) if s > 1e-15 and j != i))[:9]
        got = index.search(*vectors[i], 9, skip=i)
        assert [j for _, j in got] == [j for _, j in want]


def test_held_out_documents(spark, awkward):
    rnd = random.Random(4)
    bad = ["vexo" + e for e in ("a", "en", "ly", "st")]
    rows = []
    for i in range(1200):
        words = prose(rnd, 50).split()
        if i % 6 == 0:
            words[rnd.randrange(50)] = rnd.choice(bad)
        rows.append((i, " ".join(words), "s"))
    extra = [(None if i is None else i + 5000, x, s) for i, x, s in awkward]
    docs = with_clashes(plain(spark, rows + extra))
    lab = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(1200)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = t.classify(docs, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert held and np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.97
    hit = next(r for r in held if r.predicted)
    assert hit.evidence and len(hit.evidence) == len(hit.similarity) and hit.similarity == sorted(hit.similarity, reverse=True)


def test_without_labels_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert t.classify(plain(spark, []), lab).collect() == []
    assert [r.score for r in t.classify(plain(spark, [(1, "a b", "s")]), lab).collect()] == [0.0]
