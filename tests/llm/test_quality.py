import random

import numpy as np

from vigilflow.llm import quality as q

from .conftest import plain, prose, with_clashes


def corpus(rnd, n):
    """Good prose, and text with marks between its words; labels name some of the good ones only."""
    rows = [(i, prose(rnd, 40 + i % 50) if i % 4 else prose(rnd, 60).replace(" ", " | "), "s") for i in range(n)]
    return rows, [(i, 1) for i in range(n) if i % 4 and i % 3 == 0]


def test_separates_without_negative_labels(spark, awkward):
    rows, labels = corpus(random.Random(1), 900)
    extra = [(None if i is None else i + 5000, t, s) for i, t, s in awkward]
    docs = with_clashes(plain(spark, rows + extra))
    lab = spark.createDataFrame([(i, y, 0) for i, y in labels] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    mine = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 900}
    assert np.mean([mine[i] == int(i % 4 != 0) for i in mine]) > 0.97
    same = [r.score for r in got if r.doc_id == 5009]
    assert len(same) == 2 and same[0] == same[1]
    kept = q.keep(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_prior_is_near_the_truth():
    rnd = np.random.default_rng(0)
    unl = np.concatenate([rnd.normal(2, 1, 6000), rnd.normal(-2, 1, 4000)])
    assert abs(q.estimate_prior(rnd.normal(2, 1, 5000), unl) - 0.6) < 0.08


def test_risk_falls_as_in_a_plain_loop():
    """The gradient of the non-negative risk against finite differences."""
    rnd = np.random.default_rng(3)
    code, pos, prior = rnd.integers(0, 6, (40, 2)), np.arange(40) < 15, 0.4

    def risk(w):
        s = q.sigmoid(w[code].sum(1) + w[6])
        loss_p, loss_n = -np.log(s), -np.log(1 - s)
        return prior * loss_p[pos].mean() + max(0.0, loss_n[~pos].mean() - prior * loss_n[pos].mean())

    for scale in (0.0, 0.3, 1.0):
        w = rnd.normal(0, scale, 7)
        steps = [(risk(w + d) - risk(w - d)) / 2e-6 for d in 1e-6 * np.eye(7)]
        loss_n = -np.log(1 - q.sigmoid(w[code].sum(1) + w[6]))
        if loss_n[~pos].mean() >= prior * loss_n[pos].mean():
            assert np.allclose(q._gradient(w, code, pos, prior, 0.0), steps, atol=1e-6)
    w = q._descend(code, 6, pos, prior, 400, 0.0)
    assert risk(w) < risk(np.zeros(7))


def test_one_id_many_times_stays_within_the_sample(spark):
    rnd = random.Random(2)
    rows, labels = corpus(rnd, 200)
    docs = plain(spark, rows + [(0, "the same row", "s")] * 3000 + [(None, "no id", "s")] * 3000)
    lab = spark.createDataFrame([(i, y, 0) for i, y in labels] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, q.trusted(lab), max_positive=50, max_unlabelled=60)
    assert 0 < model.prior < 1


def test_prior_does_not_depend_on_the_order_of_ids(spark):
    rows, labels = corpus(random.Random(1), 900)
    named = set(i for i, _ in labels)
    ids = list(range(900))
    random.Random(7).shuffle(ids)
    for new in (range(900), ids):
        docs = plain(spark, [(new[i], t, s) for i, t, s in rows])
        lab = spark.createDataFrame([(new[i],) for i in named], "doc_id long")
        assert abs(q.fit(docs, lab).prior - 0.75) < 0.15


def test_empty_tables(spark):
    docs = plain(spark, [])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.classify(docs, lab).collect() == []
    assert [r.score for r in q.classify(plain(spark, [(1, "a b", "s")]), lab).collect()] == [0.5]
