import random
import re

import pytest

from vigilflow.llm import mixing as m

from .conftest import plain, prose, with_clashes


def water(sizes):
    """Targets by capping and sharing again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and share[s] > 3 * sizes[s]}
        if not over:
            return share
        full |= over


@pytest.fixture(scope="module")
def corpus(awkward):
    rnd = random.Random(3)
    rows = [(100 + i, prose(rnd, int(rnd.paretovariate(1.1) * 10) % 900 + 1), rnd.choice("zzzzzzdefg") if i % 50 else None) for i in range(700)]
    return rows + awkward


def test_targets_and_taken_words(spark, corpus):
    got = m.decide(with_clashes(plain(spark, corpus))).collect()
    size = {}
    for _, t, s in corpus:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, source = water(size), {i: s for i, _, s in corpus}
    assert len(got) == len(corpus)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        else:
            s = "b"
        taken[s] = taken.get(s, 0) + r.taken
    for s in want:
        lengths = [len((t or "").split()) for _, t, x in corpus if x == s]
        # whole documents only: a source of few documents can be half of its longest off
        assert abs(taken[s] - want[s]) <= (0.005 * want[s] + 2 if len(lengths) > 20 else max(lengths) / 2), s
    again = m.decide(plain(spark, list(reversed(corpus)))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str) and sorted(again, key=key)


def test_longer_documents_are_likelier_and_all_ranges_agree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, "w " * (10 if i % 2 else 400), "a") for i in range(2000)] + [(5000 + i, prose(rnd, 20), "b") for i in range(300)]
    docs = plain(spark, rows)
    got = {r.doc_id: r.taken for r in m.decide(docs).collect()}
    monkeypatch.setattr(m, "IN_RANGE", 10)  # many ranges: the same documents
    assert {r.doc_id: r.taken for r in m.decide(docs).collect()} == got
    times = [sum(got[i] // n for i in range(2000) if i % 2 == odd) for odd, n in ((0, 400), (1, 10))]
    assert times[0] > times[1] > 0


def test_mix_repeats_rows_and_empty_tables(spark):
    rows = [(i, "w " * 5, "a") for i in range(50)] + [(100 + i, "v " * 50, "b") for i in range(50)]
    docs = with_clashes(plain(spark, rows))
    taken = {r.doc_id: r.taken // r.size for r in m.decide(docs).collect()}
    out = m.mix(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {i: k for i, k in taken.items() if k} and out.select("_key").first()[0] == "own _key"
    assert m.decide(plain(spark, [])).collect() == [] and m.mix(plain(spark, [])).count() == 0
