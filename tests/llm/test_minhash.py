"""Near-duplicates and components against brute force."""

import random

import numpy as np

from vigilflow.llm import components as cc
from vigilflow.llm import minhash as mh

from .conftest import plain, prose, with_clashes


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    ids = sorted({i for i, _, _ in rows})
    sets = {i: shingles(t) for i, t, _ in rows}
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    todo = True
    while todo:
        todo = False
        for a, b in links:
            low = min(label[a], label[b])
            todo |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i] if sets[i] else i) for i in ids}


def corpus():
    """A third of all rows near one text, chains, exact copies in other case, a shared passage, short texts."""
    rnd = random.Random(8)
    base, passage = prose(rnd, 120).split(), prose(rnd, 60)
    rows = []
    for i in range(100):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
        rows.append((i, " ".join(w), "s"))
    chain = prose(rnd, 100).split()
    for i in range(100, 112):
        rows.append((i, " ".join(chain), "s"))
        chain = chain[4:] + prose(rnd, 4).split()
    rows += [(i, f"{passage} {prose(rnd, 40)}", "s") for i in range(112, 180)]
    rows += [(i, prose(rnd, 90), "s") for i in range(180, 260)]
    rows += [(260 + k, t.upper(), "s") for k, (_, t, _) in enumerate(rows[180:200])]
    rows += [(300, "a b", "s"), (301, "A  B", "s"), (302, "a b c d e", "s"), (303, "a b c d", "s"), (304, "ä b", "s"), (305, "Ä b", "s"), (306, None, "s"), (307, " ", "s")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = with_clashes(plain(spark, rows + [rows[7], (None, rows[0][1], "s"), (308, prose(random.Random(1), 30_000), None)]))
    got = mh.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None and r.doc_id < 308} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_large_nodes_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mh, "SMALL", 4)
    monkeypatch.setattr(mh, "BLOCK", 8)
    monkeypatch.setattr(mh, "PART", 8)
    monkeypatch.setattr(mh, "ROUNDS", (False,))  # leaves the most to the comparison of components
    rows = [r for r in corpus() if r[0] < 180]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(plain(spark, rows)).collect()}
    assert got == brute(rows)


def test_deduplicate_keeps_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, None, "s"), (4, None, "s")]
    docs = with_clashes(plain(spark, rows))
    out = mh.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert mh.near_duplicates(plain(spark, [])).collect() == []


def test_a_pair_at_the_threshold_meets_in_some_tree():
    rnd = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        pool = rnd.integers(1, 1 << 63, 800, dtype=np.uint64)
        both, left, right = pool[:300], pool[300:350], pool[350:400]  # 300 / 400
        t = np.array([mh.tokens(np.concatenate([both, x])) for x in (left, right)])
        a, b = mh.paths(t)
        missed += not set(a) & set(b)
    assert missed <= 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}


def test_other_text_of_a_dropped_id_stays(spark):
    rnd = random.Random(12)
    a, b = prose(rnd, 80), prose(rnd, 90)
    docs = with_clashes(plain(spark, [(3, a, "x"), (7, a + " more", "x"), (7, b, "x"), (8, b + " more", "x")]))
    got = mh.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, a), (7, b)]


def test_blocks_return_a_row_per_component_not_per_block(spark, monkeypatch):
    """400 documents of one component and 40 others, all alike: what a node's blocks return grows with the others only."""
    monkeypatch.setattr(mh, "BLOCK", 8)
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 256, mh.TOKENS, dtype=np.uint8)

    def near(k):
        s = base.copy()
        s[rnd.choice(mh.TOKENS, k, replace=False)] ^= np.uint8(1)
        return s

    sk = [near(int(rnd.integers(0, 20))) for _ in range(440)]
    rows = [(5, i, 50, 0 if i < 400 else i, s.tobytes()) for i, s in enumerate(sk)]
    nodes = spark.createDataFrame(rows, "node long, rid long, n long, color long, sketch binary")
    same = {(i, j): int((sk[i] == sk[j]).sum()) for i in range(440) for j in range(i + 1, 440) if j >= 400}
    of = {(i, j): (0 if i < 400 else i, j) for i, j in same}
    got = mh._blocks(nodes).collect()
    assert len(got) <= 40 + 40 // 8 * 3, len(got)
    for c in (0, *range(400, 440)):
        mine = [(-same[p], *p) for p in same if c in of[p] and same[p] >= mh.AGREE]
        have = [(-r.same, r.a, r.b) for r in got if c in (r.ca, r.cb)]
        assert min(mine) == min(have)


def test_block_links_connect_without_listing_pairs(spark, monkeypatch):
    """300 components that are all candidates of each other and linked in chains of ten: only links come back, few of them."""
    monkeypatch.setattr(mh, "BLOCK", 16)
    rnd = np.random.default_rng(6)
    sk = rnd.integers(0, 256, mh.TOKENS, dtype=np.uint8).tobytes()
    rows = []
    for i in range(300):
        if i % 10 == 0:
            s = rnd.integers(1, 1 << 63, 100, dtype=np.uint64)
        s = np.sort(np.concatenate([rnd.permutation(s)[:94], rnd.integers(1, 1 << 63, 6, dtype=np.uint64)]))
        rows.append((5, i, 100, i, sk, s.tobytes()))
    nodes = spark.createDataFrame(rows, "node long, rid long, n long, color long, sketch binary, set binary")
    got = [(r.a, r.b) for r in mh._block_links(nodes).collect()]
    assert all(a // 10 == b // 10 for a, b in got)
    label = list(range(300))
    for _ in range(10):
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    sets = [set(np.frombuffer(r[5], np.uint64).tolist()) for r in rows]
    want = list(range(300))
    for _ in range(10):
        for a in range(300):
            for b in range(a + 1, min(300, a - a % 10 + 10)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert label == want
    assert len(got) <= 300 * 9 // 10 * 2


def test_sketches_are_compared_in_one_python_step(spark):
    rnd = np.random.default_rng(3)
    sk = rnd.integers(0, 2, (40, mh.TOKENS)).astype(np.uint8)
    rows = [(i, 0, sk[i].tobytes(), sk[0].tobytes()) for i in range(40)]
    near = mh.agreeing(spark.createDataFrame(rows, "rid long, head long, x binary, y binary"))
    assert {(r.rid, r.same) for r in near.collect()} == {(i, int((sk[i] == sk[0]).sum())) for i in range(40) if (sk[i] == sk[0]).sum() >= mh.AGREE}
    plan = near.groupBy("rid").max("same")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan
