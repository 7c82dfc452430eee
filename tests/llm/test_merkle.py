"""The manifest against a plain recursion over whole lists."""

import hashlib
import random
import zlib

import pytest

from vigilflow.llm import merkle as m

from .conftest import SCHEMA, plain, prose, with_clashes


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def fold(nodes):
    """Root, and per node its siblings level by level."""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[i:i + 8], members[i:i + 8]) for i in range(0, len(nodes), 8)]
        for names, inside in runs:
            for i, group in enumerate(inside):
                for at in group:
                    proofs[at].append((names[:i], names[i + 1:]))
        nodes, members = [sha(*n) for n, _ in runs], [[x for g in ms for x in g] for _, ms in runs]
    return nodes[0], proofs


def climb(at, steps):
    for left, right in steps:
        at = sha(*left, at, *right)
    return at


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plainly(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    tops, found = [], []
    for v in langs:
        here = sorted(by_lang[v], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        root, proofs = fold([leaf_of(r, r.text) for r in here])
        tops.append(root)
        found.append((here, proofs))
    root, above = fold(tops)
    out = []
    for top, up, (here, proofs) in zip(tops, above, found):
        for r, p in zip(here, proofs):
            steps = p + up
            digits = "" if r.doc_id is None else str(r.doc_id)
            seen = lower(r.text) if zlib.crc32(digits.encode()) % 3 == 0 else r.text
            end = climb(leaf_of(r, seen), steps)
            out.append((r.doc_id, leaf_of(r, r.text), top, root, sha(*[s for a, b in steps for s in a + b]), end, end == root))
    return sorted(out, key=str)


def check(docs, levels):
    got = m.audited(docs, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = sorted(map(tuple, got.collect()), key=str), plainly(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    assert got == want
    return got


@pytest.mark.parametrize("levels", [1, 4])
def test_every_column_against_plain_trees(spark, awkward, levels):
    rnd = random.Random(3)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in awkward]
    rows += [(None, "A", None, None, None), (None, "B", None, "", 0), (1 << 60, "Big Id", "", "x", 1), ((1 << 60) + 1, "é Ä ß İ", "é", "x", 1)]
    rows += [(rnd.randrange(5000), prose(rnd, 3).title(), rnd.choice(["en", "en", "de", "fr", "z"]), "s", 9) for _ in range(700)]
    got = check(with_clashes(spark.createDataFrame(rows, SCHEMA)), levels)
    assert {r[-1] for r in got} == {True, False}


def test_sizes_around_the_fan_many_languages_and_one_row_many_times(spark):
    rows = [(i, f"Text {i}", f"n{n}", "s", 6) for n in (1, 2, 8, 9, 64, 65, 513) for i in range(n)]
    check(spark.createDataFrame(rows + [(i, "T", f"l{i}", "s", 1) for i in range(70)] + [(7, "Same", "en", "s", 4)] * 40, SCHEMA), 1)


def test_empty_table(spark):
    assert m.audited(plain(spark, [])).collect() == []


def test_witnesses_fold_to_the_root_and_changes_do_not(spark):
    docs = plain(spark, [(i, f"text {i}", "s") for i in range(30)])
    for r in m.manifest(docs, levels=1).collect():
        steps = list(zip([[x] for x in r.lefts], [[x] for x in r.rights]))
        assert climb(r.leaf, steps) == r.root != climb(sha("other"), steps)
