"""Alignment against sets of byte ranges, and pair counts against counting all links."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from vigilflow.llm import align as al

from .conftest import plain, with_clashes

tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["Hello, world!  Two   spaces", "naïve café ½ 日本語 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ marked ▁", "a\x00b\tc\r\n\n d", " ", "\n", "x" * 3000,
       "don't we'll 12345 !!!???", "Ａ　ｂ", "é ​﻿", "    indented\n\tcode()  "]


@pytest.fixture(scope="module")
def files():
    a, b = (Path(tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return a.read_text(encoding="utf-8"), b.read_bytes()


def ranges(ids, lens):
    end, out = 0, []
    for i in ids:
        out.append((end, end + lens[i], i))
        end += lens[i]
    return out


def brute(rows, files):
    """Every column, from the byte ranges of the libraries' tokens."""
    t = al.Aligner(*files)
    docs = []
    for doc_id, text in rows:
        a = b = []
        if text:
            a = t.a.library.encode(" " + text, add_special_tokens=False).ids
            b = t.b.library.encode(text)
            if any(b"".join(s.bytes[i] for i in ids) != (" " + text).encode() for s, ids in ((t.a, a), (t.b, b))):
                a = b = []
        ra, rb = (ranges(i, [len(x) for x in s.bytes]) for i, s in ((a, t.a), (b, t.b)))
        cuts = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
        groups = [",".join(str(i) for s, e, i in ra if lo < e <= hi) + "|" + ",".join(str(i) for s, e, i in rb if lo < e <= hi)
                                     for lo, hi in zip([0, *cuts], cuts)]
        ends = {}
        for _, e, i in rb:
            ends.setdefault(e, []).append(i)
        docs.append((doc_id, a, b, groups, [(i, j) for _, e, i in ra for j in ends.get(e, [])]))
    count = Counter(p for d in docs for p in d[4])
    top = {}
    for (i, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return sorted(((doc_id, len(a), len(b), len(g), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for doc_id, a, b, g, ls in docs), key=str)


@pytest.mark.parametrize("common", [200_000, 30, 1])
def test_every_column_against_brute_force(spark, awkward, files, common):
    rnd = random.Random(2)
    rows = [(None if i is None else i + 100, t if t is None else t[:4000], s) for i, t, s in awkward] + [(i, t, "s") for i, t in enumerate(ODD)]
    rows += [(1000 + i, "".join(rnd.choice("aB é'1.\n日-") for _ in range(60)), "s") for i in range(60)] + [((1 << 60) + 1, "big id", "s")]
    got = al.scored(with_clashes(plain(spark, rows)), *files, common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, _ in rows], files)


def test_tokens_without_bytes_link_with_all_that_end_there():
    a, b = [2, 0, 1, 3], [1, 1, 0, 4]
    cuts = al.align(a, b)
    assert cuts == ([2, 4], [3, 4])
    assert list(al.links(a, b, cuts)) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 3)]


def test_groups_put_the_text_together_again(spark, files):
    texts = {i: t for i, t in enumerate(ODD)}
    t = al.Aligner(*files)
    for r in al.aligned(plain(spark, [(i, x, "s") for i, x in texts.items()]), *files, with_groups=True).collect():
        if r.n_a:
            for side, at in ((t.a, 0), (t.b, 1)):
                ids = [int(i) for g in r.groups.split(";") for i in g.split("|")[at].split(",")]
                assert b"".join(side.bytes[i] for i in ids).decode() == " " + texts[r.doc_id]


def test_fast_ids_equal_the_library(files):
    a, rnd = al.ByteLevel(files[0]), random.Random(4)
    parts = ["'", "s", "ll", "e", " ", "\n", "a", "1", ".", "é", "日", "🙂", " ", "<|endoftext|>", "ing", "  "]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(80))) for _ in range(3000)] + [" " * 5000 + "x", "\n" * 5000, "ab" * 5000]
    texts += ["".join(chr(c) for c in range(x, x + 64)) for x in range(0, 0x110000, 64) if not 0xD800 <= x < 0xE000]
    assert a.fast is not None
    assert [a.ids(t) for t in texts] == [e.ids for e in a.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def test_empty_table(spark, files):
    assert al.scored(plain(spark, []), *files).collect() == []
