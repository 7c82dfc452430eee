"""Token counts against the library, for characters, splits, special strings, long texts and a tiny table of states."""

import random
from pathlib import Path

import numpy as np
import pytest

from vigilflow.llm import transducer as tr

from .conftest import plain, with_clashes

public = pytest.importorskip("public_tokenizers")
DEFINITION = Path(public.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
SPECIAL = "<|endoftext|>"
ODD = ["", "Hello, world!  Two   spaces", "it's we'll don't you're I'm he'd they've 'tis 's''s !'s  's\n's x'sy'llz 'l 'r 've", SPECIAL, f"a{SPECIAL}b {SPECIAL}{SPECIAL} 's",
       f"x  {SPECIAL}  y", SPECIAL[:-1], " ", "  ", "\n\n x\n y  \t z", "日本語 €​ 🙂🙂", "1234 ½ ²", "a  b c", "\x1c\x1d a\x85b", "A" * 1000, " " * 1000 + "x", "-" * 700]


@pytest.fixture(scope="module")
def vocabulary():
    return tr.Vocabulary(DEFINITION)


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_str(DEFINITION)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def counted(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.count(b"".join(raw), np.cumsum([len(t) for t in raw])).tolist()


def test_every_column(spark, awkward, vocabulary, library):
    rows = [(None if i is None else i + 100, t, s) for i, t, s in awkward] + [(i, t, "s") for i, t in enumerate(ODD)] + [((1 << 60) + 1, "word " * 512, "s")]
    got = tr.token_counts(with_clashes(plain(spark, rows)), vocabulary).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, expected(library, [t or "" for _, t, _ in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tr.token_counts(plain(spark, []), vocabulary).collect() == []


def test_random_texts_and_every_character(vocabulary, library):
    rnd, counter = random.Random(1), tr.Counter(vocabulary)
    parts = ["'", "s", "l", "r", "e", " ", "\n", "a", "1", ".", "é", "日", "🙂", " ", SPECIAL, "ing", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(80))) for _ in range(4000)]
    texts += ["".join(chr(c) for c in range(a, a + 64)) for a in range(0, tr.CODES, 64) if not 0xD800 <= a < 0xE000]
    assert counted(counter, texts) == expected(library, texts)


def test_small_blocks_chunks_and_tables(vocabulary, library, monkeypatch):
    """Words over many chunks and blocks, and a table that overflows all the time."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(5000)), "é" * 3000, "x" + "'ll" * 900, " \n" * 800, "".join(rnd.choice("ab c1.'é日") for _ in range(4000)), f"{SPECIAL}z" * 200]
    for chunk, block, states in ((16, 1 << 20, 60_000), (256, 1000, 60_000), (32, 777, 400), (8, 64, 300)):
        for name, value in (("CHUNK", chunk), ("BLOCK", block), ("STATES", states)):
            monkeypatch.setattr(tr, name, value)
        assert counted(tr.Counter(vocabulary), texts) == expected(library, texts)


def test_splitter_scan_equals_one_step_at_a_time():
    rnd = np.random.default_rng(3)
    sym = rnd.integers(0, tr.CLASSES, 1000).astype(np.uint8)
    for chunk in (1, 7, 64, 2000):
        for entry in range(8):
            at, want = entry, []
            for s in sym:
                want.append(bool(tr.CUT[s, at]))
                at = int(tr.TO[s, at])
            got, end = tr.word_starts(sym, entry, chunk)
            assert got.tolist() == want and end == at


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        tr.Vocabulary(Path(public.path("word_bpe_49k.json")).read_text(encoding="utf-8"))
