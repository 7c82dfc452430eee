import os
import random

import pytest

from vigilflow.llm import pieces as p

from .conftest import plain, with_clashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["  hello   world ", "a\nb\t\tc", "ﬁ ½ é é", "<s> x</s>", "日本語 €​", " ", "      x", "\n\n", "internationalization 12345 http://a.b/c?d=e", "<0x0A> <unk>", "\x00a", "🙂🙂 x🙂y", "ααα  ▁"]


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(MODEL):
        pytest.skip("no public vocabulary here")
    return p.load(MODEL)


def test_ids_equal_the_library(spark, awkward, vocabulary):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None if i is None else i + 100, t, s_) for i, t, s_ in awkward]
    got = p.encode_decode(with_clashes(plain(spark, rows)), vocabulary, rows=5).collect()
    want = sorted((-1 if i is None else i, s.encode(t or "")) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.n_ids == len(r.ids) for r in got)
    # a text's own space mark comes back as a space
    assert {r.doc_id for r in got if not r.round_trip} == {len(ODD) - 1}
    assert p.encode_decode(plain(spark, []), vocabulary).collect() == []


def test_unigram_scores_against_all_segmentations():
    rnd = random.Random(1)
    ids = {c: i for i, c in enumerate("abc▁")}
    for w in ("ab", "bc", "abc", "ca", "▁a", "aab", "bca"):
        ids[w] = len(ids)
    v = p.Vocabulary(ids, [-rnd.random() * len(w) for w in ids], [], 99, [w.encode() for w in ids], bpe=False)

    def best(w):
        return max(((v.scores[ids[w[:k]]] + best(w[k:])[0], (ids[w[:k]], *best(w[k:])[1])) for k in range(1, len(w) + 1) if w[:k] in ids), default=(0.0, ())) if w else (0.0, ())

    words = ["▁" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    got = p.viterbi(words, v)
    assert all(abs(sum(v.scores[i] for i in got[w]) - best(w)[0]) < 1e-9 for w in words)
