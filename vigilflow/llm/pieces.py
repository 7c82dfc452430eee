"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A task takes the distinct words of many documents (a word begins with its space mark), sorts them, and walks them
as a depth-first traversal of their trie: forward states of a common prefix stay on the path and are reused. The
forward state of a prefix is its best last piece and the score so far. For a unigram vocabulary every piece may
follow every piece, and the best sum of scores wins. For a BPE vocabulary a piece may follow another only if
merging their joined text gives just these two; exactly one path is then left, the one that merging would give.
(A plain sum over BPE ranks would find other segmentations than the model's own.)

Texts are encoded whole. Null and empty texts have no ids. Characters outside the vocabulary become byte pieces.
Decoding gives the text back; a text's own space marks (U+2581) come back as spaces, which ``round_trip`` reports.
Vocabularies whose pieces join a character with a following space mark, and models that normalise their input, are
refused: words could not be encoded alone. Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

MARK = "▁"
CACHE = 100_000


@dataclass
class Vocabulary:
    """Pieces that text can match, the byte pieces and what each id stands for."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]  # of bytes 0 to 255; empty if the model has none
    unknown: int
    out: list[bytes]  # what an id decodes to
    bpe: bool = True
    chars: frozenset = frozenset()
    _pairs: dict[int, bool] = field(default_factory=dict)
    ends: dict[str, int] = field(default_factory=dict)  # every ending of a piece: the piece's id if it is one, else -1

    def __post_init__(self):
        self.ends = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        self.chars = frozenset(p for p in self.ids if len(p) == 1)

    def __reduce__(self):  # tasks build the derived tables anew
        return Vocabulary, (self.ids, self.scores, self.byte_ids, self.unknown, self.out, self.bpe)

    def merged(self, word: str) -> list[int]:
        """Merging, step by step: the highest-scored neighbours first, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = self.ids.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.scores[t] > best):
                    best, at = self.scores[t], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def follows(self, a: int, b: int, text: str) -> bool:
        """Whether piece ``b`` may come after ``a`` (first, if that is -1), ``text`` being their joined text."""
        if len(self._pairs) > 3 * CACHE:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self.merged(text) == ([b] if a < 0 else [a, b])
        return known


def load(model_file: str, bpe: bool = True) -> Vocabulary:
    """Read a model file; ``bpe`` says whether its scores are merge ranks."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
    is_byte = [m.is_byte(i) for i in range(n)]
    out = [b"" if special[i] else bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    ids = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
    bytes_of = {out[i][0]: i for i in range(n) if is_byte[i]}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece runs over the beginning of a word")
    if m.decode(m.encode(" ½  ﬁ ")) != " ½  ﬁ ":
        raise ValueError("the model normalises its input")
    return Vocabulary(ids, [m.get_score(i) for i in range(n)], [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else [], m.unk_id(), out, bpe)


def viterbi(words: Iterable[str], v: Vocabulary) -> dict[str, tuple[int, ...]]:
    """Ids of each distinct word; all its characters are in the vocabulary."""
    done: dict[str, tuple[int, ...]] = {}
    get, pair, follows, bpe, scores = v.ends.get, v._pairs.get, v.follows, v.bpe, v.scores
    piece: list[int | None] = [-1]  # best last piece of each prefix on the path; None if it has no path
    start = [0]
    total = [0.0]
    before = ""
    for w in sorted(set(words)):
        if bpe and w.startswith(MARK + MARK):  # runs of marks have equal scores: only merging itself orders them
            done[w] = tuple(v.merged(w))
            continue
        shared = 0
        for a, b in zip(before, w):
            if a != b:
                break
            shared += 1
        del piece[shared + 1:], start[shared + 1:], total[shared + 1:]
        for j in range(shared + 1, len(w) + 1):
            best, at, most = None, 0, -np.inf
            for i in range(j - 1, -1, -1):
                t = get(w[i:j])
                if t is None:  # no piece ends like this, so none that starts earlier does
                    break
                a = piece[i]
                if t < 0 or a is None:
                    continue
                if bpe:
                    known = pair(a << 32 | t)
                    if known or known is None and follows(a, t, w[start[i]:j]):
                        best, at, most = t, i, total[i] + scores[t]
                        break
                elif total[i] + scores[t] > most:
                    best, at, most = t, i, total[i] + scores[t]
            piece.append(best)
            start.append(at)
            total.append(most)
        before = w
        path, j = [], len(w)
        while j:
            if piece[j] is None:
                raise ValueError(f"no path through {w!r}")
            path.append(piece[j])
            j = start[j]
        done[w] = tuple(reversed(path))
    return done


class Encoder:
    """Encodes batches of texts; keeps the words it met, up to a bound."""

    def __init__(self, v: Vocabulary):
        self.v, self.cache = v, {}
        # a line break outside the vocabulary ends a word like any other such character
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not any("\n" in p for p in v.ids) else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _parts(self, word: str) -> list[str]:
        """The word cut at characters outside the vocabulary."""
        parts, run = [], ""
        for c in word:
            if c in self.v.chars:
                run += c
            else:
                parts += [run, c] if run else [c]
                run = ""
        return parts + [run] if run else parts

    def encode(self, batch: list[str]) -> tuple[array, list[int]]:
        """All ids one after another, and where each text ends."""
        v, split = self.v, self.split
        docs = [split(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        new = set().union(*docs) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = set().union(*docs)
        cut = {w: self._parts(w) for w in new if not v.chars.issuperset(w)}
        plain = (new - cut.keys()).union(p for parts in cut.values() for p in parts if v.chars.issuperset(p))
        found = viterbi(plain, v)
        for w, parts in cut.items():
            found[w] = tuple(chain.from_iterable(
                found[p] if p in found else [v.byte_ids[b] for b in p.encode()] if v.byte_ids else [v.unknown] for p in parts))
        self.cache.update(found)
        ids, ends = array("i"), []
        get = self.cache.__getitem__
        for words in docs:
            ids.extend(chain.from_iterable(map(get, words)))
            ends.append(len(ids))
        return ids, ends


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(v: Vocabulary) -> Encoder:
    """The worker's encoder for a vocabulary; what earlier tasks learned of its words stays useful."""
    key = hash((v.bpe, frozenset(v.ids.items())))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    """Text of the ids, without the space mark that encoding puts first."""
    return b"".join(map(v.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_decode(docs: DataFrame, v: Vocabulary, rows: int = 2000) -> DataFrame:
    """doc_id, ids, n_ids and round_trip (decoding the ids gave the text back) for every document.

    ``rows`` texts share one trie; a batch is also closed at 2 million characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(v)

        def flush(doc_ids: list, batch: list[str]) -> pa.RecordBatch:
            ids, ends = encoder.encode(batch)
            flat = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
            at = np.concatenate([[0], ends]).astype(np.int32)
            same = [decode(ids[a:b], v) == t for a, b, t in zip(at, at[1:], batch)]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())),
                 pa.array(np.diff(at), pa.int32()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

        doc_ids, batch, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                doc_ids.append(i)
                batch.append(t or "")
                size += len(t or "")
                if len(batch) >= rows or size >= 2_000_000:
                    yield flush(doc_ids, batch)
                    doc_ids, batch, size = [], [], 0
        if batch:
            yield flush(doc_ids, batch)
        doc_ids, batch = [], []
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")
