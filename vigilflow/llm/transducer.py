"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines read a text; each transition carries what it emits.

* The *splitter* reads characters (by class, with one character of look-ahead folded into the class) and emits the
  beginnings of words, as the vocabulary's splitting pattern sets them. It has eight states, so a chunk's state map is
  a table of where each state leads; the tables of all chunks compose by a parallel prefix scan, and every chunk is
  then run from its true state.
* The *merger* reads the bytes of words and emits by how much the number of tokens changes, so that the sum over a text
  is its count. After any prefix of a word the last token of its encoding is fixed by the last token before it, so a
  state is the set of places where a token may still be growing: for each, the trie node of the bytes since, the tokens
  below it that may follow the token before, and the count there relative to now. A token may follow another if merging
  their joined text gives just these two; at every byte exactly one place allows the token that ends there. States are determinised when they are first met and stay
  in the worker's table, up to a bound. All chunks of a block run abreast, from the state in which words begin. A
  chunk's map is then constant but for its entry: behind the first beginning of a word, or the first place where the
  run from the true entry meets the run from the beginning, both are one. Maps compose from left to right; a chunk is
  run again, up to that place, only if its entry turns out to be another state.

Counting is thus table look-ups over whole arrays. Texts of any length are read in blocks whose end states carry over.

Defined cases: null and empty texts have no tokens; strings of special tokens inside a text count as one token each, as
the library has it; repeated rows are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .align import byte_letters

# Classes of characters. A space or other white space followed by something else in its segment is the LAST of its run.
LETTER, NUMBER, OTHER, SPACE, WHITE, LAST_SPACE, LAST_WHITE, MARK, MARK_1, MARK_2 = range(10)
CLASSES = 10
# States of the splitter: what the word so far is; SHORT_n: n letters of a contraction are still to come.
START, WORD, DIGITS, SIGNS, BEFORE, BLANKS, SHORT_1, SHORT_2 = range(8)
CODES = 0x110000
CHUNK, BLOCK = 256, 1 << 20
STATES = 80_000
MOST_PAIRS = 400_000
WIDE = 200  # trie nodes with more tokens below keep the token before them as it is
NEVER = 1 << 60


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins here) by symbol and state; symbol + CLASSES begins a segment."""
    to, cut = np.zeros((2 * CLASSES, 8), np.uint8), np.ones((2 * CLASSES, 8), bool)
    for c in range(CLASSES):
        for s in range(8):
            run = {LETTER: WORD, NUMBER: DIGITS, OTHER: SIGNS, MARK: SIGNS, MARK_1: SIGNS, MARK_2: SIGNS, SPACE: BLANKS, WHITE: BLANKS, LAST_SPACE: BEFORE, LAST_WHITE: START}[c]
            if s in (SHORT_1, SHORT_2):  # the look-ahead has seen the letters of the contraction
                to[c, s], cut[c, s] = (SHORT_1, False) if s == SHORT_2 else (START, False)
            elif c in (MARK_1, MARK_2) and s not in (SIGNS, BEFORE):
                to[c, s] = SHORT_1 if c == MARK_1 else SHORT_2
            else:
                joins = s == run or s == BEFORE and run in (WORD, DIGITS, SIGNS)
                to[c, s], cut[c, s] = run, not joins or c in (LAST_SPACE, LAST_WHITE)
        to[CLASSES + c] = to[c, START]
    return to, cut


TO, CUT = splitter()


def character_classes() -> np.ndarray:
    """Class of every code point: letters, numbers, white space, all else."""
    import regex

    out = np.full(CODES, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(CODES) if not 0xD800 <= c < 0xE000)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[np.fromiter(map(ord, m.group()), np.int64)] = c
    out[ord(" ")], out[ord("'")] = SPACE, MARK
    return out


def symbols(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Splitter symbols of code points; ``first`` marks where segments begin. The last three are look-ahead only."""
    c = np.concatenate([classes[codes], np.full(3, 255, np.uint8)])
    n = len(codes)
    # the class behind a character, 255 where its segment ends
    new = np.concatenate([first, [True, True, True]])
    after = np.where(new[1:n + 1], 255, c[1:n + 1])
    sym = c[:n].copy()
    blank = (sym == SPACE) | (sym == WHITE)
    sym[blank & (after != 255) & (after != SPACE) & (after != WHITE)] += LAST_SPACE - SPACE
    at = np.flatnonzero(sym == MARK)
    at = at[after[at] != 255]
    x = codes[at + 1]
    sym[at[np.isin(x, [ord(k) for k in "stmd"])]] = MARK_1
    two = at[(at + 2 < n)]
    two = two[~new[two + 2]]
    x, y = codes[two + 1], codes[two + 2]
    sym[two[(np.isin(x, [ord("r"), ord("v")]) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))]] = MARK_2
    return sym + CLASSES * first.astype(np.uint8)


def word_starts(sym: np.ndarray, state: int, chunk: int = 64) -> tuple[np.ndarray, int]:
    """Where words begin, and the state after the last symbol."""
    n = len(sym)
    lanes = -(-n // chunk)
    grid = np.zeros(lanes * chunk, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    # the chunks' state maps, then their prefix composition
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in grid:
        maps = TO[row[:, None], maps]
    step = 1
    while step < lanes:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    at = np.concatenate([[state], maps[:-1, state]]).astype(np.uint8)
    out = np.empty((chunk, lanes), bool)
    last = (n - 1) % chunk
    for i, row in enumerate(grid):
        out[i] = CUT[row, at]
        at = TO[row, at]
        if i == last:
            end = int(at[-1])
    return out.T.ravel()[:n], end


class Full(Exception):
    """The table of states has reached its bound."""


class Merger:
    """The lazily determinised machine over bytes."""

    def __init__(self, tokens: list[bytes], merges: np.ndarray):
        self.tokens = tokens
        self.rank = {(a, b): i for i, (a, b, _) in enumerate(merges.tolist())}
        self.parts = {c: (i, a, b) for i, (a, b, c) in enumerate(merges.tolist())}
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token, self.inner = [-1], [False]
        # tokens in the order of their bytes: those below a node stand together
        order = sorted((t, i) for i, t in enumerate(tokens) if t)
        self.order = [i for _, i in order]
        self.first, self.past = [0], [len(order)]
        for at_order, (t, i) in enumerate(order):
            at = 0
            for b in t:
                self.inner[at] = True
                nxt = self.child.get(at << 8 | b)
                if nxt is None:
                    nxt = self.child[at << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.first.append(at_order)
                    self.past.append(at_order)
                at = nxt
                self.past[at] = at_order + 1
            self.token[at] = i
            self.first[at] = at_order + 1
        self.edges: tuple[dict, dict] = {}, {}
        self.clear()

    def clear(self) -> None:
        root = ((0, -1, 0),)
        self.states, self.ids = [root], {root: 0}
        self.table = np.full((1024, 256), -1, np.int32)
        self.sets: list[frozenset] = []
        self.set_ids: dict[frozenset, int] = {}
        self.known: dict[tuple[int, int], int | None] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens on one side of a token while it is merged, from its byte to itself, each with the rank that ends it."""
        got = self.edges[right].get(token)
        if got is None:
            at, got, rank = token, [], NEVER
            while True:
                got.append((at, rank))
                if at not in self.parts:
                    break
                rank, *halves = self.parts[at]
                at = halves[right]
            got.reverse()
            self.edges[right][token] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives just these two.

        Merges happen by rank, and the parts of a token always before it, so the pairs of parts that ever touch are found
        by walking both edges in the order of ranks. A pair that would merge before either is used up spoils it; of equal
        ranks the left merge comes first.
        """
        left, right = self.edge(a, True), self.edge(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            if across < x_ends and across <= y_ends and across != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def allowed(self, node: int, before: int) -> int | None:
        """Which tokens below ``node`` may still end, as the number of that set; None if none may. ``before`` is such a number
        of a node above, or -2 - t for the token t before (-1: the beginning of a word)."""
        if before < 0 and self.past[node] - self.first[node] > WIDE:
            return before
        key = node, before
        if key in self.known:
            return self.known[key]
        below = self.order[self.first[node]:self.past[node]]
        if before < 0:
            last = -2 - before
            may = frozenset(below if last < 0 else (t for t in below if self.may_follow(last, t)))
        else:
            may = self.sets[before].intersection(below)
        got = self.number(may) if may else None
        if len(self.known) > MOST_PAIRS:
            self.known.clear()
        self.known[key] = got
        return got

    def number(self, may: frozenset) -> int:
        got = self.set_ids.get(may)
        if got is None:
            got = self.set_ids[may] = len(self.sets)
            self.sets.append(may)
        return got

    def enter(self, state: tuple) -> int:
        """A state whose sets are given as such, as one that outlives the table has them."""
        return self.intern(tuple((node, self.number(b) if isinstance(b, frozenset) else b, count) for node, b, count in state))

    def intern(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = len(self.states)
            if i >= STATES:
                raise Full
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.ids[state] = i
            self.states.append(state)
        return i

    def advance(self, state: int, byte: int) -> None:
        """Add the transition of one byte: the next state and the change of the count (plus 128) in the low byte."""
        alive, change, last = [], None, -1
        for node, before, count in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if change is None and t >= 0 and (t in self.sets[before] if before >= 0 else before == -1 or self.may_follow(-2 - before, t)):
                change, last = count + 1, t
            if self.inner[nxt]:
                may = self.allowed(nxt, before)
                if may is not None:
                    alive.append((nxt, may, count))
        new = self.intern((*[(n, b, c - change) for n, b, c in alive], (0, -2 - last, 0)))
        self.table[state, byte] = new << 8 | change + 128

    def step(self, at: np.ndarray, data: np.ndarray) -> np.ndarray:
        v = self.table[at, data]
        while v.min(initial=0) < 0:
            for key in np.unique(at[v < 0].astype(np.int64) << 8 | data[v < 0]).tolist():
                self.advance(key >> 8, key & 255)
            v = self.table[at, data]
        return v

    def changes(self, data: np.ndarray, first: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """Change of the count at every byte, and the state behind the last (sets as such); ``first`` marks the beginnings of
        words."""
        for _ in range(2):
            try:
                return self._changes(data, first, self.enter(entry))
            except Full:
                self.clear()
        half = len(data) // 2  # a single byte always fits an empty table
        left, entry = self.changes(data[:half], first[:half], entry)
        right, entry = self.changes(data[half:], first[half:], entry)
        return np.concatenate([left, right]), entry

    def _changes(self, data: np.ndarray, first: np.ndarray, entry: int) -> tuple[np.ndarray, tuple]:
        n = len(data)
        lanes = -(-n // CHUNK)
        bytes_, begins = np.zeros(lanes * CHUNK, np.uint8), np.ones(lanes * CHUNK, bool)
        bytes_[:n], begins[:n] = data, first
        bytes_, begins = (np.ascontiguousarray(x.reshape(lanes, CHUNK).T) for x in (bytes_, begins))
        states, out = np.empty((CHUNK, lanes), np.int32), np.empty((CHUNK, lanes), np.int16)
        at = np.zeros(lanes, np.int32)
        for i in range(CHUNK):
            at[begins[i]] = 0
            v = self.step(at, bytes_[i])
            at = v >> 8
            states[i], out[i] = at, v & 255
        # entries: what the chunk to the left ends with, where a word runs on
        used = np.zeros(lanes, np.int32)
        while True:
            want = np.concatenate([[entry], states[-1, :-1]]).astype(np.int32)
            want[begins[0]] = 0
            lane = np.flatnonzero(want != used)
            if not len(lane):
                break
            used[lane] = want[lane]
            at = want[lane]
            for i in range(CHUNK):
                stay = ~begins[i, lane] if i else np.ones(len(lane), bool)
                lane, at = lane[stay], at[stay]
                if not len(lane):
                    break
                v = self.step(at, bytes_[i, lane])
                at = v >> 8
                out[i, lane] = v & 255
                same = states[i, lane] == at
                states[i, lane] = at
                lane, at = lane[~same], at[~same]
                if not len(lane):
                    break
        end = tuple((node, self.sets[b] if b >= 0 else b, count) for node, b, count in self.states[states[(n - 1) % CHUNK, -1]])
        return out.T.ravel()[:n] - 128, end


class Vocabulary:
    """What a byte-level BPE definition of the tokenizers library says; other kinds are refused."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        pre, model = d["pre_tokenizer"] or {}, d["model"]
        plain = d["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        added = [t for t in d["added_tokens"] if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if model["type"] != "BPE" or not plain or any(model.get(k) for k in odd) or added:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        self.specials = sorted((t["content"].encode() for t in d["added_tokens"]), key=lambda s: (-len(s), s))
        special = {t["content"] for t in d["added_tokens"]}
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if t not in special:
                self.tokens[i] = bytes(letters[c] for c in t)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        rank = {c: i for i, (_, _, c) in enumerate(self.merges.tolist())}
        single = {i for i, t in enumerate(self.tokens) if len(t) == 1}
        if len(rank) < len(self.merges) or any(p not in single and rank.get(p, NEVER) >= i for i, (a, b, _) in enumerate(self.merges.tolist()) for p in (a, b)):
            raise ValueError("merges out of order")
        self.classes = character_classes()


class Counter:
    """Counts the tokens of many texts at once."""

    def __init__(self, v: Vocabulary):
        self.v, self.merger = v, Merger(v.tokens, v.merges)

    def specials(self, data: bytes, ends: np.ndarray) -> list[tuple[int, int]]:
        """Where strings of special tokens stand inside texts: the first in a text, the longest of those, without overlaps."""
        found = []
        for s in self.v.specials:
            at = data.find(s)
            while at >= 0:
                text = np.searchsorted(ends, at, side="right")
                if at + len(s) <= ends[text]:
                    found.append((at, at + len(s)))
                at = data.find(s, at + 1)
        out, free = [], 0
        for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= free:
                out.append((a, b))
                free = b
        return out

    def count(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Tokens of texts that lie one after another in ``data`` (UTF-8) and end at ``ends``."""
        n = len(data)
        totals = np.zeros(len(ends), np.int64)
        if not n:
            return totals
        special = self.specials(data, ends)
        segment = np.zeros(n + 1, bool)  # beginnings of segments
        segment[0] = True
        segment[ends] = True
        for a, b in special:
            segment[a] = segment[b] = True
        raw = np.frombuffer(data, np.uint8)
        split, merge = START, ((0, -1, 0),)
        for lo in range(0, n, BLOCK):
            a, b = (_lead(raw, min(x, n)) for x in (lo, lo + BLOCK))
            far = b
            for _ in range(3):
                far = _lead(raw, min(far + 1, n))
            part = raw[a:far]
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            codes = np.frombuffer(data[a:far].decode().encode("utf-32-le"), np.uint32)
            inside = int(np.searchsorted(lead, b - a))
            if not inside:
                continue
            sym = symbols(codes, segment[a:far][lead], self.v.classes)[:inside]
            begins, split = word_starts(sym, split)
            first = np.zeros(b - a, bool)
            first[lead[:inside]] = begins
            change, merge = self.merger.changes(raw[a:b], first, merge)
            for x, y in special:  # one token, whatever its bytes would be
                if x < b and y > a:
                    change[max(x, a) - a:min(y, b) - a] = 0
                    if x >= a:
                        change[x - a] = 1
            # the texts that this block touches
            i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left")
            sums = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
            here = np.minimum(ends[i:j + 1], b) - a
            totals[i:j + 1] += np.diff(sums[np.concatenate([[0], here])])
        return totals


def _lead(raw: np.ndarray, at: int) -> int:
    """The first beginning of a character from ``at`` on."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


_COUNTERS: dict[int, Counter] = {}


def counter_of(v: Vocabulary) -> Counter:
    """The worker's machines of a vocabulary; the states that earlier tasks met stay useful."""
    key = hash((v.merges.tobytes(), tuple(v.specials), len(v.tokens)))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(v)
    return _COUNTERS[key]


def joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts' bytes one after another, and where each ends; nulls are empty, broken characters are replaced."""
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = b"".join(raw)
    try:
        data.decode()
    except UnicodeDecodeError:
        raw = [t.decode("utf-8", "replace").encode() for t in raw]
        data = b"".join(raw)
    return data, np.cumsum([len(t) for t in raw], dtype=np.int64)


def token_counts(docs: DataFrame, v: Vocabulary, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(v)
        for b in batches:
            if len(b):
                data, ends = joined(b.column("text"))
                n = counter.count(data, ends)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
