"""Alignment of the tokens that two tokenizers give the same texts.

Per document, the cumulative byte ends of each tokenizer's tokens become a dictionary from end to index. The
intersection of both key sets is the offsets where tokens of both end; sorted, they slice both id lists into groups,
and each slice is expanded into its links: the pairs of a token of either side that end there together.

How often a pair of ids is linked in the whole corpus is counted from each document's distinct pairs. The counts of the
``common`` most frequent pairs, a bounded table, go to every task. Pairs beyond that are rare, at most one link in
``common`` of all, so they are joined by a shuffle without hot keys; nothing is left out.

Defined cases: texts that are null or empty, or whose joined token bytes differ from a space and the text (a text's own
space mark, for one), have no tokens and count zero; special tokens' strings are plain text; long texts are read whole;
repeated rows count once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SPACE_MARK = "▁"
# Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, 256 on for the rest."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level vocabulary in the tokenizers library's JSON; texts come with a space before them.

    Where ids rise with the order of the merges, as they do when every merge adds one token, tiktoken gives the same ids in a
    quarter of the time; other vocabularies are left to the tokenizers library.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        size = self.library.get_vocab_size(with_added_tokens=True)
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.fast = self._ranked(json.loads(definition))

    def _ranked(self, d: dict):
        """The vocabulary for tiktoken, or None."""
        pre, model, special = d["pre_tokenizer"] or {}, d["model"], {t["id"] for t in d["added_tokens"]}
        plain = d["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab[a + b] for a, b in pairs]
        parts = [max(vocab[a], vocab[b]) for a, b in pairs]
        ranks = {t: i for i, t in enumerate(self.bytes) if i not in special}
        if any(x >= y for x, y in zip(ids, ids[1:])) or any(x >= y for x, y in zip(parts, ids)) or len(ranks) != len(ids) + 256:
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> Sequence[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(" " + text)
            except ValueError:  # its splitter gave up on a run of one kind
                pass
        return self.library.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """Side B: a SentencePiece model, which puts the space before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]

    def ids(self, text: str) -> list[int]:
        return self.library.encode_as_ids(text)


Cuts = tuple[Sequence[int], Sequence[int]]  # where groups end in a, and in b


def align(a: Sequence[int], b: Sequence[int]) -> Cuts:
    """Where the groups of two token sequences end (past the last token), from the byte lengths of their tokens."""
    at_a = dict(zip(np.cumsum(a).tolist(), range(1, len(a) + 1)))
    at_b = dict(zip(np.cumsum(b).tolist(), range(1, len(b) + 1)))
    ends = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def links(a: Sequence[int], b: Sequence[int], cuts: Cuts) -> Iterator[tuple[int, int]]:
    """Index pairs of tokens that end together: in every slice the last tokens, and those before them that are followed by
    tokens without bytes only."""
    i = j = 0
    for p, q in zip(*cuts):
        x = p - 1
        while x > i and not a[x]:
            x -= 1
        y = q - 1
        while y > j and not b[y]:
            y -= 1
        yield from ((s, t) for s in range(x, p) for t in range(y, q))
        i, j = p, q


def interleave(n: tuple[int, int], cuts: Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens of both sides when they are written group by group, and which of them end their group."""
    ends = [np.asarray(c, np.int64) for c in cuts]
    sizes = [np.diff(e, prepend=0) for e in ends]
    at_a = np.arange(n[0]) + np.repeat(ends[1] - sizes[1], sizes[0])
    at_b = np.arange(n[1]) + np.repeat(ends[0], sizes[1])
    last = [np.zeros(k, bool) for k in n]
    for flags, e in zip(last, ends):
        flags[e[e > 0] - 1] = True
    return at_a, at_b, *last


class Aligner:
    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteLevel(definition), Pieces(model)
        self.lens = [np.array([len(t) for t in s.bytes], np.int64) for s in (self.a, self.b)]
        # every id with the sign that follows it, as eight bytes: a's within and at the end of a group, then b's
        signed = [f"{i}{sign}".encode() for s, signs in ((self.a, ",|"), (self.b, ",;")) for sign in signs for i in range(len(s.bytes))]
        self.signed = np.array(signed, "S8").view(np.uint64)
        if max(map(len, signed)) > 8:
            raise ValueError("ids of more than seven digits")

    def tokens(self, text: str | None) -> tuple[Sequence[int], Sequence[int]]:
        if not text:
            return [], []
        a, b = self.a.ids(text), self.b.ids(text)
        want = b" " + text.encode()
        # ranked byte tokens always are the text's own bytes
        for side, ids in ((self.b, b),) if self.a.fast else ((self.a, a), (self.b, b)):
            if b"".join(map(side.bytes.__getitem__, ids)) != want:
                return [], []
        return a, b

    def notation(self, a: np.ndarray, b: np.ndarray, cuts: Cuts) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group."""
        at_a, at_b, last_a, last_b = interleave((len(a), len(b)), cuts)
        names = np.empty(len(a) + len(b), np.int64)
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        names[at_a] = a + size_a * last_a
        names[at_b] = b + 2 * size_a + size_b * last_b
        letters = self.signed[names].view(np.uint8)
        return letters[letters != 0].tobytes()[:-1]

    def document(self, text: str | None) -> tuple[np.ndarray, np.ndarray, Cuts, np.ndarray]:
        """Ids of both sides, the groups' ends, and a code (a's id times b's vocabulary plus b's id) per link."""
        ids = tuple(np.array(x, np.int64) for x in self.tokens(text))
        if not len(ids[0]):
            return *ids, ([], []), np.zeros(0, np.int64)
        sizes = [n[i] for n, i in zip(self.lens, ids)]
        cuts = align(*sizes)
        if sizes[0].all() and sizes[1].all():
            at = np.array(cuts, np.int64) - 1  # then the last tokens of a group are its only link
        else:
            at = np.array(list(links(sizes[0], sizes[1], cuts)), np.int64).T
        return *ids, cuts, ids[0][at[0]] * len(self.b.bytes) + ids[1][at[1]]


_ALIGNERS: dict[str, Aligner] = {}


def aligner_of(definition: str, model: bytes) -> Aligner:
    """The worker's aligner for two vocabularies."""
    key = hashlib.sha256(definition.encode() + model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(definition, model)
    return _ALIGNERS[key]


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, definition: str, model: bytes, with_groups: bool = False) -> DataFrame:
    """Per document its counts, the digest of its groups, and its distinct linked pairs with how often each occurs in it;
    ``with_groups`` adds ``groups``, the ids of all groups as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner_of(definition, model)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups
        types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.string()] * with_groups
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                a, b, cuts, codes = al.document(text)
                said = al.notation(a, b, cuts)
                pairs, times = np.unique(codes, return_counts=True)
                rows.append((doc_id, len(a), len(b), len(cuts[0]), len(codes), hashlib.sha256(said).hexdigest() if len(a) else "", pairs, times)
                            + ((said.decode(),) if with_groups else ()))
                held += len(pairs)
                if held > 500_000 or len(rows) >= 1000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", groups string" * with_groups)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, links (how many links of the corpus hold it), best (whether no pair of its b id has more)."""
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links"))
    counts = store(counts.withColumn("b", F.col("pair") % size_b), "align-counts")
    # a b id has at most as many pairs as side A has ids
    return counts.select("pair", "links", (F.col("links") == F.max("links").over(Window.partitionBy("b"))).alias("best"))


def scored(docs: DataFrame, definition: str, model: bytes, common: int = 200_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``common`` bounds the pair counts that are sent to all tasks.
    """
    size_b = aligner_of(definition, model).lens[1].size
    rows = store(aligned(docs, definition, model).withColumn("row", F.monotonically_increasing_id()), "align-rows")
    counts = store(pair_counts(rows, size_b), "align-pairs")
    top = counts.orderBy(F.desc("links"), "pair").limit(common).toPandas().sort_values("pair")
    pair, held, best = top["pair"].to_numpy(np.int64), top["links"].to_numpy(np.int64), top["best"].to_numpy(bool)

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            codes = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
            hit = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            sums = np.zeros((2, len(b)), np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * held[at[hit]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=len(b)))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~hit])) for v in (codes, times)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sums[0]), pa.array(sums[1]), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    found = rows.select("row", "pairs", "times").mapInArrow(lookup, "row long, n_best long, count_sum long, pairs array<long>, times array<int>")
    found = store(found, "align-found")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = rows.select("row", *own, "groups_sha256").join(found.select("row", "n_best", "count_sum"), "row")
    if len(top) < common:  # every pair was among the common ones
        return out.select(*own, "n_best", "count_sum", "groups_sha256")
    left = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = left.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("links")).alias("_sum"))
    zero = F.lit(0).cast("long")
    return out.join(rare, "row", "left").select(*own, (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
                                                (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"), "groups_sha256")
