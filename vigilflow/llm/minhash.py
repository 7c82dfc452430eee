"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles (64-bit hashes), of which ``TOKENS`` minwise tokens are taken.
Documents with equal sets are one row from here on. Independent trees branch recursively: a tree node chooses one or
two of the tokens (by its own hash, 4/3 on average, the inverse of the similarity sought) and a document goes to the
child of each chosen token's value, so that a pair at the threshold keeps meeting in one node on average at every
level. ``TREES`` trees of ``DEPTH`` levels miss such a pair with probability 2e-5 and closer pairs more rarely.

Nodes are then compared:
1. every document with the first one of its nodes; the closest by sketch is confirmed on full sets and joined;
2. nodes whose documents now all belong to one component are done; all others are compared exhaustively by sketch (one
   byte per token) across components, large ones in blocks: twice the closest pair of every component is confirmed and
   joins it, then every two components still apart that have a candidate pair in a small node are compared by all their
   documents, and the candidate pairs of large nodes are confirmed where they meet.
Candidates are confirmed on full sets. Large groups of copies are thereby linked by stars, and the pairs inside a group
are never listed; no pair of different components goes unconfirmed. The sketch leaves out pairs whose tokens agree so
rarely that a true link would do so with probability 3e-6.

Defined cases: a text with fewer than five words has one shingle, all its words; null, empty and blank texts have none
and link with nothing; rows with a null id take no part and are kept; repeated rows are equal documents; long texts are
read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, parallelism
from .common import release, store, texts
from .components import components

WIDTH = 5  # words of a shingle
TOKENS, TREES, DEPTH = 128, 12, 3
# of 128 tokens, 96 agree at similarity 0.75 on average, with a deviation of 4.9
AGREE = 74
SMALL = 64  # documents of a node that are compared exhaustively
BLOCK = 1024
SHINGLES = 1 << 20  # of the documents of a block
PART = 512  # documents of a component that meet others in one task
ROUNDS = (True, True, False)  # twice each component's closest pair, then all pairs still apart
IDS = 2_000_000  # document ids that may be broadcast
_C = np.random.default_rng(20).integers(1, 1 << 63, TOKENS + WIDTH + 8, dtype=np.uint64) | np.uint64(1)
FACTORS, PLACES, OTHER = _C[:TOKENS], _C[TOKENS:TOKENS + WIDTH], _C[TOKENS + WIDTH:]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Hashes of words; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only \x09-\x0D and space split
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = mix(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n))
    if n < WIDTH:
        return mix((h * PLACES[:n]).sum(keepdims=True) + OTHER[0] * np.uint64(n))
    m = n - WIDTH + 1
    s = h[:m] * PLACES[0]
    for k in range(1, WIDTH):
        s = s + h[k:k + m] * PLACES[k]
    return np.unique(mix(s))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(mix(s ^ OTHER[i]).sum(dtype=np.uint64).view(np.int64)) for i in (1, 2))


def tokens(s: np.ndarray) -> np.ndarray:
    """Minwise tokens of a non-empty set."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, a:a + 4096] * FACTORS[:, None]).min(1))
    return mix(low)


def branch(node: np.ndarray, row: np.ndarray, value) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes and the rows they belong to; ``value(row, i)`` gives the rows' i-th tokens."""
    h = mix(node ^ OTHER[3])
    two = (h >> np.uint64(40)) % np.uint64(3) == 0  # 4/3 children on average
    at, rows = np.concatenate([node, node[two]]), np.concatenate([row, row[two]])
    first = (h % np.uint64(TOKENS)).astype(int)
    i = np.concatenate([first, (first[two] + 1 + ((h[two] >> np.uint64(20)) % np.uint64(TOKENS - 1)).astype(int)) % TOKENS])
    return mix(at + mix(value(rows, i) + OTHER[4] * i.astype(np.uint64))), rows


def paths(token_rows: np.ndarray) -> list[np.ndarray]:
    """The nodes that each row of tokens reaches in all trees."""
    n = len(token_rows)
    node = np.repeat(mix(np.arange(TREES, dtype=np.uint64) + OTHER[5]), n)
    row = np.tile(np.arange(n), TREES)
    for _ in range(DEPTH):
        node, row = branch(node, row, lambda r, i: token_rows[r, i])
    order = np.argsort(row, kind="stable")
    return np.split(node[order].view(np.int64), np.cumsum(np.bincount(row, minlength=n))[:-1])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), n, k1, k2 (the set's key), sketch and nodes of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at:at + 500]
                sets = [shingles(t) for t in texts(b["text"])]
                t = np.array([tokens(s) if len(s) else np.zeros(TOKENS, np.uint64) for s in sets]).reshape(len(b), TOKENS)
                nodes = [np.unique(p) if len(s) else [] for p, s in zip(paths(t), sets)]
                keys = [set_key(s) for s in sets]
                yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "n": [len(s) for s in sets], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                                    "sketch": [r.astype(np.uint8).tobytes() for r in t], "nodes": [list(p) for p in nodes]})
        _WORDS.clear()
        release()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, "doc_id long, text_key long, n long, k1 long, k2 long, sketch binary, nodes array<long>")


def agreeing(pairs: DataFrame) -> DataFrame:
    """(rid, head, same) of the pairs (rid, head, x, y) whose sketches agree in enough tokens; one step, as a filter on a
    function's result would be pushed below it and call it twice, in two workers to a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), TOKENS) for c in "xy")
            got = b[["rid", "head"]].assign(same=(x == y).sum(1))
            yield got[got["same"] >= AGREE]

    return pairs.select("rid", "head", "x", "y").mapInPandas(run, "rid long, head long, same int")


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets (sorted distinct values) reach the similarity."""
    p, q = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    both = np.count_nonzero(q[at] == p) if len(p) else 0
    return 100 * both >= 75 * (len(p) + len(q) - both)


def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two sets (sorted 64-bit values) reach the similarity."""
    return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)])


def _sizes_allow(a: str, b: str):
    return (100 * F.least(a, b) >= 75 * F.greatest(a, b))


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, set) of the rows of ``wanted`` (rid, doc_id, k1, k2), from the texts."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shingles(t) for t in texts(b["text"])]
            same = [set_key(s) == (x, y) for s, x, y in zip(got, b["k1"], b["k2"])]  # an id may have other texts too
            yield pd.DataFrame({"rid": b["rid"], "set": [s.tobytes() for s in got]})[same]
        _WORDS.clear()
        release()

    rows = docs.select("doc_id", "text").join(broadcast_if_small(wanted.select("rid", "doc_id", "k1", "k2"), IDS), "doc_id")
    found = rows.select("rid", "k1", "k2", "text").mapInPandas(sets, "rid long, set binary")
    return store(found.dropDuplicates(["rid"]), "minhash-sets")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``reps`` rows whose full sets, taken from the texts again, are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    full = _sets(store(reps.select("rid", "doc_id", "k1", "k2").join(ids, "rid"), "minhash-wanted"), docs)
    # the side with many partners first: its rows are still short then
    p = pairs.join(full.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a").join(full.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b")
    return store(p.where(F.pandas_udf(linked, "boolean")("sa", "sb")).select(*pairs.columns), "minhash-linked")


def _compare(rows: pd.DataFrame, group: np.ndarray, best: bool) -> pd.DataFrame:
    """Candidate pairs of different components within runs of ``group``; with ``best`` the closest of each component in
    a group, otherwise any one of each two components."""
    sk = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), TOKENS)
    rid, n, color = (rows[c].to_numpy() for c in ("rid", "n", "color"))
    out = []
    for k in range(1, len(rows)):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            break
        j = i + k
        ok = (color[i] != color[j]) & (100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        same = (sk[i] == sk[j]).sum(1)
        ok = same >= AGREE
        out.append(np.stack([rid[i[ok]], rid[j[ok]], color[i[ok]], color[j[ok]], same[ok], group[i[ok]]]))
    return _pairs(out, best)


def _pairs(out: list[np.ndarray], best: bool) -> pd.DataFrame:
    got = pd.DataFrame(np.concatenate(out, 1).T if out else np.zeros((0, 6), np.int64), columns=["a", "b", "ca", "cb", "same", "g"])
    flip = got["ca"] > got["cb"]
    got.loc[flip, ["a", "b", "ca", "cb"]] = got.loc[flip, ["b", "a", "cb", "ca"]].to_numpy()
    if best:
        sides = pd.concat([got.assign(side=got["ca"]), got.assign(side=got["cb"])])
        got = sides.sort_values(["same", "a", "b"], ascending=[False, True, True]).drop_duplicates(["g", "side"]).drop_duplicates(["g", "a", "b"])
    else:
        got = got.drop_duplicates(["ca", "cb"])
    return got[["a", "b", "ca", "cb", "same"]].astype("int64")


PAIRS = "a long, b long, ca long, cb long, same long"


def _small(rows: DataFrame, best: bool) -> DataFrame:
    """Exhaustive comparison of small nodes, many in a task, streamed in node order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b])
            last = b["node"].to_numpy() == b["node"].iloc[-1] if len(b) else np.zeros(0, bool)
            rest, b = b[last], b[~last]
            if len(b):
                yield _compare(b, b["node"].to_numpy(), best)
        if rest is not None and len(rest):
            yield _compare(rest, rest["node"].to_numpy(), best)

    return rows.select("node", "rid", "n", "color", "sketch").repartition("node").sortWithinPartitions("node", "rid").mapInPandas(run, PAIRS)


def _meet(sk: np.ndarray, n: np.ndarray, color: np.ndarray, r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of different components between the rows of ``sk`` and those of ``r``, and how many tokens agree."""
    other, m, tint = r
    few, many = ((sk, n, color), r) if len(sk) <= len(other) else (r, (sk, n, color))
    found = []
    for k in range(len(few[0])):
        ok = np.flatnonzero((many[2] != few[2][k]) & (100 * np.minimum(few[1][k], many[1]) >= 75 * np.maximum(few[1][k], many[1])))
        same = (many[0][ok] == few[0][k]).sum(1)
        ok, same = ok[same >= AGREE], same[same >= AGREE]
        found.append((np.full(len(ok), k), ok, same))
    i, j, same = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return (i, j, same) if len(sk) <= len(other) else (j, i, same)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of large nodes, with their columns, dealt by (node, x). The documents of a node's largest component, a large
    group of near copies as a rule, are not compared among themselves: only the others (``minor``) meet all of the node, so
    that the work grows with the group and not with its square. Block ``x`` of them comes first, then the node's rows."""
    colors = rows.groupBy("node", "color").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    order = F.struct("k", -F.col("color"))
    nodes = colors.groupBy("node").agg(F.max_by("color", order).alias("main"), (F.sum("k") - F.max("k")).alias("m"), (F.sum("s") - F.max_by("s", order)).alias("w")).where("m > 0")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / SHINGLES)).cast("int")
    r = rows.join(nodes.select("node", "main", blocks.alias("i")), "node").withColumn("minor", F.col("color") != F.col("main"))
    kept = [*rows.columns, "minor"]
    left = r.where("minor").select(*kept, F.pmod(F.xxhash64("rid"), F.col("i")).cast("int").alias("x"), F.lit(False).alias("right"))
    right = r.select(*kept, F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("x"), F.lit(True).alias("right"))
    # the count is given, as adaptive execution would put all into a few tasks by their bytes
    return left.unionByName(right).repartition(parallelism(rows.sparkSession), "node", "x").sortWithinPartitions("node", "x", "right")


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Each block of ``_dealt`` rows (one object as long as it lasts) with the node's rows, which pass by in batches."""
    key, held, block = None, [], None
    for whole in batches:
        if not len(whole):
            continue
        kinds = whole[["node", "x", "right"]]
        cuts = np.flatnonzero((kinds != kinds.shift()).any(axis=1).to_numpy())
        for lo, hi in zip(cuts, [*cuts[1:], len(whole)]):
            b = whole.iloc[lo:hi]
            at = (b["node"].iloc[0], b["x"].iloc[0])
            if at != key:
                key, held, block = at, [], None
            if not b["right"].iloc[0]:
                held.append(b)
            elif held:  # a block that the hash gave no document has nothing to compare
                block = pd.concat(held, ignore_index=True) if block is None else block
                yield block, b


def _candidates(block: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of different components, as places in ``block`` and ``b``, and how many tokens agree."""
    few, many = (block, b) if len(block) <= len(b) else (b, block)
    x, y = (np.frombuffer(b"".join(d["sketch"]), np.uint8).reshape(len(d), TOKENS) for d in (few, many))
    n, color = many["n"].to_numpy(), many["color"].to_numpy()
    found = []
    for k, (m, c) in enumerate(zip(few["n"].to_numpy(), few["color"].to_numpy())):
        ok = np.flatnonzero((color != c) & (100 * np.minimum(m, n) >= 75 * np.maximum(m, n)))
        same = (y[ok] == x[k]).sum(1)
        ok, same = ok[same >= AGREE], same[same >= AGREE]
        found.append((np.full(len(ok), k), ok, same))
    i, j, same = (np.concatenate(c) for c in zip(*found))
    return (i, j, same) if few is block else (j, i, same)


def _blocks(rows: DataFrame) -> DataFrame:
    """The closest pair of every component in large nodes: one row for each component of a block and one for the node's
    largest, however many rows pass."""

    def meet(block: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j, same = _candidates(block, b)
        (a, ca), (c, cb) = ((d["rid"].to_numpy()[k], d["color"].to_numpy()[k]) for d, k in ((block, i), (b, j)))
        flip, main = ca > cb, ~b["minor"].to_numpy(bool)[j]
        got = pd.DataFrame({"a": np.where(flip, c, a), "b": np.where(flip, a, c), "ca": np.minimum(ca, cb), "cb": np.maximum(ca, cb), "same": same, "side": ca})
        return closest([got, got.assign(side=cb)[main]])

    def closest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["same", "a", "b"], ascending=[False, True, True]).drop_duplicates("side")

    def result(best: pd.DataFrame) -> pd.DataFrame:
        return best.drop_duplicates(["a", "b"])[["a", "b", "ca", "cb", "same"]].astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, None
        for block, b in _meetings(batches):
            if block is not now and best is not None:
                yield result(best)
                best = None
            now, got = block, meet(block, b)
            best = got if best is None else closest([best, got])
        if best is not None:
            yield result(best)

    return _dealt(rows.select("node", "rid", "n", "color", "sketch")).mapInPandas(run, PAIRS)


def _block_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between components of large nodes, whose rows have their ``set`` too. Candidates are confirmed where
    they meet, the closest first, and pairs that the links so far connect are left out: a block returns fewer links than
    its node has components, not its pairs of components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found, up = None, [], {}

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        for block, b in _meetings(batches):
            if block is not now:
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])
                now, found, up = block, [], {}
            i, j, same = _candidates(block, b)
            a, c = block["rid"].to_numpy()[i], b["rid"].to_numpy()[j]
            once = ~b["minor"].to_numpy(bool)[j] | (c > a)  # two of the minor ones meet in both blocks
            order = np.argsort(-same[once], kind="stable")
            i, j = i[once][order], j[once][order]
            colors = zip(block["color"].to_numpy()[i].tolist(), b["color"].to_numpy()[j].tolist())
            left, right = ([np.frombuffer(s, np.uint64) for s in d["set"]] for d in (block, b))
            for x, y, (ca, cb) in zip(i.tolist(), j.tolist(), colors):
                p, q = top(ca), top(cb)
                if p != q and similar(left[x], right[y]):
                    up[max(p, q)] = min(p, q)
                    found.append((min(p, q), max(p, q)))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    return _dealt(rows.select("node", "rid", "n", "color", "sketch", "set")).mapInPandas(run, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (node, rid, n, color, ...) of nodes that hold more than one component, with the node's size c."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("c"), F.min("color").alias("lo"), F.max("color").alias("hi")).where("lo != hi").select("node", "c")
    return rows.drop("c").join(nodes, "node")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("c") <= SMALL), rows.where(F.col("c") > SMALL)


def recolored(small: DataFrame, large: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes under the components that ``merged`` (color, whole) makes, read once and written for the next round; a
    node whose documents are one component by now has no pair left to compare and goes."""
    rows = small.unionByName(large).join(merged, "color", "left").withColumn("color", F.coalesce("whole", "color")).drop("whole")
    return _by_size(store(_mixed(store(rows, "minhash-recolored")), "minhash-mixed"))


def mixed_nodes(shared: DataFrame, reps: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, rid, n, color, sketch, c) that hold more than one component: small ones and large ones."""
    colored = shared.join(comp.select(F.col("node").alias("rid"), "root"), "rid", "left").select(
        "node", "rid", "n", F.coalesce("root", "rid").alias("color"))
    rows = store(_mixed(colored).join(reps.select("rid", "sketch"), "rid"), "minhash-mixed").select("node", "rid", "n", "color", "sketch", "c")
    return _by_size(rows)


def across(small: DataFrame, large: DataFrame) -> DataFrame:
    """The closest pair of documents (a, b) of other components (ca, cb) that each component has in these nodes."""
    pairs = _small(small, True)
    if not large.isEmpty():
        pairs = pairs.unionByName(_blocks(large))
    closest = F.max_by(F.struct("a", "b", "ca", "cb"), F.struct("same", -F.col("a"), -F.col("b")))
    sides = pairs.select("*", F.explode(F.array("ca", "cb")).alias("side"))
    return store(sides.groupBy("side").agg(closest.alias("p")).select("p.*").distinct(), "minhash-across")


def apart(small: DataFrame, large: DataFrame, reps: DataFrame, comp: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between the components that are still apart in these nodes, from all candidate pairs."""
    found = between(store(_small(small, False).select("ca", "cb").distinct(), "minhash-across"), reps, comp, docs)
    if large.isEmpty():
        return found
    ids = large.select("rid").distinct()
    full = _sets(store(reps.select("rid", "doc_id", "k1", "k2").join(ids, "rid"), "minhash-wanted"), docs)
    return found.unionByName(store(_block_links(large.join(full, "rid")).distinct(), "minhash-block-links"))


def between(pairs: DataFrame, reps: DataFrame, color: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (ca, cb) of components that have a link, from all their documents; ``color`` has (rid, color).

    The larger component of a pair is cut into parts of ``PART`` documents. Every part meets the documents of all its
    smaller partners, ``PART`` of them in a task, so that a set travels once for each part and not for each pair.
    """
    ends = pairs.select(F.explode(F.array("ca", "cb")).alias("color")).distinct()
    inside = reps.select("rid", "doc_id", "k1", "k2", "n", "sketch").join(color, "rid", "left").withColumn("color", F.coalesce("color", "rid")).join(ends, "color")
    inside = store(inside, "minhash-between")
    full = inside.join(_sets(inside, docs), "rid").select("color", "rid", "n", "sketch", "set")
    full = store(full, "minhash-between-sets")
    size = full.groupBy("color").agg(F.count("*").alias("size"))
    p = pairs.join(size.select(F.col("color").alias("ca"), F.col("size").alias("sa")), "ca").join(size.select(F.col("color").alias("cb"), F.col("size").alias("sb")), "cb")
    first = F.col("sa") >= F.col("sb")
    p = p.select(F.when(first, F.col("ca")).otherwise(F.col("cb")).alias("big"), F.when(first, F.col("cb")).otherwise(F.col("ca")).alias("low"),
                 F.ceil(F.greatest("sa", "sb") / PART).cast("int").alias("parts"), F.least("sa", "sb").alias("few"))
    p = store(p, "minhash-between-pairs")
    rounds = p.groupBy("big").agg(F.max("parts").alias("parts"), F.ceil(F.sum("few") / PART).cast("int").alias("rounds"))
    left = full.withColumnRenamed("color", "big").join(rounds, "big").select(
        "big", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "n", "sketch", "set")
    right = full.withColumnRenamed("color", "low").join(p.select("big", "low").join(rounds, "big"), "low").select(
        "big", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("rid"), F.col("rounds")).cast("int").alias("round"), "low", F.col("n").alias("m"), F.col("sketch").alias("x"), F.col("set").alias("raw"))

    def meet(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = set()
        if len(l) and len(r):
            sk = [np.frombuffer(b"".join(c), np.uint8).reshape(len(c), TOKENS) for c in (l["sketch"], r["x"])]
            n = l["n"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in l["set"]]
            for low, m, x, raw in zip(r["low"], r["m"], sk[1], r["raw"]):
                if low in found:
                    continue
                same = (sk[0] == x).sum(1)
                ok = np.flatnonzero((same >= AGREE) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m)))
                mine = np.frombuffer(raw, np.uint64)
                for i in ok[np.argsort(-same[ok], kind="stable")]:
                    if similar(sets[i], mine):
                        found.add(low)
                        break
        return pd.DataFrame({"a": [key[0]] * len(found), "b": sorted(found)})

    keys = ["big", "part", "round"]
    return store(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(meet, "a long, b long").distinct(), "minhash-between-links")


def roots(stars: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) that give every b one smaller a: each node jumps to the root of its root until
    none moves, twice as far every round."""
    p = store(stars.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("moved")), "minhash-roots")
    while not p.where("moved").isEmpty():
        up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
        p = store(p.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "minhash-roots")
    return p.select("node", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return _grouped(docs).drop("text_key")


def _grouped(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with text_key, as an id may stand for several texts."""
    signed = store(sign(docs), "minhash-signed")
    alike = signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    reps = store(alike.withColumn("rid", F.monotonically_increasing_id()), "minhash-sets-of-equals")
    leaves = reps.select("rid", "n", F.explode("nodes").alias("node"))
    heads = leaves.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct("rid", "n")).alias("h")).where("c > 1")
    shared = store(leaves.join(heads, "node").select("node", "rid", "n", F.col("h.rid").alias("head"), F.col("h.n").alias("hn")), "minhash-shared")

    # each document with the closest first document of its nodes
    stars = shared.where((F.col("rid") != F.col("head")) & _sizes_allow("n", "hn")).select("rid", "head").distinct()
    sk = reps.select("rid", "sketch")
    near = stars.join(sk.withColumnRenamed("sketch", "x"), "rid").join(sk.select(F.col("rid").alias("head"), F.col("sketch").alias("y")), "head")
    closest = agreeing(near).groupBy("rid").agg(F.max_by("head", F.struct("same", -F.col("head"))).alias("a")).select("a", F.col("rid").alias("b"))
    comp = roots(confirm(store(closest, "minhash-stars"), reps, docs))

    # then between the components that this leaves
    small, large = mixed_nodes(shared, reps, comp)
    comp = comp.select(F.col("node").alias("rid"), F.col("root").alias("color"))
    for best in ROUNDS:
        if best:
            pairs = across(small, large)
            if pairs.isEmpty():
                break
            found = confirm(pairs, reps, docs).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        else:
            found = apart(small, large, reps, comp, docs)
        if found.isEmpty():
            continue
        merged = store(components(found).withColumnsRenamed({"node": "color", "component": "whole"}), "minhash-merged")
        now = broadcast_if_small(merged, IDS)
        small, large = recolored(small, large, now)
        # documents that were a component of their own get a row
        known = comp.join(now, "color", "left").select("rid", F.coalesce("whole", "color").alias("color"))
        alone = merged.select(F.col("color").alias("rid"), F.col("whole").alias("color")).join(comp.select("rid"), "rid", "left_anti")
        comp = store(known.unionByName(alone), "minhash-components")

    named = reps.select("rid", "k1", "k2", "doc_id").join(comp, "rid", "left").withColumn("component", F.coalesce("color", "rid")).drop("color")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "component_id", F.lit(True).alias("has"))
    own = F.when(F.col("n") > 0, F.col("component_id"))
    out = signed.select("doc_id", "text_key", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with one of each group left (the smallest id), with their columns as they are."""
    dropped = _grouped(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    dropped = broadcast_if_small(store(dropped, "minhash-dropped"), IDS)
    # the row as one column, so that no name of the table can clash
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_text"))
    return rows.join(dropped, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left_anti").select("_row.*")
