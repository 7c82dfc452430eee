"""Merkle manifest of a table of documents, built by appending leaves and extending incremental witnesses.

Every document is a leaf; the leaves of a language, by id, form a tree of fan-out 8, and the roots of all languages
form one more. Leaves get their places by sorting in ranges and adding up the ranges' counts. A task then appends the
leaves of one aligned block (``8 ** levels`` of them) one after another: a run that is complete becomes a node of the
level above, and that completion extends the partial witness of every leaf below it by the digests to its left and
right. The roots of the blocks are further appends of the same kind, a table ``8 ** levels`` times shorter, until one
root is left; what they add to their witnesses is joined to the leaves of their blocks. No task ever holds more than
one block, whatever share of the rows a language has, and text is read once and never shuffled.

Defined cases: a null field is ``-``, an empty one ``0:``; leaves with equal ids stand by their digests, null ids
first; repeated rows are leaves of their own; a null language is one more language, before all others; a language with
a single document has that leaf as its root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document's fields; ``text`` stands in for its text."""
    cols = {c: F.col(c) for c in FIELDS} | ({} if text is None else {"text": text})
    return F.sha2(F.concat(*[_field(cols[c]) for c in FIELDS]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


class Appender:
    """The open runs of one block; ``lefts`` and ``rights`` grow with every completed run."""

    def __init__(self, size: int):
        self.lefts: list[list[str]] = [[] for _ in range(size)]
        self.rights: list[list[str]] = [[] for _ in range(size)]
        self.open: list[list[tuple[str, int, int]]] = [[]]  # per level: digest, first and past-last leaf
        self.size = 0

    def append(self, leaf_digest: str) -> None:
        self._push(0, (leaf_digest, self.size, self.size + 1))
        self.size += 1

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [n[0] for n in run]
        for i, (_, a, b) in enumerate(run):
            left, right = "".join(names[:i]), "".join(names[i + 1:])
            for at in range(a, b):
                self.lefts[at].append(left)
                self.rights[at].append(right)
        self._push(level + 1, (digest(names), run[0][1], run[-1][2]))

    def close(self, levels: int | None) -> str:
        """Complete what is open up to ``levels``, or until one node is left; its digest."""
        level = 0
        while level != levels:
            above = any(self.open[level + 1:])
            if levels is None and not above and len(self.open[level]) <= 1:
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def _wider(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def placed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 within ``key`` along ``order`` (nulls first), and ``total``, the key's rows."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if len(b):
                k = b.column(key).to_pandas()
                at = k.groupby(k, sort=False).cumcount() + seen * (k == last)
                last, seen = k.iloc[-1], int(at.iloc[-1]) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(at, pa.int64())], schema.names)

    # equal rows may fill several ranges, so the order ends with a number of their own
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [key, *order, "_tie"]
    schema = _wider(rows, _part=T.IntegerType(), _at=T.LongType())
    sorted_rows = tied.repartitionByRange(*by).sortWithinPartitions(*by).select(*names)
    local = store(sorted_rows.mapInArrow(number, schema), "merkle-ranges")
    counts = local.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    return local.join(offsets, [key, "_part"]).select(*names, (F.col("_at") + F.col("_o")).alias("pos"), "total")


def _blocks(nodes: DataFrame, key: str, levels: int) -> DataFrame:
    """``nodes`` (key, pos, total, node, ...) with lefts, rights, the root of their block, and its place ``block``."""
    size = FAN**levels
    schema = _wider(nodes, block=T.LongType(), lefts=T.ArrayType(T.StringType()), rights=T.ArrayType(T.StringType()), block_root=T.StringType())

    def run(b: pa.Table) -> pa.Table:
        b = b.sort_by("pos")
        tree = Appender(len(b))
        for d in b.column("node").to_pylist():
            tree.append(d)
        root = tree.close(levels if b.column("total")[0].as_py() > size else None)
        lists = pa.list_(pa.string())
        return b.append_column("lefts", pa.array(tree.lefts, lists)).append_column("rights", pa.array(tree.rights, lists)).append_column(
            "block_root", pa.array([root] * len(b))).select(schema.names)

    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy(key, "block").applyInArrow(run, schema)


def witnessed(nodes: DataFrame, key: str, levels: int, longest: int) -> DataFrame:
    """``nodes`` (key, pos, total, node, ...) with whole witnesses (lefts, rights) and the root of their key.

    ``longest`` is the greatest ``total``; it only tells when to stop.
    """
    size = FAN**levels
    low = store(_blocks(nodes, key, levels), "merkle-blocks")
    own = low.withColumnRenamed("block_root", "root").drop("block")
    if longest <= size:
        return own
    up = low.where((F.col("pos") % size == 0) & (F.col("total") > size)).select(
        key, F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("block_root").alias("node"))
    above = witnessed(up, key, levels, -(-longest // size)).select(
        key, F.col("pos").alias("block"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"), F.col("root").alias("_root"))
    none = F.array().cast("array<string>")
    return low.join(above, [key, "block"], "left").select(
        *nodes.columns, F.concat("lefts", F.coalesce("_l", none)).alias("lefts"), F.concat("rights", F.coalesce("_r", none)).alias("rights"),
        F.coalesce("_root", "block_root").alias("root"))


def tree(rows: DataFrame, key: str, order: Sequence[str], levels: int) -> DataFrame:
    """``rows`` (key, node, ...) with lefts, rights and root; the nodes of a key stand along ``order``."""
    nodes = store(placed(rows, key, order), "merkle-placed")
    longest = nodes.agg(F.max("total")).first()[0] or 0
    return witnessed(nodes, key, levels, longest).select(*rows.columns, "lefts", "rights", "root")


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, levels: int = 4) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, and the witness of every document as ``lefts`` and ``rights``: per level, from the
    leaf up, the digests to the left and to the right of its node. ``also`` adds columns computed from ``docs``."""
    extra = also or {}
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("."), "lang"))  # null first, then by bytes
    rows = docs.select("doc_id", "lang", leaf().alias("node"), key.alias("_key"), *[c.alias(n) for n, c in extra.items()])
    low = tree(store(rows, "merkle-leaves"), "_key", ["doc_id", "node"], levels)
    low = store(low.withColumnsRenamed({"node": "leaf", "root": "subroot", "lefts": "_lefts", "rights": "_rights"}), "merkle-low")
    tops = low.groupBy("_key").agg(F.first("subroot").alias("node")).withColumn("_all", F.lit(0))
    high = tree(tops, "_all", ["_key"], levels).select("_key", "lefts", "rights", "root")
    return low.join(high, "_key").select(
        "doc_id", "lang", "leaf", "subroot", "root", F.concat("_lefts", "lefts").alias("lefts"), F.concat("_rights", "rights").alias("rights"), *extra)


def proof() -> Column:
    """Digest of a witness: all its siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.zip_with("lefts", "rights", lambda a, b: F.array(a, b))), ""), 256)


def folded(start: Column) -> Column:
    """The root that a leaf's digest and the witness give."""
    pairs = F.zip_with("lefts", "rights", lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return F.aggregate(pairs, start, lambda at, x: F.sha2(F.concat(x["l"], at, x["r"]), 256))


def audited(docs: DataFrame, levels: int = 4) -> DataFrame:
    """Every document's manifest entry, and whether its leaf still folds to the root after its text was tampered with.

    The text of documents with crc32(doc_id) divisible by 3 is lower-cased (A-Z); a null id counts as empty text there.
    """
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    seen = F.when(changed, leaf(lowered(F.col("text"))))
    m = manifest(docs, {"_seen": seen}, levels)
    out = m.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), folded(F.coalesce("_seen", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
