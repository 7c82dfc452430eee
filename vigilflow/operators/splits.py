"""Seeded, exact, repartition-proof sampling and splitting.

Rows are ordered by an md5 of seed and row key. Its leading hex digits cut each class into slots, so a
class that holds nearly all rows is still ranked by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranks import ranked

_HASH, _SLOT, _RANK, _SIZE = "_hash", "_slot", "_rank", "_size"
# hex digits of the slots that are counted to find the hash at a rank
_DIGITS = 4


def hashed(df: DataFrame, key, seed: int, digits: int = 2) -> DataFrame:
    k = key if isinstance(key, Column) else F.col(key)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))
    return df.withColumn(_HASH, h).withColumn(_SLOT, F.substring(_HASH, 1, digits))


def slot_digits(rows: int, rows_per_slot: int = 1_000_000) -> int:
    """Leading hex digits that cut so many rows of one class into slots a task can sort."""
    return max(2, math.ceil(math.log(max(1, rows) / rows_per_slot, 16)))


def class_rank(df: DataFrame, key, seed: int, by: Sequence[str] = ("label",), digits: int | None = None) -> DataFrame:
    """Add ``_rank`` (1..n within the class, hash order) and ``_size`` (rows of the class)."""
    digits = slot_digits(df.count()) if digits is None else digits
    r = ranked(hashed(df, key, seed, digits), list(by), _SLOT, [F.col(_HASH)], _RANK).drop(_SLOT)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(_SIZE))
    # one row per class
    return r.join(F.broadcast(sizes), list(by)).drop(_HASH)


def stratified_subsample(df: DataFrame, max_rows: int, seed: int, key) -> DataFrame:
    """At most ``max_rows`` rows with class shares kept; at least one row per class."""
    total = df.agg(F.count(F.lit(1))).scalar()
    r = class_rank(df, key, seed).withColumn("_total", total)
    take = F.greatest(F.lit(1), F.bround(F.col(_SIZE) * (F.lit(float(max_rows)) / F.col("_total"))).cast("long"))
    keep = (F.col("_total") <= max_rows) | (F.col(_RANK) <= take) if max_rows > 0 else F.lit(True)
    return r.where(keep).select(*df.columns)


def split_borders(
    df: DataFrame, key, seed: int = 42, test_size: float = 0.2, val_size: float = 0.2, by: Sequence[str] = ("label",)
) -> DataFrame:
    """One row per class: the hashes at which ``test`` and ``test`` with ``val`` end in ``train_val_test``.

    Only counts of hash slots are shuffled, and the rows of the slots that hold a border.
    """
    rows = hashed(df, key, seed, _DIGITS).select(*by, _HASH, _SLOT)
    counts = cut(rows.groupBy(*by, _SLOT).agg(F.count(F.lit(1)).alias("_n")))
    # at most 16 ^ digits rows of a class
    so_far = Window.partitionBy(*by).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    slots = counts.withColumn("_upto", F.sum("_n").over(so_far)).withColumn(_SIZE, F.sum("_n").over(Window.partitionBy(*by)))
    n_test, n_val = (F.bround(F.col(_SIZE) * x).cast("long") for x in (test_size, val_size))
    ends = F.array(F.struct(F.lit("_test").alias("end"), n_test.alias("at")), F.struct(F.lit("_val").alias("end"), (n_test + n_val).alias("at")))
    held = slots.select(*by, _SLOT, (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.explode(ends).alias("e")).select(
        *by, _SLOT, "_before", "e.end", "e.at").where((F.col("at") > F.col("_before")) & (F.col("at") <= F.col("_upto")))
    # two rows per class are broadcast
    same = rows.join(F.broadcast(held), [*by, _SLOT]).groupBy(*by, "end", "at", "_before", _HASH).agg(F.count(F.lit(1)).alias("of"))
    inside = Window.partitionBy(*by, "end").orderBy(_HASH).rowsBetween(Window.unboundedPreceding, 0)
    upto = same.withColumn("_upto", F.col("_before") + F.sum("of").over(inside))
    found = upto.where((F.col("_upto") >= F.col("at")) & (F.col("_upto") - F.col("of") < F.col("at")))
    per = found.groupBy(*by).agg(*[F.max(F.when(F.col("end") == c, F.col(_HASH))).alias(c) for c in ("_test", "_val")])
    classes = counts.select(*by).distinct().where(F.concat(*[F.col(c).cast("string") for c in by]).isNotNull())
    # no row comes up to an empty text
    return cut(classes.join(per, list(by), "left").select(*by, *[F.coalesce(c, F.lit("")).alias(c) for c in ("_test", "_val")]))


def train_val_test(
    df: DataFrame, key, seed: int = 42, test_size: float = 0.2, val_size: float = 0.2, by: Sequence[str] = ("label",)
) -> DataFrame:
    """Add ``split``; both sizes are shares of the whole, rounded per class."""
    r = class_rank(df, key, seed, by)
    n_test = F.bround(F.col(_SIZE) * test_size)
    n_val = F.bround(F.col(_SIZE) * val_size)
    split = F.when(F.col(_RANK) <= n_test, "test").when(F.col(_RANK) <= n_test + n_val, "val").otherwise("train")
    return r.select(*df.columns, split.alias("split"))


def split_alike(df: DataFrame, split: DataFrame, keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Other columns (``df``) of the rows that ``train_val_test`` has parted, with their ``split``: the inner join of both on
    ``key``. ``keys`` holds the key of every row of ``df``. Rows of a key that occurs once are parted by the borders again, in
    their place; only others meet the ``split`` table."""
    borders = split_borders(split, key, seed)
    rows = hashed(df.where(F.col(key).isNotNull()), key, seed, _DIGITS).join(F.broadcast(borders), "label", "left")
    own = F.when(F.col(_HASH) <= F.col("_test"), "test").when(F.col(_HASH) <= F.col("_val"), "val").when(F.col("_test").isNotNull(), "train")
    twice = keys.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    theirs = split.select(key, "split").join(twice, key).groupBy(key).agg(F.collect_list("split").alias("_splits"))
    many = cut(twice.join(theirs, key, "left").withColumn("_many", F.lit(True)))
    if many.isEmpty():
        return rows.withColumn("split", own).where(F.col("split").isNotNull()).select(*df.columns, "split")
    met = rows.withColumn("split", own).join(many, key, "left")
    splits = F.when(F.col("_many"), F.col("_splits")).when(F.col("split").isNotNull(), F.array("split"))
    return met.select(*df.columns, F.explode(splits).alias("split"))


def k_folds(
    df: DataFrame, key, k: int = 5, seed: int = 42, inner_val: float = 0.2, by: Sequence[str] = ("label",)
) -> DataFrame:
    """Add ``fold`` 1..k and ``inner`` in [0, 1): the row's place within class and fold.

    Fold f tests on ``fold = f``; of the other rows those with ``inner < inner_val`` tune the threshold.
    """
    r = class_rank(df, key, seed, by)
    pos = F.col(_RANK) - 1
    return r.select(
        *df.columns, (pos % k + 1).cast("int").alias("fold"),
        (F.floor(pos / k) / F.ceil(F.col(_SIZE) / k)).alias("inner"),
    )


def seeded_sample(df: DataFrame, n: int, key, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows in hash order, overall or per ``by``."""
    h = hashed(df, key, seed)
    if not by:
        return h.orderBy(_HASH).limit(n).select(*df.columns)
    r = ranked(h, list(by), _SLOT, [F.col(_HASH)], _RANK)
    return r.where(F.col(_RANK) <= n).select(*df.columns)
