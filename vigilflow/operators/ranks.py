"""Ranks and running totals over whole tables without a single-task sort.

Ordered work is cut into ranges. Each range is sorted on its own, range totals (one small row per
range) are accumulated, and the two are added. No window ever spans more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism

RANGE = "_range"


def with_ranges(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Add an order-preserving range number for a double column.

    Boundaries are approximate quantiles (one aggregate, at most ``n`` numbers reach the driver), so
    ranges stay even whatever the distribution. Once taken they are literals in the plan: a recomputed
    task places a row in the same range again.
    """
    n = n or parallelism(df.sparkSession)
    cuts = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted({float(c) for c in cuts})
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(RANGE, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol=RANGE, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Inclusive running sums of ``{output: input}`` along ``order`` within ``by``.

    ``df`` carries :data:`RANGE`. Rows that tie on ``order`` must already be merged into one.
    """
    keys = [*by, RANGE]
    totals = df.groupBy(*keys).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    rng = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    # one row per range: its size is the session's shuffle width, not the data
    before = Window.partitionBy(*by).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(src).over(inside).alias(f"_l_{out}") for out, src in sums.items()])
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums]
    )


def ranked(df: DataFrame, keys: Sequence[str], slot: str, order: Sequence[Column], name: str = "rnk") -> DataFrame:
    """Exact row number within ``keys``, where ``slot`` is an order-preserving bucket of ``order``.

    A key that owns a large share of all rows is spread over its slots.
    """
    k = [*keys, slot]
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).select(
        *k, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    local = df.withColumn("_l", F.row_number().over(Window.partitionBy(*k).orderBy(*order)))
    return local.join(offsets, k).select(*df.columns, (F.col("_l") + F.col("_o")).alias(name))


def exact_percentiles(
    df: DataFrame, col: str, qs: dict[str, float], by: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Linear-interpolated percentiles, exact, one row per ``by``; NULLs are ignored.

    Values are first merged into (value, count), then ranked by ranges, so neither a repeated value nor
    a large group ends up in one task.
    """
    merged = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    cum = running_totals(with_ranges(merged, "_v", n), [F.col("_v")], {"_cum": "_c"}, by)
    totals = merged.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if by:
        cum = cum.join(totals, list(by))
    else:
        cum = cum.withColumn("_n", totals.select("_n").scalar())
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    aggs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = F.max(pos - F.floor(pos))
        v_lo = F.max(F.when((first <= lo) & (lo <= last), F.col("_v")))
        v_hi = F.max(F.when((first <= hi) & (hi <= last), F.col("_v")))
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return cum.groupBy(*by).agg(*aggs)
