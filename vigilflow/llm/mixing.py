"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A source below its target is first repeated whole, ``floor(target /
size)`` times for each of its documents. What is left of the target is sampled: a document's inclusion probability
grows with its length (fragments count for less) and is scaled so that the expected words are those still wanted;
documents that reach probability 1 are certain. The others are ranked by ``(u / (1 - u)) / (p / (1 - p))``, the odds
of a uniform number from the id's md5 over the odds of inclusion, and are taken in that order as long as the sum of
words stays within the target. One more document, whose size is nearest to what is still missing, is added if that
brings the sum nearer.

Nothing is ranked as a whole: words are summed by source and range of the ranking, and only the documents in the range
where the target falls are put in order. The result is a rule of a few numbers per source, applied to every document.

Defined cases: null and empty texts have size 0 and are repeated like their source but never sampled; a null source
is a source of its own, last in order; documents with the same id, size and source are taken alike (a null id counts
as empty text in the random number); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import WORD, store

MOST = 3  # copies of a document at most
IN_RANGE = 2000  # documents that a range of the ranking should hold


def source_key(source: Column) -> Column:
    """Orders sources by code point, the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sized(docs: DataFrame) -> DataFrame:
    """The columns the sampling works on, next to those of ``docs``: _key, _size, _u."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12)
    return docs.withColumns({
        "_key": source_key(F.col("source")),
        "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_u": (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48)),
    })


def targets(sizes: DataFrame) -> DataFrame:
    """_key, source_size, target, whole copies and words left to sample, from one row (_key, source_size) per source.

    The share of a source is its weight (1, 2, 3 in turn) of all words, at most MOST times its size; the excess goes to
    the others by weight. That is one level for all sources that keep below their limit, found from running sums over
    the sources in the order in which they reach it. The two windows see one row per source.
    """
    every, order = Window.partitionBy(), Window.orderBy("_limit", "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = sizes.withColumn("_weight", (F.row_number().over(Window.orderBy("_key")) - 1) % 3 + 1)
    w = w.withColumn("_limit", MOST * F.col("source_size") / F.col("_weight"))
    w = w.withColumns({
        "_left": F.sum("source_size").over(every) - F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0)),
        "_weights": F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0)),
    })
    w = w.withColumn("_level", F.col("_left") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "_key", "_level"))).over(every)["_level"]
    w = w.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("_weight")))
    w = w.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    return w.select("_key", "source_size", "target", "_whole", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long").alias("_rest"))


def importance(size: Column) -> Column:
    """Relative inclusion probability in thousandths; a whole number, so that sums do not depend on their order."""
    return F.floor(1000 * size / (size + 100)).cast("long")


def _odds(p: Column) -> Column:
    """Rank of the Pareto design; only for probabilities between 0 and 1."""
    return F.when((p > 0) & (p < 1), (F.col("_u") / (1 - F.col("_u"))) * ((1 - p) / p))


def _ranked(rows: DataFrame, ranges: int) -> DataFrame:
    q = _odds(F.col("_scale") * importance(F.col("_size")))
    rows = rows.withColumn("_q", q)
    return rows.withColumn("_range", F.floor(F.col("_q") / (1 + F.col("_q")) * ranges))


def _order() -> Column:
    return F.struct("_q", "_u", "doc_id", "_size")


def rule(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per source all that decides on a document, and the number of ranges; ``rows`` has doc_id, _key, _size, _u."""
    hist = store(rows.groupBy("_key", "_size").count(), "mix-sizes")
    per = store(targets(hist.groupBy("_key").agg(F.sum(F.col("_size") * F.col("count")).alias("source_size"))), "mix-targets")
    most = hist.groupBy("_key").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = max(1, -(-most // IN_RANGE))

    # scale of the probabilities: the longest sizes become certain until the rest stay below 1
    h = hist.where("_size > 0").join(broadcast_if_small(per), "_key").withColumn("_g", importance(F.col("_size")))
    down = Window.partitionBy("_key").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    words, mass = F.col("count") * F.col("_size"), F.col("count") * F.col("_g") * F.col("_size")
    h = h.withColumns({
        "_sure": F.coalesce(F.sum(words).over(down), F.lit(0)),
        "_mass": F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(down), F.lit(0)),
    }).withColumn("_c", (F.col("_rest") - F.col("_sure")) / F.col("_mass"))
    scale = F.max(F.when(F.col("_c") * F.col("_g") <= 1, F.struct("_size", "_c")))
    h = h.withColumn("_scale", scale.over(whole)["_c"])
    sure = F.sum(F.when(F.col("_scale") * F.col("_g") >= 1, words).otherwise(0))
    scales = h.groupBy("_key").agg(F.first("_scale").alias("_scale"), sure.alias("_sure"))
    per = store(per.join(scales, "_key", "left").withColumn("_open", F.col("_rest") - F.coalesce("_sure", F.lit(0))).drop("_sure"), "mix-scales")

    # the range in which each source's words pass what is open
    open_rows = _ranked(rows.join(broadcast_if_small(per), "_key"), ranges).where("_q is not null")
    sums = open_rows.groupBy("_key", "_range").agg(F.sum("_size").alias("_words"), F.first("_open").alias("_open"))
    cum = F.sum("_words").over(Window.partitionBy("_key").orderBy("_range"))
    sums = sums.withColumn("_cum", cum).where(F.col("_cum") > F.col("_open"))
    at = F.min(F.struct("_range", (F.col("_cum") - F.col("_words")).alias("_before")))
    per = store(per.join(sums.groupBy("_key").agg(at.alias("_at")), "_key", "left").select("*", F.col("_at._range").alias("_last"), F.col("_at._before").alias("_before")).drop("_at"), "mix-ranges")

    # order inside that range only
    inside = _ranked(rows.join(broadcast_if_small(per), "_key"), ranges).where(F.col("_range") == F.col("_last"))
    run = F.sum("_size").over(Window.partitionBy("_key").orderBy(_order()).rowsBetween(Window.unboundedPreceding, 0))
    fit = inside.withColumn("_cum", F.col("_before") + run).where(F.col("_cum") <= F.col("_open"))
    cuts = fit.groupBy("_key").agg(F.max(_order()).alias("_cut"), F.max("_cum").alias("_have"))
    per = per.join(cuts, "_key", "left").withColumn("_gap", F.when(F.col("_last").isNotNull(), F.col("_open") - F.coalesce("_have", "_before")).otherwise(0))
    per = store(per.drop("_have", "_before"), "mix-cuts")

    # the document that fills what is still missing
    rest = _ranked(rows.join(broadcast_if_small(per.where("_gap > 0")), "_key"), ranges).where(F.col("_q").isNotNull() & ~_in_order())
    near = F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("_off"), _order().alias("_o")))
    extra = rest.groupBy("_key").agg(near.alias("_n"), F.first("_gap").alias("_g")).where("_n._off < _g").select("_key", F.col("_n._o").alias("_extra"))
    return store(per.join(extra, "_key", "left"), "mix-rule"), ranges


def _in_order() -> Column:
    return F.coalesce((F.col("_range") < F.col("_last")) | ((F.col("_range") == F.col("_last")) & F.coalesce(_order() <= F.col("_cut"), F.lit(False))) | (F.col("_range").isNotNull() & F.col("_last").isNull()), F.lit(False))


def copies(rows: DataFrame, how: DataFrame, ranges: int) -> DataFrame:
    """Add _copies (how often the mix takes the row), source_size and target to ``rows``."""
    r = _ranked(rows.join(broadcast_if_small(how), "_key"), ranges)
    sure = F.coalesce(F.col("_scale") * importance(F.col("_size")) >= 1, F.lit(False))
    extra = F.coalesce(_order() == F.col("_extra"), F.lit(False))
    r = r.withColumn("_copies", (F.col("_whole") + (sure | _in_order() | extra).cast("long")).cast("long"))
    return r.select(*rows.columns, "_copies", "source_size", "target")


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    rows = store(sized(docs.select("doc_id", "source", "text")).select("doc_id", "_key", "_size", "_u"), "mix-rows")
    got = copies(rows, *rule(rows))
    return got.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its columns as they are."""
    rows = store(sized(docs.select("doc_id", "source", "text")).select("doc_id", "_key", "_size", "_u"), "mix-rows")
    # the row as one column, so that no name of the table can clash
    whole = sized(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"))
    got = copies(whole, *rule(rows)).where("_copies > 0")
    return got.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
