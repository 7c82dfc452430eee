"""Indicator records: classify, normalise, upsert, expire, count, look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pinned, strip
from ..session import broadcast_if_small

KEY = ("value", "ioc_type", "source")
# Fixed value: spellings of md5, sha1 and sha256.
HASH = r"^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$"
COLUMNS = (*KEY, "provenance", "first_seen", "last_seen", "confidence", "tags", "sightings")


def classify(c) -> Column:
    """Indicator type from its spelling; NULL when unrecognised."""
    v = F.lower(strip(c))
    tail = F.element_at(F.split(v, "/"), -1)
    return (
        F.when(v.isNull() | (v == "") | (F.length(v) > 256), F.lit(None).cast("string"))
        .when(v.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ipv4")
        .when(v.contains("://") & tail.rlike("^[0-9a-f]{32,64}$"), "hash")
        .when(v.contains("://"), "url")
        .when(v.rlike(HASH), "hash")
        .when(v.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), "domain")
    )


def normalise(records: DataFrame) -> DataFrame:
    """Raw feed rows to indicator records; rows whose type cannot be told are dropped.

    Wants ``value, source, first_seen, last_seen, confidence, tags, sightings`` and, optionally, a
    forced ``ioc_type``. Other columns ride along.
    """
    forced = F.col("ioc_type") if "ioc_type" in records.columns else F.lit(None).cast("string")
    first = F.coalesce(F.col("first_seen"), F.lit(0.0)).cast("double")
    last = F.coalesce(F.col("last_seen"), F.lit(0.0)).cast("double")
    first_or_last = F.when(first <= 0, last).otherwise(first)
    fixed = {
        "value": F.col("value"),
        "ioc_type": F.coalesce(F.nullif(forced, F.lit("")), classify("value")),
        "first_seen": first_or_last,
        "last_seen": F.when(last <= 0, first_or_last).otherwise(last),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))),
        "tags": F.coalesce(F.col("tags"), F.lit("")),
        "provenance": F.lit("live"),
        "sightings": F.coalesce(F.col("sightings"), F.lit(1)).cast("int"),
    }
    rest = [c for c in records.columns if c not in fixed]
    trimmed = records.withColumn("value", strip("value"))
    typed = pinned(trimmed, *[e.alias(n) for n, e in fixed.items()], *rest)
    return typed.where(F.col("ioc_type").isNotNull())


def upsert(incoming: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """One row per (value, type, source): widest time span, highest confidence, newest non-empty tag.

    Each conflict adds one sighting to the first writer's count; the first writer's provenance stays.
    ``order`` gives the arrival order of incoming rows; stored rows come before all of them. Every
    aggregate combines map-side, so a key repeated without end costs no more than a rare one.
    """
    cols = [c for c in COLUMNS]
    new = incoming.select(*cols, F.struct(F.lit(1).alias("batch"), F.col(order).alias("at")).alias("_at"))
    if existing is not None:
        kind = new.schema["_at"].dataType.fields[1].dataType
        old = existing.select(*cols, F.struct(F.lit(0).alias("batch"), F.lit(0).cast(kind).alias("at")).alias("_at"))
        new = old.unionByName(new)
    tagged = F.when(F.col("tags") != "", F.col("_at"))
    return new.groupBy(*KEY).agg(
        F.min_by("provenance", "_at").alias("provenance"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("confidence").alias("confidence"),
        F.coalesce(F.max_by("tags", tagged), F.lit("")).alias("tags"),
        (F.min_by("sightings", "_at") + F.count(F.lit(1)) - 1).cast("int").alias("sightings"),
    )


def expired(store: DataFrame, ttl_hours: float, now) -> Column:
    now = now if isinstance(now, Column) else F.lit(float(now))
    return F.col("last_seen") < now - F.lit(ttl_hours * 3600.0)


def expire(store: DataFrame, ttl_hours: float, now) -> DataFrame:
    """Drop indicators whose last sighting is older than the time to live."""
    return store.where(~expired(store, ttl_hours, now))


def expiry_counts(store: DataFrame, ttl_hours: float, now) -> DataFrame:
    gone = expired(store, ttl_hours, now)
    return store.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def lookup(store: DataFrame, values: DataFrame) -> DataFrame:
    """All stored rows of the given values; the value list is broadcast only if counted small."""
    wanted = values.select("value").distinct()
    return store.join(broadcast_if_small(wanted), "value", "left_semi")


def stats(store: DataFrame) -> DataFrame:
    """Totals overall, per type and per source in one pass over the table."""
    return (
        store.groupingSets([[], ["ioc_type"], ["source"]], "ioc_type", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id("ioc_type", "source").alias("_g"))
        .select(
            F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "ioc_type").otherwise("source").alias("dimension"),
            F.coalesce("ioc_type", "source", F.lit("all")).alias("name"),
            "n",
        )
    )
