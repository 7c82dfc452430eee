"""Freshness-aware indicator features: poll grid, sightings, as-of join with a time to live."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, small_enough
from .ranks import ranked

# Addresses of a timeline, counted first, up to which a Bloom filter (two bytes each) is handed to the tasks.
FILTER_VALUES = 2_000_000

FEATURES = ("ioc_src_match", "ioc_dst_match", "feed_age_score", "feed_confidence", "source_count",
            "reputation_bucket")


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def poll_grid(ts, interval_s: float, t0) -> Column:
    """First poll boundary at or after ``ts``; the identity for a zero interval."""
    t = ts if isinstance(ts, Column) else F.col(ts)
    if interval_s <= 1e-9:
        return t
    return _num(t0) + F.ceil((t - _num(t0)) / interval_s) * F.lit(float(interval_s))


# ------------------------------------------------------------------ sightings
def live_entries(iocs: DataFrame) -> DataFrame:
    """One entry at first sight and, when different, one at last sight. Wants ``seq`` as load order."""
    ends = F.when(
        F.col("last_seen") != F.col("first_seen"),
        F.array(F.struct(F.col("first_seen").alias("ts"), F.lit(0).alias("ord")),
                F.struct(F.col("last_seen").alias("ts"), F.lit(1).alias("ord"))),
    ).otherwise(F.array(F.struct(F.col("first_seen").alias("ts"), F.lit(0).alias("ord"))))
    return iocs.select("value", "source", "confidence", "seq", F.explode(ends).alias("e")).select(
        "value", "e.ts", F.col("confidence").cast("double"), F.lit(2).alias("role"), "seq", "e.ord",
        F.lit(True).alias("live"), "source",
    )


def endpoints(flows: DataFrame) -> DataFrame:
    """(ip, role, ts, label) of every non-null endpoint; role 0 = source, 1 = destination."""
    pair = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("role")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(1).alias("role")),
    )
    return flows.select("ts", "label", F.explode(pair).alias("e")).select("e.ip", "e.role", "ts", "label").where(
        F.col("ip").isNotNull()
    )


def ip_roles(flows: DataFrame) -> DataFrame:
    """One row per address: seen malicious at all, and malicious as source and as destination."""
    bad = F.col("label") == 1
    return endpoints(flows).groupBy("ip").agg(
        F.bool_or(bad).alias("malicious"),
        (F.bool_or(bad & (F.col("role") == 0)) & F.bool_or(bad & (F.col("role") == 1))).alias("multi_role"),
    )


def select_injected(
    flows: DataFrame, injection_rate: float = 0.6, benign_rate: float = 0.004, seed: int = 42
) -> DataFrame:
    """Addresses to publish as indicators: a share of the malicious ones plus benign-only noise.

    Exact counts (at least one each), drawn in the order of a seeded hash; returns ``ip, multi_role``.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ip")))
    ips = ip_roles(flows).withColumn("_h", key).withColumn("_slot", F.substring("_h", 1, 2))
    pos = ranked(ips, ["malicious"], "_slot", [F.col("_h")], "_r")
    take = F.when(F.col("malicious"), F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(injection_rate))))
    take = take.otherwise(
        F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(benign_rate))) if benign_rate > 0 else F.lit(0)
    )
    sizes = ips.groupBy("malicious").agg(F.count(F.lit(1)).alias("_n"))  # two rows
    chosen = pos.join(F.broadcast(sizes), "malicious").where(F.col("_r") <= take)
    return chosen.select("ip", "malicious", "multi_role")


def injected_entries(flows: DataFrame, selected: DataFrame) -> DataFrame:
    """Every distinct (address, role, time) at which a selected address was seen."""
    seen = endpoints(flows).where(F.col("ts").isNotNull() & F.col("label").isNotNull())
    # merge repeats before the shuffle that joins the selection
    seen = seen.groupBy("ip", "role", "ts").agg(F.lit(1).alias("_one"))
    return seen.join(selected.select("ip"), "ip", "left_semi").select(
        F.col("ip").alias("value"), "ts", F.lit(None).cast("double").alias("confidence"), "role",
        F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("ord"), F.lit(False).alias("live"),
        F.lit("injected").alias("source"),
    )


def evidence(entries: DataFrame, multi_role: DataFrame | None = None, slot_s: float = 3600.0) -> DataFrame:
    """Rank the merged timeline per value and apply the evidence model to injected entries.

    Live entries keep their own confidence and count one source. Injected ones grow with the rank:
    confidence ``.45 + .07 (r-1)`` up to .95, sources 1 to 3, one more when the address was seen
    malicious in both roles.
    """
    slotted = entries.withColumn("_slot", F.floor(F.col("ts") / slot_s))
    order = [F.col(c) for c in ("ts", "role", "seq", "ord")]
    r = ranked(slotted, ["value"], "_slot", order, "rnk").drop("_slot")
    if multi_role is None:
        both = F.lit(False)
    else:
        flags = multi_role.where(F.col("multi_role")).select(F.col("ip").alias("value"), F.lit(True).alias("_both"))
        r = r.join(flags, "value", "left")
        both = F.coalesce(F.col("_both"), F.lit(False))
    grown = F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.07) * (F.col("rnk") - 1))
    backed = F.lit(1) + (F.col("rnk") >= 2).cast("int") + (F.col("rnk") >= 5).cast("int")
    return r.select(
        *entries.columns, "rnk",
        F.when(F.col("live"), F.col("confidence")).otherwise(grown).alias("conf"),
        F.when(F.col("live"), F.lit(1)).otherwise(F.least(F.lit(3), backed + both.cast("int"))).alias("sources"),
    )


def build_sightings(
    iocs: DataFrame | None, flows: DataFrame | None = None, injection: str = "controlled",
    injection_rate: float = 0.6, benign_rate: float = 0.004, seed: int = 42,
) -> DataFrame:
    """Merged timeline of live and injected sightings: ``value, ts, conf, sources`` and tie-break columns."""
    parts, roles = [], None
    if injection == "controlled" and flows is not None:
        picked = cut(select_injected(flows, injection_rate, benign_rate, seed))
        parts.append(injected_entries(flows, picked))
        roles = picked
    if iocs is not None:
        parts.append(live_entries(iocs))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return evidence(merged, roles)


def sighting_summary(sightings: DataFrame) -> DataFrame:
    """Indicators, live and injected entries, indicators with more than one source."""
    per_value = sightings.groupBy("value").agg(
        F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_injected"),
        F.max("sources").alias("top_sources"),
    )
    return per_value.agg(
        F.count(F.lit(1)).alias("n_indicators"),
        F.coalesce(F.sum("n_live"), F.lit(0)).alias("n_sightings_live"),
        F.coalesce(F.sum("n_injected"), F.lit(0)).alias("n_sightings_injected"),
        F.count_if(F.col("top_sources") > 1).alias("n_multi_source"),
    )


def timeline(sightings: DataFrame, interval_s: float, t0, source_mode: str = "model") -> DataFrame:
    """Collapse sightings to one row per (value, poll time); the last entry of a poll wins.

    ``source_mode='distinct'`` replaces the modelled source count by the number of different feeds that
    had published the value by then.
    """
    at = sightings.withColumn("poll_t", poll_grid("ts", interval_s, t0))
    last = F.max_by(F.struct("conf", "sources"), F.struct("ts", "role", "seq", "ord"))
    out = at.groupBy("value", "poll_t").agg(last.alias("e")).select(
        "value", "poll_t", F.col("e.conf").alias("conf"), F.col("e.sources").alias("sources")
    )
    if source_mode == "model":
        return out
    first = at.groupBy("value", "source").agg(F.min("poll_t").alias("poll_t"))
    new = first.groupBy("value", "poll_t").agg(F.count(F.lit(1)).alias("_new"))
    # rows here are distinct polls of one value, already merged
    so_far = Window.partitionBy("value").orderBy("poll_t").rowsBetween(Window.unboundedPreceding, 0)
    return out.join(new, ["value", "poll_t"], "left").select(
        "value", "poll_t", "conf",
        F.sum(F.coalesce("_new", F.lit(0))).over(so_far).cast("int").alias("sources"),
    )


# ---------------------------------------------------------------- as-of join
def slot_width(interval_s: float, ttl_s: float, densest: int | None = None) -> float:
    """Width of the time slots that join keys carry.

    A slot holds at most width/interval polls and an entry is carried into at most ttl/width later
    slots; the square root balances the two, so neither side grows with the data. When the ``densest``
    value has few polls per time to live, slots may be wider and hardly anything is carried.
    """
    if interval_s <= 1e-9:
        return max(ttl_s / 64.0, 1e-6)
    even = max(interval_s, math.sqrt(ttl_s * interval_s))
    return even if densest is None else min(ttl_s, max(even, ttl_s * 16 / max(densest, 1)))


def densest_value(tl: DataFrame, ttl_s: float, t0) -> int:
    """Most polls of one value within one time to live (one number)."""
    per = tl.groupBy("value", F.floor((F.col("poll_t") - _num(t0)) / ttl_s).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return int(per.agg(F.max("n")).first()[0] or 0)


def slotted_timeline(tl: DataFrame, interval_s: float, ttl_s: float, t0, width: float | None = None) -> DataFrame:
    """Timeline keyed by (value, slot); each slot also starts with the entry still valid from before."""
    width = width or slot_width(interval_s, ttl_s)

    def slot(t: Column) -> Column:
        return F.floor((t - _num(t0)) / width)

    own = tl.withColumn("slot", slot(F.col("poll_t")))
    last = own.groupBy("value", "slot").agg(
        F.max("poll_t").alias("poll_t"), F.max_by("conf", "poll_t").alias("conf"),
        F.max_by("sources", "poll_t").alias("sources"),
    )
    # one row per value and occupied slot
    nxt = F.lead("slot").over(Window.partitionBy("value").orderBy("slot"))
    reach = slot(F.col("poll_t") + ttl_s) + 1
    until = F.least(reach, F.coalesce(F.col("_next"), reach))
    carried = (
        last.withColumn("_next", nxt)
        .where(until > F.col("slot"))
        .select("value", "poll_t", "conf", "sources", F.explode(F.sequence(F.col("slot") + 1, until)).alias("slot"))
    )
    w = Window.partitionBy("value", "slot").orderBy("poll_t")
    return own.unionByName(carried).withColumn("next_t", F.lead("poll_t").over(w))


def asof_join(
    flows: DataFrame, slotted: DataFrame, ip: str, interval_s: float, ttl_s: float, t0, prefix: str,
    strict: bool = False, strategy: str = "interval", width: float | None = None,
) -> DataFrame:
    """Left as-of join of one endpoint: adds ``<prefix>_{visible,age,conf,sources}``.

    ``interval``: equality on (value, slot) with the validity interval as residual; a flow meets only the
    few entries of its slot. ``merge``: distinct (ip, ts) probes are merged with the entries slot by slot
    and joined back by equality; used for a zero poll interval, where a slot has no bound.
    ``strict`` hides a sighting whose poll time equals the flow's own time.
    """
    width = width or slot_width(interval_s, ttl_s)
    fslot = F.floor((F.col("ts") - _num(t0)) / width)
    if strategy == "merge":
        right = _merge_lookup(flows, slotted, ip, fslot, strict)
    else:
        right = slotted.select(
            F.col("value").alias("_v"), F.col("slot").alias("_s"), F.col("poll_t").alias("_p"),
            F.col("next_t").alias("_n"), F.col("conf").alias("_c"), F.col("sources").alias("_k"),
        )
    left = flows.withColumn("_fs", fslot)
    if strategy == "merge":
        cond = (F.col(ip) == F.col("_v")) & (F.col("ts") == F.col("_t"))
    else:
        after = (F.col("ts") > F.col("_p")) if strict else (F.col("ts") >= F.col("_p"))
        before_next = (F.col("ts") <= F.col("_n")) if strict else (F.col("ts") < F.col("_n"))
        cond = (
            (F.col(ip) == F.col("_v")) & (F.col("_fs") == F.col("_s")) & after
            & (F.col("_n").isNull() | before_next)
        )
    j = left.join(right, cond, "left")
    age = F.col("ts") - F.col("_p")
    ok = F.coalesce(age <= ttl_s, F.lit(False))
    return j.select(
        *flows.columns,
        ok.alias(f"{prefix}_visible"),
        F.when(ok, age).alias(f"{prefix}_age"),
        F.when(ok, F.col("_c")).otherwise(F.lit(0.0)).alias(f"{prefix}_conf"),
        F.when(ok, F.col("_k")).otherwise(F.lit(0)).alias(f"{prefix}_sources"),
    )


def _merge_lookup(flows: DataFrame, slotted: DataFrame, ip: str, fslot: Column, strict: bool) -> DataFrame:
    """(ip, ts) -> last entry, by sorting probes and entries together within (ip, slot)."""
    probes = flows.where(F.col(ip).isNotNull()).groupBy(
        F.col(ip).alias("value"), F.col("ts").alias("t"), fslot.alias("slot")
    ).agg(F.lit(None).cast("struct<p:double,c:double,k:int>").alias("e"))
    entries = slotted.select(
        "value", F.col("poll_t").alias("t"), "slot",
        F.struct(F.col("poll_t").alias("p"), F.col("conf").alias("c"), F.col("sources").alias("k")).alias("e"),
    )
    rank_e, rank_p = (1, 0) if strict else (0, 1)
    both = entries.withColumn("kind", F.lit(rank_e)).unionByName(probes.withColumn("kind", F.lit(rank_p)))
    w = Window.partitionBy("value", "slot").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("hit", F.last("e", ignorenulls=True).over(w)).where(
        (F.col("kind") == rank_p) & F.col("hit").isNotNull()
    )
    return seen.select(F.col("value").alias("_v"), F.col("t").alias("_t"), F.col("hit.p").alias("_p"),
                       F.col("hit.c").alias("_c"), F.col("hit.k").alias("_k"))


def address_filter(values: DataFrame, n: int):
    """Bloom filter of the ``n`` addresses in ``value``: a function from a column to whether it may be among them.

    Two bits of sixteen per address, as one row of 64-bit words that Spark computes, stores and hands to every task;
    about 1.4 % of other addresses pass.
    """
    words = max(1, math.ceil(n * 16 / 64))

    def places(c) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(words * 64)) for seed in (1, 2)]

    at = values.select(F.explode(F.array(*places("value"))).alias("p"))
    word, bit = F.floor(F.col("p") / 64), (F.col("p") % 64).cast("int")
    full = at.groupBy(word.alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("w"))
    full = values.sparkSession.range(words).select(F.col("id").alias("i")).join(full, "i", "left").select("i", F.coalesce("w", F.lit(0)).alias("w"))
    row = cut(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")))

    def may_hold(c) -> Column:
        bits = row.select("words").scalar()
        hits = [F.getbit(F.get(bits, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places(c)]
        return F.col(c).isNotNull() & hits[0] & hits[1]

    return may_hold


def enrich(
    flows: DataFrame, tl: DataFrame, interval_s: float, ttl_s: float, half_life_s: float, t0,
    strict: bool = False, strategy: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the six indicator features and ``age_s`` to every flow.

    The better endpoint is the visible one of higher confidence; the destination wins ties. The slotted
    timeline is materialised once, counted, and broadcast only when below ``broadcast_rows``; a larger
    one is joined by shuffle, where AQE splits addresses that own a large share of the flows. Flows without an address
    of the timeline then skip both joins: a Bloom filter of up to ``FILTER_VALUES`` addresses, which are counted,
    parts them at the scan.
    """
    strategy = strategy or ("merge" if interval_s <= 1e-9 else "interval")
    tl = cut(tl)
    width = slot_width(interval_s, ttl_s, densest_value(tl, ttl_s, t0) if strategy == "interval" else None)
    slotted = cut(slotted_timeline(tl, interval_s, ttl_s, t0, width))
    rest = None
    if strategy == "interval" and small_enough(slotted, broadcast_rows):
        slotted = F.broadcast(slotted)
    else:
        n = tl.select("value").distinct().count()
        if 0 < n <= FILTER_VALUES:
            may_hold = address_filter(tl.select("value").distinct(), n)
            known = F.coalesce(may_hold("src_ip"), F.lit(False)) | F.coalesce(may_hold("dst_ip"), F.lit(False))
            flows, rest = flows.where(known), flows.where(~known)
    j = asof_join(flows, slotted, "src_ip", interval_s, ttl_s, t0, "_src", strict, strategy, width)
    j = asof_join(j, slotted, "dst_ip", interval_s, ttl_s, t0, "_dst", strict, strategy, width)
    out = with_features(j, flows.columns, half_life_s)
    return out if rest is None else out.unionByName(_unmatched(rest, half_life_s))


def _unmatched(flows: DataFrame, half_life_s: float) -> DataFrame:
    """The features of flows whose endpoints were never sighted."""
    none = {f"_{side}_{name}": value for side in ("src", "dst") for name, value in (
        ("visible", F.lit(False)), ("age", F.lit(None).cast("double")), ("conf", F.lit(0.0)), ("sources", F.lit(0)))}
    return with_features(flows.withColumns(none), flows.columns, half_life_s)


def with_features(joined: DataFrame, keep, half_life_s: float) -> DataFrame:
    v_s, v_d = F.col("_src_visible"), F.col("_dst_visible")
    use_d = v_d & (~v_s | (F.col("_dst_conf") >= F.col("_src_conf")))
    use_s = v_s & ~use_d
    best = joined.select(
        *keep, use_s.alias("_us"), use_d.alias("_ud"),
        F.when(use_d, F.col("_dst_age")).when(use_s, F.col("_src_age")).alias("age_s"),
        F.when(use_d, F.col("_dst_conf")).when(use_s, F.col("_src_conf")).otherwise(F.lit(0.0)).alias("_conf"),
        F.when(use_d, F.col("_dst_sources")).when(use_s, F.col("_src_sources")).otherwise(F.lit(0)).alias("_srcs"),
    )
    return best.select(
        *keep,
        F.col("_us").cast("int").cast("float").alias("ioc_src_match"),
        F.col("_ud").cast("int").cast("float").alias("ioc_dst_match"),
        age_score(F.col("age_s"), half_life_s).cast("float").alias("feed_age_score"),
        F.col("_conf").cast("float").alias("feed_confidence"),
        F.col("_srcs").cast("float").alias("source_count"),
        reputation(F.col("_conf")).cast("float").alias("reputation_bucket"),
        "age_s",
    )


def age_score(age: Column, half_life_s: float) -> Column:
    """0.5 ^ (age / half-life); 0 for an unmatched flow."""
    return F.coalesce(F.pow(F.lit(0.5), age / F.lit(max(half_life_s, 1e-6))), F.lit(0.0))


def reputation(conf: Column) -> Column:
    return F.when(conf >= 0.8, 3).when(conf >= 0.6, 2).when(conf > 0, 1).otherwise(0)


def matched() -> Column:
    return (F.col("ioc_src_match") + F.col("ioc_dst_match")) > 0


def coverage(enriched: DataFrame, approximate: bool = False) -> DataFrame:
    """Match rate overall, among malicious and among benign flows, with median and p90 age in minutes."""
    from .ranks import exact_percentiles

    # three narrow columns, stored: the rates and the percentiles do not run the join again
    kept = cut(enriched.select("label", matched().cast("int").alias("m"), (F.col("age_s") / 60.0).alias("age_min")))
    rates = kept.agg(
        F.coalesce(F.avg("m"), F.lit(0.0)).alias("coverage_all"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, F.col("m"))), F.lit(0.0)).alias("coverage_malicious"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, F.col("m"))), F.lit(0.0)).alias("coverage_benign"),
    )
    hit = kept.where("m = 1").select("age_min")
    if approximate:
        ages = hit.agg(F.percentile_approx("age_min", 0.5).alias("median_age_min"),
                       F.percentile_approx("age_min", 0.9).alias("p90_age_min"))
    else:
        ages = exact_percentiles(hit, "age_min", {"median_age_min": 0.5, "p90_age_min": 0.9})
    # both sides are single rows
    pair = ages.select(F.struct("median_age_min", "p90_age_min")).scalar()
    return rates.withColumn("_a", pair).select(*rates.columns, "_a.*")
