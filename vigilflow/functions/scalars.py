"""Column expressions shared by readers, feeds and operators. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITESPACE = " \t\r\n\x0b\x0c"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.btrim(_col(c), F.lit(_WHITESPACE))


def pinned(df: DataFrame, *cols) -> DataFrame:
    """Project ``cols`` once. A one-row generator keeps later filters from being pushed below and
    computing the same parsing again."""
    return df.select(F.explode(F.array(F.struct(*cols))).alias("_row")).select("_row.*")


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim header names (byte-order mark included) and every string column."""
    named = df.toDF(*[n.replace("﻿", "").strip() for n in df.columns])
    return named.select(
        *[strip(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
          for f in named.schema.fields]
    )


def number(c) -> Column:
    """Numeric cast that yields NULL instead of failing; NaN counts as missing."""
    return F.nullif(_col(c).try_cast("double"), F.lit(float("nan")))


def safe_double(c, default: float = 0.0) -> Column:
    """Numeric value with blanks, dashes and junk replaced by ``default``."""
    return F.coalesce(number(c), F.lit(float(default)))


def safe_int(c, default: int = 0) -> Column:
    """Truncated numeric value with the same defaulting as :func:`safe_double`."""
    return F.coalesce(number(c), F.lit(float(default))).try_cast("int")


def finite(c) -> Column:
    """NULL, NaN and infinities become 0."""
    d = _col(c).cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def epoch(ts: Column) -> Column:
    """Timestamp to epoch seconds as a double."""
    return ts.cast("timestamp").cast("double")


# Day-first patterns are tried before month-first ones, each row on its own.
FLOW_TIME_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "M/d/yyyy H:m:s", "M/d/yyyy H:m")
FEED_TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d")


def parse_first(c, formats: Sequence[str]) -> Column:
    """First format that parses wins, row by row."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])


def flow_time(c) -> Column:
    return parse_first(strip(c), FLOW_TIME_FORMATS)


def iso_epoch(c) -> Column:
    """Epoch number, or ISO-8601 text (naive = UTC); 0 when neither."""
    s = F.regexp_replace(strip(_col(c).cast("string")), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(strip(_col(c).cast("string")).try_cast("double"), epoch(s.try_cast("timestamp")), F.lit(0.0))


def feed_epoch(c) -> Column:
    """Feed time text to epoch seconds; NULL when it does not parse."""
    s = F.trim(F.replace(F.replace(strip(c), F.lit(" UTC"), F.lit("")), F.lit("Z"), F.lit("")))
    return F.coalesce(epoch(parse_first(s, FEED_TIME_FORMATS)), epoch(F.nullif(s, F.lit("")).try_cast("timestamp")))


def strip_port(c) -> Column:
    """``host:port`` to ``host`` when there is exactly one colon and no bracket."""
    s = strip(c)
    one_colon = F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit(""))) == 1
    return F.when(one_colon & ~s.startswith("["), F.split_part(s, F.lit(":"), F.lit(1))).otherwise(s)


def strip_piped_port(value, kind) -> Column:
    """``value|port`` to ``value`` for attribute types that end in ``|port``."""
    v, k = _col(value), _col(kind)
    return F.when(k.endswith("|port"), F.split_part(v, F.lit("|"), F.lit(1))).otherwise(v)


def first_token(c) -> Column:
    """struct(value, tail): the first comma also separates, then the first run of white space."""
    spaced = strip(F.regexp_replace(_col(c), r"^([^,]*),", "$1 "))
    parts = F.split(spaced, r"\s+", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("value"),
        F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")).alias("tail"),
    )


def vocab(c, mapping: Mapping[str, str], default: str) -> Column:
    """Dictionary lookup with a default, as one literal map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[_col(c)], F.lit(default))


def proto_family(c) -> Column:
    """Protocol names and numbers to tcp / udp / icmp / other."""
    p = F.lower(strip(_col(c).cast("string")))
    return (
        F.when(p.isin("tcp", "6"), "tcp")
        .when(p.isin("udp", "17"), "udp")
        .when(p.isin("icmp", "1", "icmp6"), "icmp")
        .otherwise("other")
    )


def lowered_map(m) -> Column:
    """The map with lower-cased keys; of keys that differ in case alone the last one stays."""
    keys = F.transform(F.map_keys(m), F.lower)
    pairs = F.arrays_zip(keys.alias("key"), F.map_values(m).alias("value"))
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    plain = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(plain, F.map_from_arrays(keys, F.map_values(m))).otherwise(F.map_from_entries(last))


def map_lookup(exact: str, lowered: str) -> Callable[[str], Column]:
    """Key lookup in a string map: exact spelling first, then any spelling that differs in case."""
    return lambda key: F.coalesce(F.col(exact)[key], F.col(lowered)[key.lower()])


def column_lookup(df: DataFrame) -> Callable[[str], Column | None]:
    """The same lookup over the columns of a frame, resolved while planning."""
    exact = {c: c for c in df.columns}
    lowered = {c.lower(): c for c in df.columns}

    def get(key: str) -> Column | None:
        name = exact.get(key) or lowered.get(key.lower())
        return F.col(f"`{name}`") if name else None

    return get


def first_alias(get, keys: Sequence[str]) -> Column:
    """First non-empty value among ``keys``."""
    found = [F.nullif(c.cast("string"), F.lit("")) for c in map(get, keys) if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def narrowest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast numeric columns to the smallest type that holds their observed range (one aggregate pass)."""
    aggs = []
    for c in cols:
        d = F.col(c).cast("double")
        aggs += [F.min(d).alias(f"lo_{c}"), F.max(d).alias(f"hi_{c}"),
                 F.bool_and(d.isNull() | (d == F.floor(d))).alias(f"whole_{c}")]
    seen = df.agg(*aggs).first().asDict()
    out = []
    for f in df.schema.fields:
        if f.name not in cols:
            out.append(F.col(f.name))
            continue
        lo, hi, whole = seen[f"lo_{f.name}"], seen[f"hi_{f.name}"], seen[f"whole_{f.name}"]
        out.append(F.col(f.name).cast(narrow_type(lo, hi, whole)).alias(f.name))
    return df.select(*out)


def narrow_type(lo, hi, whole) -> str:
    if lo is None:
        return "float"
    if whole:
        for name, bits in (("byte", 8), ("short", 16), ("int", 32)):
            if lo >= -(2 ** (bits - 1)) and hi < 2 ** (bits - 1):
                return name
        return "bigint"
    return "float"
