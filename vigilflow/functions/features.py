"""Feature derivations and train/serve-consistent designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cti import FEATURES as CTI
from .scalars import finite, number, proto_family

# Columns that never become features (fixed values).
NOT_FEATURES = ("src_ip", "dst_ip", "src_port", "dst_port", "ts", "label", "attack_cat", "dataset")
LIVE_NUMERIC = ("dur", "sbytes", "dbytes", "Spkts", "Dpkts", "Sload", "Dload", "smeansz", "dmeansz")
LIVE_CATEGORICAL = ("proto", "service", "state")
RATES = ("byte_rate", "pkt_rate", "mean_pkt_size", "fwd_bwd_ratio")
BRIDGE = ("duration_s", "total_pkts", "total_bytes", "byte_rate", "pkt_rate", "iat_mean", "mean_pkt_size",
          "fwd_bwd_ratio")
PROTOCOLS = ("tcp", "udp", "icmp", "other")


def _pos(c: str) -> Column:
    return F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0))


def add_rates(df: DataFrame) -> DataFrame:
    """Byte and packet rates, mean packet size, direction ratio, with floors against division by zero."""
    dur = F.greatest(_pos("dur"), F.lit(1e-6))
    total_b, total_p = _pos("sbytes") + _pos("dbytes"), _pos("Spkts") + _pos("Dpkts")
    return df.withColumns({
        "byte_rate": total_b / dur,
        "pkt_rate": total_p / dur,
        "mean_pkt_size": total_b / F.greatest(total_p, F.lit(1.0)),
        "fwd_bwd_ratio": _pos("Spkts") / F.greatest(_pos("Dpkts"), F.lit(1.0)),
    })


BRIDGE_SOURCES = {
    # duration, forward/backward packets, forward/backward bytes, inter-arrival parts, seconds per time unit
    "unsw_nb15": ("dur", "Spkts", "Dpkts", "sbytes", "dbytes", ("Sintpkt", "Dintpkt"), 1.0, 1.0),
    "cicids2017": ("Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
                   "Total Length of Bwd Packets", ("Flow IAT Mean",), 1e-6, 1e-6),
}


def bridge(df: DataFrame, dataset: str, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Dataset-native columns to the shared design: eight ``log1p`` quantities, protocol flags, indicator features."""
    dur_c, fp_c, bp_c, fb_c, bb_c, iat_c, unit, iat_unit = BRIDGE_SOURCES[dataset]

    def n(c):
        return F.coalesce(number(f"`{c}`"), F.lit(0.0))

    dur = n(dur_c) * unit if unit != 1.0 else n(dur_c)
    iat = sum((n(c) for c in iat_c[1:]), n(iat_c[0])) / float(len(iat_c))
    iat = iat * iat_unit if iat_unit != 1.0 else iat
    pkts, size = n(fp_c) + n(bp_c), n(fb_c) + n(bb_c)
    safe = F.greatest(dur, F.lit(1e-6))
    raw = {
        "duration_s": dur, "total_pkts": pkts, "total_bytes": size, "byte_rate": size / safe,
        "pkt_rate": pkts / safe, "iat_mean": iat, "mean_pkt_size": size / F.greatest(pkts, F.lit(1.0)),
        "fwd_bwd_ratio": n(fp_c) / F.greatest(n(bp_c), F.lit(1.0)),
    }
    family = proto_family("proto")
    cti = [finite(c).alias(c) for c in CTI if c in df.columns]
    return df.select(
        *keep, *[finite(F.log1p(F.greatest(raw[c], F.lit(0.0)))).alias(f"log_{c}") for c in BRIDGE],
        *[(family == p).cast("double").alias(f"proto_{p}") for p in PROTOCOLS], *cti,
    )


# ------------------------------------------------------------------ vocabulary
def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, value, n) over all categorical columns in one pass; counts combine map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.col", "p.value").agg(F.count(F.lit(1)).alias("n"))


def build_vocabulary(df: DataFrame, cols: Sequence[str], rate: float = 0.001, floor: int = 50) -> DataFrame:
    """Values frequent enough to keep: at least ``max(rate * rows, floor)`` occurrences."""
    counts = category_counts(df, cols)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("n") >= F.greatest(rows * F.lit(rate), F.lit(float(floor)))).select("col", "value", "n")


def freeze(vocabulary: DataFrame) -> dict[str, list[str]]:
    """The vocabulary as plain lists. With ``rate`` > 0 a column keeps at most 1/rate values."""
    out: dict[str, list[str]] = {}
    for r in vocabulary.where(F.col("value").isNotNull()).orderBy("col", "value").collect():
        out.setdefault(r["col"], []).append(r["value"])
    return out


def pooled(c: str, keep: Sequence[str]) -> Column:
    """Kept value, ``UNK`` for a missing one, ``OTHER`` for the rest; the same in training and serving."""
    v = F.col(c).cast("string")
    return F.when(v.isNull(), "UNK").when(v.isin(*keep) if keep else F.lit(False), v).otherwise("OTHER")


def one_hot(c: str, keep: Sequence[str]) -> list[Column]:
    """0/1 columns ``<c>_<value>`` from a frozen list, so names never depend on the batch."""
    p = pooled(c, keep)
    return [(p == val).cast("double").alias(f"{c}_{val}") for val in [*keep, "OTHER", "UNK"]]


def split_types(df: DataFrame, include_cti: bool = True, drop: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by schema type."""
    skip = {*NOT_FEATURES, *drop} | (set() if include_cti else set(CTI))
    num = [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    cat = [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]
    return num, cat


def design_columns(numeric: Sequence[str], vocabulary: dict[str, list[str]]) -> list[Column]:
    cols = [finite(f"`{c}`").alias(c) for c in numeric]
    for c, keep in vocabulary.items():
        cols += one_hot(c, keep)
    return cols


def design(df: DataFrame, numeric: Sequence[str], vocabulary: dict[str, list[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features made finite plus one-hot columns."""
    return df.select(*keep, *design_columns(numeric, vocabulary))


def design_names(numeric: Sequence[str], vocabulary: dict[str, list[str]]) -> list[str]:
    return [*numeric, *[f"{c}_{val}" for c, keep in vocabulary.items() for val in [*keep, "OTHER", "UNK"]]]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the trained features, in order: missing ones are 0, others are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[
        (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
        for c in features])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector with slot names in its metadata."""
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df).select(*keep, out)


def ablation_groups(features: Sequence[str]) -> dict[str, list[str]]:
    """Named feature lists of the ablation; ``live_feeds_only`` is the traffic-only control."""
    traffic = [f for f in features if f not in CTI]
    return {
        "traffic_only": traffic,
        "traffic_cti": list(features),
        "traffic_cti_no_match": [f for f in features if f not in ("ioc_src_match", "ioc_dst_match")],
        "live_feeds_only": traffic,
    }
