"""Indicator feed parsers over landed text, and feed snapshots.

A parser takes lines (``value`` plus optional ``line_no``) and yields normalised indicator records
with ``source``. Transport is left to whatever lands the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.ioc import COLUMNS, normalise
from ..operators.ranks import ranked
from ..session import file_system, shared_dir

# ------------------------------------------------------------------ fixed values
THREATFOX_CONFIDENCE = {"low": 0.3, "medium": 0.6, "high": 0.9}

# source: base confidence, tag, records that the publisher expects at most (parsing keeps all)
PLAIN_LISTS = {
    "blocklist": (0.70, "fail2ban-aggregated attacker IPs", 60_000),
    "ipsum": (0.55, "aggregated multi-list malicious IPs (count = sightings)", 120_000),
    "emerging": (0.80, "Emerging Threats compromised hosts", 60_000),
    "cins": (0.75, "CINS Army hostile sources", 60_000),
    "binarydefense": (0.75, "BinaryDefense BAN sensor IPs", 30_000),
    "openphish": (0.75, "OpenPhish phishing URLs", 30_000),
    "certpl": (0.80, "CERT.PL malicious domains", 60_000),
}
FEODO_LINE = (r"(?i)^\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-f:.]+/[0-9]+|([a-z0-9-]+\.)+[a-z]{2,})"
              r"\s*(?:#\s*(.*))?$")
# ------------------------------------------------------------------

_END = "\x01"


def data_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Drop blank lines and ``#`` comments."""
    t = s.strip(column)
    return lines.where((t != "") & ~t.startswith("#"))


def csv_fields(lines: DataFrame, n: int) -> DataFrame:
    """First ``n`` CSV fields of each line as ``c0 .. c<n-1>``; shorter rows are dropped, blanks are ''."""
    schema = ", ".join(f"c{i} string" for i in range(n + 1))
    opts = {"quote": '"', "escape": '"'}
    # a mark after the last field shows where a short row ends
    marked = F.concat(F.col("value"), F.lit(f",{_END}"))
    rest = [c for c in lines.columns if c != "value"]
    p = s.pinned(data_lines(lines), *rest, F.from_csv(marked, F.lit(schema), opts).alias("_r"))
    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_r.c{i}") != _END, F.lit(True)) for i in range(n)])
    return p.where(F.col("_r").isNotNull() & full).select(
        *rest, *[F.coalesce(F.col(f"_r.c{i}"), F.lit("")).alias(f"c{i}") for i in range(n)]
    )


def _join_tags(*cols) -> Column:
    return F.concat_ws(",", *[F.nullif(s.strip(c), F.lit("")) for c in cols])


def _records(df: DataFrame, source, keep=()) -> DataFrame:
    src = source if isinstance(source, Column) else F.lit(source)
    named = df.withColumn("source", src)
    if "sightings" not in named.columns:
        named = named.withColumn("sightings", F.lit(1))
    return normalise(named).select(*COLUMNS, *keep)


def _keep(lines: DataFrame):
    return [c for c in ("line_no", "polled_at") if c in lines.columns]


def parse_urlhaus(lines: DataFrame, now=None) -> DataFrame:
    """Two records per row: the host, typed by its spelling, and the URL."""
    keep = _keep(lines)
    r = csv_fields(lines, 9)
    first = F.coalesce(s.feed_epoch("c1"), F.lit(0.0))
    two = F.array(
        F.struct(F.col("c8").alias("value"), F.lit(None).cast("string").alias("ioc_type")),
        F.struct(F.col("c2").alias("value"), F.lit("url").alias("ioc_type")),
    )
    rec = r.select(
        *keep, F.explode(two).alias("r"), first.alias("first_seen"),
        F.coalesce(F.nullif(s.feed_epoch("c4"), F.lit(0.0)), first).alias("last_seen"),
        F.when(F.lower("c3") == "online", 0.75).otherwise(0.5).alias("confidence"), _join_tags("c5", "c6").alias("tags"),
    ).select("*", "r.*").drop("r")
    # a forced type accepts any text, an empty one included
    return _records(rec, "urlhaus", keep)


def parse_threatfox(lines: DataFrame, now=None) -> DataFrame:
    keep = _keep(lines)
    r = csv_fields(lines, 10)
    first = F.coalesce(s.feed_epoch("c0"), F.lit(0.0))
    conf = F.create_map(*[F.lit(x) for kv in THREATFOX_CONFIDENCE.items() for x in kv])
    rec = r.select(
        *keep, s.strip_port("c2").alias("value"), first.alias("first_seen"),
        F.coalesce(F.nullif(s.feed_epoch("c1"), F.lit(0.0)), first).alias("last_seen"),
        F.coalesce(conf[F.lower(s.strip("c9"))], F.lit(0.5)).alias("confidence"), _join_tags("c4", "c6").alias("tags"),
    )
    return _records(rec, "threatfox", keep)


def _polled(lines: DataFrame, now) -> Column:
    return F.col("polled_at").cast("double") if "polled_at" in lines.columns else F.lit(float(now or 0.0))


def parse_feodo(lines: DataFrame, now=None, tag: str = "feodo-ip") -> DataFrame:
    """Address or domain per line, comment tail as tag; networks are skipped. The list of generated domains has a tag
    of its own (:func:`parse_feodo_domains`)."""
    keep, at = _keep(lines), _polled(lines, now)
    body = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(FEODO_LINE))
    rec = body.select(
        *keep, F.regexp_extract("value", FEODO_LINE, 1).alias("value"), at.alias("first_seen"),
        at.alias("last_seen"), F.lit(0.8).alias("confidence"),
        F.coalesce(F.nullif(s.strip(F.regexp_extract("value", FEODO_LINE, 3)), F.lit("")), F.lit(tag)).alias("tags"),
    )
    return _records(rec.where(~F.col("value").contains("/")), "feodo", keep)


def parse_feodo_domains(lines: DataFrame, now=None) -> DataFrame:
    return parse_feodo(lines, now, "feodo-dga")


def parse_plain(lines: DataFrame, source=None, now=None, settings=PLAIN_LISTS) -> DataFrame:
    """One indicator per line, every line kept. ``source`` is a name, or a column holding one; a ``line_no`` is kept."""
    src = source if isinstance(source, Column) else F.lit(source)
    at = _polled(lines, now)

    def setting(i: int) -> Column:
        return F.create_map(*[F.lit(x) for k, v in settings.items() for x in (k, v[i])])[F.col("source")]

    extra = [c for c in ("line_no",) if c in lines.columns]
    t = s.pinned(data_lines(lines), *extra, src.alias("source"), s.first_token("value").alias("t"), at.alias("at"))
    listed = F.regexp_extract("t.tail", r"^(\d+)(?:\s|$)", 1)
    times = F.when((F.col("source") == "ipsum") & (listed != ""), F.greatest(F.lit(1), listed.try_cast("int")))
    rec = t.select(
        *extra, "source", F.col("t.value").alias("value"), F.col("at").alias("first_seen"),
        F.col("at").alias("last_seen"),
        F.when(times.isNotNull(), F.least(F.lit(0.95), setting(0) + 0.05 * F.least(times, F.lit(8))))
        .otherwise(setting(0)).alias("confidence"),
        setting(1).alias("tags"), F.coalesce(times, F.lit(1)).alias("sightings"),
    )
    return normalise(rec).select(*COLUMNS, *extra)


def record_numbers(records: DataFrame, slot_lines: int = 65_536) -> DataFrame:
    """``record_no`` of each accepted record of a source in line order, for callers that take a list's first records.

    The count runs slot by slot, so one huge list is not ranked by one task.
    """
    slotted = records.withColumn("_slot", F.floor(F.col("line_no") / slot_lines))
    return ranked(slotted, ["source"], "_slot", [F.col("line_no")], "record_no").drop("_slot")


OTX_SCHEMA = """struct<results:array<struct<created:string, modified:string, confidence:string, tags:array<string>,
 indicators:array<struct<indicator:string, type:string>>>>>"""


def parse_otx(docs: DataFrame, now=None) -> DataFrame:
    """Pulse pages as JSON documents; every indicator of every pulse with all its tags."""
    p = docs.select(F.explode(F.from_json("value", OTX_SCHEMA)["results"]).alias("p"))
    created = F.coalesce(s.feed_epoch("p.created"), F.lit(0.0))
    conf = F.coalesce(F.nullif(s.number("p.confidence"), F.lit(0.0)), F.lit(0.5)) / 100.0
    rec = p.select(
        created.alias("first_seen"),
        F.coalesce(F.nullif(s.feed_epoch("p.modified"), F.lit(0.0)), created).alias("last_seen"),
        F.when(conf <= 0, 0.5).otherwise(conf).alias("confidence"),
        F.array_join(F.coalesce("p.tags", F.array().cast("array<string>")), ",").alias("tags"),
        F.explode("p.indicators.indicator").alias("value"),
    )
    return _records(rec, "otx")


MISP_SCHEMA = """struct<response:struct<Attribute:array<struct<value:string, type:string, timestamp:string,
 to_ids:boolean, comment:string>>>>"""


def parse_misp(docs: DataFrame, now=None) -> DataFrame:
    a = docs.select(F.explode(F.from_json("value", MISP_SCHEMA)["response"]["Attribute"]).alias("a"))
    at = F.coalesce(F.nullif(s.number("a.timestamp"), F.lit(0.0)), s.feed_epoch("a.timestamp"), F.lit(0.0))
    rec = a.select(
        s.strip_piped_port("a.value", "a.type").alias("value"), at.alias("first_seen"), at.alias("last_seen"),
        F.when(F.coalesce("a.to_ids", F.lit(False)), 0.8).otherwise(0.5).alias("confidence"),
        F.coalesce(F.nullif("a.comment", F.lit("")), "a.type", F.lit("")).alias("tags"),
    )
    return _records(rec, "misp")


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "urlhaus": parse_urlhaus, "threatfox": parse_threatfox, "feodo": parse_feodo, "feodo-dga": parse_feodo_domains, "otx": parse_otx,
    "misp": parse_misp,
    **{name: (lambda lines, now=None, _n=name: parse_plain(lines, _n, now)) for name in PLAIN_LISTS},
}


def parse_all(landed: dict[str, DataFrame], now=None) -> DataFrame:
    """Union of the records of several feeds, by registered name."""
    parts = [PARSERS[name](lines, now=now).select(*COLUMNS) for name, lines in landed.items()]
    return reduce(DataFrame.unionByName, parts)


def poll_report(polls: DataFrame) -> DataFrame:
    """Per-source outcome with an overall row; wants ``source, ok, n_records, seconds``."""
    return polls.rollup("source").agg(
        F.count(F.lit(1)).alias("polls"), F.count_if("ok").alias("ok"), F.sum("n_records").alias("n_records"),
        F.sum("seconds").alias("seconds"),
    ).withColumn("source", F.coalesce("source", F.lit("*")))


# ------------------------------------------------------------------ snapshots
def _names(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """(folder, name) of what matches."""
    at, fs = file_system(spark, pattern)
    found = [x.getPath() for x in fs.globStatus(at) or []]
    return [(x.getParent().getName(), x.getName()) for x in found]


def write_snapshot(records: DataFrame, path: str, poll_ts: int) -> None:
    """Keep one poll, a folder per source and poll time; a poll that comes again replaces its rows.

    Once the rows are there, the source's pointer names the poll, if it is not older than the one named before. A crash
    in between leaves readers with the poll before; one writer at a time polls a source.
    """
    spark, poll = records.sparkSession, int(poll_ts)
    out = records.withColumn("poll_ts", F.lit(poll).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "poll_ts").parquet(path)
    _, fs = file_system(spark, path)
    at = lambda *parts: file_system(spark, "/".join((path, "_newest", *parts)))[0]
    held = _names(spark, f"{path}/_newest/source=*/*")
    for source in {s for s, _ in _names(spark, f"{path}/source=*/poll_ts={poll}")}:
        before = [name for s, name in held if s == source]
        if all(int(name.split("-")[0]) <= poll for name in before):
            fs.create(at(source, f"{poll}-{uuid.uuid4().hex}")).close()
            for name in before:
                fs.delete(at(source, name), False)


def newest_polls(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Each source folder's newest poll and a mark that changes when it is written again, from the pointers alone. Only a
    source that has none, as other writers leave it, has its polls listed."""
    newest: dict[str, tuple[int, str]] = {}
    for source, name in _names(spark, f"{path}/_newest/source=*/*"):
        poll, mark = name.split("-")
        newest[source] = max(newest.get(source, (int(poll), mark)), (int(poll), mark))
    for source in {name for _, name in _names(spark, f"{path}/source=*")} - newest.keys():
        polls = [int(name.split("=")[1]) for _, name in _names(spark, f"{path}/{source}/poll_ts=*")]
        if polls:
            newest[source] = (max(polls), "")
    return newest


def read_newest(spark: SparkSession, path: str, polls: dict[str, tuple[int, str]]) -> DataFrame:
    """Rows of the polls that :func:`newest_polls` names; older ones are neither listed nor read."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/{s}/poll_ts={poll}" for s, (poll, _) in sorted(polls.items())])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of each source's newest non-empty poll."""
    newest = snapshots.groupBy("source").agg(F.max("poll_ts").alias("poll_ts"))  # one row per source
    return snapshots.join(F.broadcast(newest), ["source", "poll_ts"], "left_semi")


def parse_snapshot_csv(rows: DataFrame) -> DataFrame:
    """CSV snapshot rows with their ``file``; the source is the file name up to its last underscore."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.csv$", "")
    r = rows.select(
        "value", "ioc_type", F.regexp_replace(stem, r"_[^_]*$", "").alias("source"),
        F.coalesce("provenance", F.lit("live")).alias("provenance"), s.number("first_seen").alias("first_seen"),
        s.number("last_seen").alias("last_seen"), s.number("confidence").alias("confidence"),
        F.coalesce("tags", F.lit("")).alias("tags"),
        F.coalesce(F.nullif("sightings", F.lit("")), F.lit("1")).try_cast("int").alias("sightings"),
    )
    return r.dropna(subset=["first_seen", "last_seen", "confidence", "sightings"])


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True).select("*", F.col("_metadata.file_path").alias("file"))
    return parse_snapshot_csv(rows)


def snapshot_dir(spark: SparkSession) -> str:
    return shared_dir(spark, "feed_snapshots")
