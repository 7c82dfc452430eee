"""Flow readers: benchmark CSV parts, JSON lines, CSV, Zeek conn.log, Suricata EVE.

Every parser is ``DataFrame -> DataFrame``, so the same code serves files, tables and streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as s
from ..operators.splits import stratified_subsample
from ..session import broadcast_if_small, spread

# ------------------------------------------------------------------ fixed values
# Native sensor columns, in order.
NATIVE = ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "ts", "dur", "sbytes", "dbytes", "Spkts", "Dpkts",
          "Sload", "Dload", "smeansz", "dmeansz", "service", "state")

# Positional columns of the header-less benchmark parts.
UNSW_COLUMNS = (
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss",
    "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz",
    "trans_depth", "res_bdy_len", "Sjit", "Djit", "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack",
    "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src",
    "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "attack_cat", "label",
)

# Accepted spellings of each canonical name, in order of preference.
ALIASES = {
    "src_ip": ("src_ip", "srcip", "src", "source_ip", "id.orig_h", "id_orig_h", "sa"),
    "dst_ip": ("dst_ip", "dstip", "dst", "dest_ip", "destination_ip", "id.resp_h", "id_resp_h", "da"),
    "src_port": ("src_port", "sport", "srcport", "id.orig_p", "id_orig_p", "sp"),
    "dst_port": ("dst_port", "dsport", "dstport", "dest_port", "id.resp_p", "id_resp_p", "dp"),
    "proto": ("proto", "protocol"),
    "ts": ("ts", "timestamp", "time", "start"),
    "dur": ("dur", "duration", "flow_duration"),
    "sbytes": ("sbytes", "bytes_toserver", "orig_bytes", "src_bytes"),
    "dbytes": ("dbytes", "bytes_toclient", "resp_bytes", "dst_bytes"),
    "Spkts": ("Spkts", "pkts_toserver", "orig_pkts", "spkts"),
    "Dpkts": ("Dpkts", "pkts_toclient", "resp_pkts", "dpkts"),
    "service": ("service", "app_proto"),
    "state": ("state", "conn_state", "status"),
}

# Sensor vocabulary to benchmark vocabulary.
ZEEK_SERVICE = {
    "http": "http", "dns": "dns", "ftp": "ftp", "ftp_data": "ftp-data", "smtp": "smtp", "ssh": "ssh", "dhcp": "dhcp",
    "radius": "radius", "pop3": "pop3", "snmp": "snmp", "ssl": "-", "tls": "-", "irc": "-", "ntp": "-", "dnp3": "-",
    "krb5": "-",
}
ZEEK_STATE = {
    "SF": "FIN", "S1": "CON", "S2": "FIN", "S3": "FIN", "S0": "REQ", "REJ": "RST", "RSTO": "RST", "RSTR": "RST",
    "RSTOS0": "RST", "RSTRH": "RST", "OTH": "INT", "RES1": "INT", "RES2": "INT",
}
EVE_APP_PROTO = {
    "http": "http", "http2": "http", "dns": "dns", "ftp": "ftp", "ftp-data": "ftp-data", "smtp": "smtp",
    "ssh": "ssh", "dhcp": "dhcp", "radius": "radius", "snmp": "snmp", "tls": "-", "ssl": "-", "teredo": "-",
    "ntp": "-",
}
EVE_STATE = {"established": "CON", "closed": "FIN", "new": "REQ", "broke": "INT", "closed_by_enemy": "RST"}
# ------------------------------------------------------------------

EVE_SCHEMA = """event_type string, timestamp string, src_ip string, src_port string, dest_ip string, dst_ip string,
 dest_port string, dst_port string, proto string, app_proto string, state string, flow_state string,
 flow struct<start:string, `end`:string, bytes_toserver:string, bytes_toclient:string, pkts_toserver:string,
 pkts_toclient:string, state:string, bytes:string, pkts:string>"""


def derive(df: DataFrame) -> DataFrame:
    """Per-direction load and mean packet size from counters, in native column order."""
    dur = F.greatest(F.col("dur"), F.lit(1e-6))

    def pos(c):
        return F.greatest(F.col(c), F.lit(0.0))

    full = df.withColumns({
        "Sload": pos("sbytes") * 8.0 / dur,
        "Dload": pos("dbytes") * 8.0 / dur,
        "smeansz": F.when(pos("Spkts") > 0, pos("sbytes") / F.col("Spkts")),
        "dmeansz": F.when(pos("Dpkts") > 0, pos("dbytes") / F.col("Dpkts")),
    })
    extra = [c for c in df.columns if c not in NATIVE]
    return full.select(*NATIVE, *extra)


def _generic(df: DataFrame, get, keep=()) -> DataFrame:
    raw = s.pinned(df, *keep, *[s.first_alias(get, keys).alias(name) for name, keys in ALIASES.items()])
    raw = raw.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    fixed = raw.select(
        *keep, "src_ip", "dst_ip", s.safe_int("src_port").alias("src_port"), s.safe_int("dst_port").alias("dst_port"),
        F.lower(F.coalesce("proto", F.lit("-"))).alias("proto"), s.iso_epoch("ts").alias("ts"),
        *[s.safe_double(c).alias(c) for c in ("dur", "sbytes", "dbytes", "Spkts", "Dpkts")],
        F.coalesce("service", F.lit("-")).alias("service"), F.coalesce("state", F.lit("UNK")).alias("state"),
    )
    return derive(fixed)


def parse_jsonl(lines: DataFrame, keep=(), fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """JSON objects, one per line in ``value``; lines that are not objects are skipped. ``fields`` are further columns: the key
    and type of each."""
    m = s.pinned(lines, *keep, F.from_json("value", "map<string,string>").alias("_m")).where(F.col("_m").isNotNull())
    # a line that has every value under its first name is asked for no other spelling
    plain = reduce(Column.__and__, [F.nullif(F.col("_m")[keys[0]], F.lit("")).isNotNull() for keys in ALIASES.values()])
    more = [F.col("_m")[key].cast(kind).alias(name) for name, (key, kind) in (fields or {}).items()]
    m = s.pinned(m, *keep, *more, "_m", F.when(~plain, s.lowered_map("_m")).alias("_low"))
    return _generic(m, s.map_lookup("_m", "_low"), (*keep, *(fields or {})))


def parse_csv(rows: DataFrame, keep=()) -> DataFrame:
    """Rows with arbitrary header names; all columns as strings."""
    return _generic(rows, s.column_lookup(rows), keep)


def _zeek_fields(line) -> Column:
    """Column names of a ``#fields`` line."""
    return F.array_compact(F.transform(F.split(line, "\t"), lambda x, i: F.when(i > 0, x)))


def parse_zeek(lines: DataFrame, file_col: str = "file", keep=(), pos_col: str | None = None) -> DataFrame:
    """Tab-separated log lines; a ``#fields`` line names the columns of the lines behind it.

    ``pos_col`` orders the lines of a file (see :func:`text_lines`): a line takes the last header before it, lines
    before the first header are skipped. Only headers that change something are joined back, as intervals of
    positions, broadcast when counted small. Without positions a file must hold one header, which names all its lines.
    """
    head = lines.where(F.col("value").startswith("#fields"))
    body = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    if pos_col is None:
        head = head.groupBy(F.col(file_col).alias("_file")).agg(F.max("value").alias("_h")).select("_file", _zeek_fields("_h").alias("_f"))
        on = F.col(file_col) == F.col("_file")
    else:
        # windows over header lines only
        w = Window.partitionBy("_file").orderBy("_from")
        head = head.select(F.col(file_col).alias("_file"), F.col(pos_col).alias("_from"), _zeek_fields("value").alias("_f"))
        head = head.withColumn("_same", F.lag("_f").over(w).eqNullSafe(F.col("_f"))).where(~F.col("_same"))
        head = head.withColumn("_to", F.lead("_from").over(w)).drop("_same")
        on = (F.col(file_col) == F.col("_file")) & (F.col(pos_col) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(pos_col) < F.col("_to")))
    return _zeek_flows(body.join(broadcast_if_small(head), on), keep)


def parse_zeek_files(files: DataFrame, keep=()) -> DataFrame:
    """Whole log files, one to a row in ``value``, each line under the last header before it. Nothing is joined, so this
    serves streams of small files, whose text must fit in a row; for large ones see :func:`zeek_batches`."""
    lines = files.select(*keep, F.split("value", "\r?\n").alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x.startswith("#fields"), F.struct(i.alias("i"), _zeek_fields(x).alias("f")))),
                     lambda h: h.isNotNull())
    lines = lines.withColumn("_h", heads).select(*keep, "_h", F.posexplode("_l").alias("_i", "value"))
    lines = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    last = F.get(F.reverse(F.filter("_h", lambda h: h["i"] < F.col("_i"))), F.lit(0))["f"]
    return _zeek_flows(lines.withColumn("_f", last).where(F.col("_f").isNotNull()), keep)


def _zeek_flows(body: DataFrame, keep=()) -> DataFrame:
    """Lines in ``value`` with their column names in ``_f``."""
    body = s.pinned(body, *keep, "_f", F.split("value", "\t").alias("_p"))

    def get(name: str) -> Column:
        at = F.array_position("_f", name)
        return F.when(at > 0, F.coalesce(F.get("_p", (at - 1).cast("int")), F.lit("-")))

    names = {"src_ip": "id.orig_h", "dst_ip": "id.resp_h", "src_port": "id.orig_p", "dst_port": "id.resp_p",
             "proto": "proto", "ts": "ts", "dur": "duration", "sbytes": "orig_bytes", "dbytes": "resp_bytes",
             "Spkts": "orig_pkts", "Dpkts": "resp_pkts", "service": "service", "state": "conn_state"}
    raw = s.pinned(body, *keep, *[F.coalesce(get(z), F.lit("-")).alias(n) for n, z in names.items()])
    raw = raw.where(~F.col("src_ip").isin("-", "(empty)"))
    return derive(raw.select(
        *keep, "src_ip", "dst_ip", s.safe_int("src_port").alias("src_port"), s.safe_int("dst_port").alias("dst_port"),
        F.lower("proto").alias("proto"),
        *[s.safe_double(c).alias(c) for c in ("ts", "dur", "sbytes", "dbytes", "Spkts", "Dpkts")],
        s.vocab(s.strip("service"), ZEEK_SERVICE, "-").alias("service"),
        s.vocab(s.strip("state"), ZEEK_STATE, "UNK").alias("state"),
    ))


def parse_eve(lines: DataFrame, keep=()) -> DataFrame:
    """Suricata EVE lines; only ``flow`` and ``netflow`` events carry flow counters."""
    e = s.pinned(lines, *keep, F.from_json("value", EVE_SCHEMA).alias("e")).where(
        F.col("e.event_type").isin("flow", "netflow")
    )

    def text(*names) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names])

    def counter(name: str, netflow: str | None = None) -> Column:
        c = s.safe_double(f"e.flow.{name}")
        if netflow is None:
            return c
        single = F.nullif(s.safe_double(f"e.flow.{netflow}"), F.lit(0.0))
        return F.when(F.col("e.event_type") == "netflow", F.coalesce(single, c)).otherwise(c)

    start, end = s.iso_epoch("e.flow.start"), s.iso_epoch("e.flow.end")
    rec = e.select(
        *keep, text("src_ip").alias("src_ip"), text("dest_ip", "dst_ip").alias("dst_ip"),
        s.safe_int("e.src_port").alias("src_port"), s.safe_int(text("dest_port", "dst_port")).alias("dst_port"),
        F.lower(F.coalesce("e.proto", F.lit("-"))).alias("proto"),
        F.coalesce(F.nullif(start, F.lit(0.0)), s.iso_epoch(text("timestamp", "flow.start"))).alias("ts"),
        F.when(end > 0, F.greatest(F.lit(0.0), end - start)).otherwise(0.0).alias("dur"),
        counter("bytes_toserver", "bytes").alias("sbytes"), counter("bytes_toclient").alias("dbytes"),
        counter("pkts_toserver", "pkts").alias("Spkts"), counter("pkts_toclient").alias("Dpkts"),
        s.vocab(F.lower(s.strip(text("app_proto"))), EVE_APP_PROTO, "-").alias("service"),
        s.vocab(F.lower(s.strip(text("state", "flow_state", "flow.state"))), EVE_STATE, "UNK").alias("state"),
    )
    return derive(rec.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()))


# ------------------------------------------------------------------ file readers
def format_of(path) -> Column:
    """Input format from the file name."""
    p = path if isinstance(path, Column) else F.col(path)
    name = F.lower(F.element_at(F.split(p, "[/\\\\]"), -1))
    return (
        F.when(name.endswith(".jsonl") | name.endswith(".ndjson"), "jsonl")
        .when(name.endswith(".json"), "eve")
        .when(name.endswith(".csv"), "csv")
        .when(name.endswith(".log"), "zeek")
        .otherwise("jsonl")
    )


def detect_format(path: str, hint: str = "auto") -> str:
    """Plan-time twin of :func:`format_of` for a single path."""
    if hint and hint != "auto":
        return hint
    name = path.lower()
    for suffix, fmt in ((".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "eve"), (".csv", "csv"), (".log", "zeek")):
        if name.endswith(suffix):
            return fmt
    return "jsonl"


def text_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file and a position that ascends within it: start of the split, then the order of reading."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("pos"))


def read_flows(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Canonical flows from files of one sensor format."""
    fmt = detect_format(path, fmt)
    if fmt == "csv":
        return parse_csv(spark.read.csv(path, header=True))
    lines = spread(text_lines(spark, path))
    if fmt == "zeek":
        return parse_zeek(lines, pos_col="pos")
    return {"eve": parse_eve, "jsonl": parse_jsonl}[fmt](lines)


def parse_unsw(raw: DataFrame) -> DataFrame:
    """49 string columns to canonical flows; rows without a time are dropped."""
    c = s.clean_strings(raw)
    canonical = {"srcip", "dstip", "sport", "dsport", "proto", "Stime", "attack_cat", "label"}
    text = {"state", "service", "ct_ftp_cmd"}  # blank-bearing or nominal in the published files
    rest = [n for n in UNSW_COLUMNS if n not in canonical]
    out = c.select(
        F.col("srcip").alias("src_ip"), F.col("dstip").alias("dst_ip"), s.number("sport").alias("src_port"),
        s.number("dsport").alias("dst_port"), F.coalesce("proto", F.lit("unk")).alias("proto"),
        s.number("Stime").alias("ts"), F.coalesce(s.number("label"), F.lit(0)).cast("byte").alias("label"),
        F.coalesce(F.nullif("attack_cat", F.lit("")), F.lit("Normal")).alias("attack_cat"),
        *[F.col(n) if n in text else s.number(n).alias(n) for n in rest],
    )
    return out.where(F.col("ts").isNotNull())


def read_unsw(spark: SparkSession, directory: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in UNSW_COLUMNS])
    raw = spark.read.schema(schema).csv(f"{directory}/UNSW-NB15_[1-4].csv", encoding="ISO-8859-1")
    return parse_unsw(raw)


CIC_RENAME = {"Source IP": "src_ip", "Destination IP": "dst_ip", "Source Port": "src_port",
              "Destination Port": "dst_port", "Protocol": "proto", "Timestamp": "ts", "Label": "attack_cat"}


def cic_label(cat: Column) -> Column:
    return (F.coalesce(cat, F.lit("BENIGN")) != "BENIGN").cast("byte")


def parse_cic(raw: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Header-named flow export to canonical flows plus its numeric columns.

    ``numeric`` lists the extra columns to keep; when left out, one aggregate pass keeps those whose
    every value is a number.
    """
    c = s.clean_strings(raw)
    c = c.toDF(*[CIC_RENAME.get(n, n) for n in c.columns])
    rest = [n for n in c.columns if n not in {*CIC_RENAME.values(), "Flow ID"}]
    if numeric is None:
        bad = c.agg(*[F.count_if((F.col(f"`{n}`") != "") & F.col(f"`{n}`").try_cast("double").isNull()).alias(str(i))
                      for i, n in enumerate(rest)]).first() if rest else []
        numeric = [n for i, n in enumerate(rest) if bad[i] == 0]
    label = cic_label(F.col("attack_cat"))
    out = c.select(
        "src_ip", "dst_ip", s.number("src_port").alias("src_port"), s.number("dst_port").alias("dst_port"),
        s.number("proto").cast("long").cast("string").alias("proto"), s.epoch(s.flow_time("ts")).alias("ts"),
        label.alias("label"), F.when(label == 0, "Normal").otherwise(s.strip("attack_cat")).alias("attack_cat"),
        *[s.number(f"`{n}`").alias(n) for n in numeric],
    )
    return out.where(F.col("ts").isNotNull())


def read_cic(spark: SparkSession, paths) -> DataFrame:
    """Each path keeps its own header; columns are matched by name."""
    parts = [s.clean_strings(spark.read.csv(p, header=True, encoding="ISO-8859-1"))
             for p in ([paths] if isinstance(paths, str) else paths)]
    return parse_cic(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


LOADERS = {"unsw_nb15": read_unsw, "cicids2017": read_cic}


def load_dataset(spark: SparkSession, name: str, where, max_rows: int = 0, seed: int = 42) -> DataFrame:
    """Registered benchmark loader, optional stratified cap, ``dataset`` literal."""
    if name not in LOADERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(LOADERS)}")
    return finish_dataset(LOADERS[name](spark, where), name, max_rows, seed)


def finish_dataset(df: DataFrame, name: str, max_rows: int = 0, seed: int = 42) -> DataFrame:
    if max_rows > 0:
        key = F.concat_ws("|", "src_ip", "dst_ip", "src_port", "dst_port", "ts")
        df = stratified_subsample(df, max_rows, seed, key)
    return df.withColumn("dataset", F.lit(name))


def sighting_frame(flows: DataFrame) -> DataFrame:
    """The four columns feed visibility needs; never subsampled, pruned at the scan."""
    return flows.select("src_ip", "dst_ip", "ts", F.col("label").cast("byte").alias("label")).where(
        F.col("ts").isNotNull()
    )


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the table at ``path``; write it with ``build()`` first when it is not there yet."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def zeek_line_stream(spark: SparkSession, directory: str, max_files: int = 64) -> DataFrame:
    """Log lines of a folder that files are moved into, with their file and the start of their split."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(directory).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def zeek_batches(on_batch):
    """``foreachBatch`` function that hands the flows of a :func:`zeek_line_stream` to ``on_batch``. A file comes in one
    micro-batch, so a line finds its header there; files are read in splits, whatever their size."""

    def parse(lines: DataFrame, batch_id: int) -> None:
        pos = F.struct("start", F.monotonically_increasing_id().alias("line")).alias("pos")
        on_batch(parse_zeek(lines.select("value", "file", pos), pos_col="pos"), batch_id)

    return parse


def read_stream(spark: SparkSession, directory: str, fmt: str, max_files: int = 64) -> DataFrame:
    """Continuous flow source over a folder that files are moved into. Zeek logs come whole here, see :func:`zeek_batches`."""
    src = spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        names = sorted({a for keys in ALIASES.values() for a in keys if "." not in a}, key=str.lower)
        unique = {n.lower(): n for n in names}
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique.values()])
        return parse_csv(src.schema(schema).option("header", True).option("enforceSchema", False).csv(directory))
    if fmt == "zeek":
        return parse_zeek_files(src.text(directory, wholetext=True))
    lines = src.text(directory)
    return {"eve": parse_eve, "jsonl": parse_jsonl}[fmt](lines)
