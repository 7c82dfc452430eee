"""Alert and result sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

Sink = Callable[[DataFrame, int], None]


def alert_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def json_sink(path: str) -> Sink:
    """JSON lines under ``day=/batch=``; a batch written twice replaces itself."""

    def emit(df: DataFrame, batch_id: int) -> None:
        day = F.to_date(F.timestamp_seconds(F.col("flow.ts")))
        out = df.withColumn("day", day).withColumn("batch", F.lit(int(batch_id)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)

    return emit


def expired_days(alerts: DataFrame, keep: int) -> DataFrame:
    """Days beyond the newest ``keep`` ones: what retention removes next."""
    days = alerts.select("day").distinct()
    return days.join(days.orderBy(F.col("day").desc()).limit(keep), "day", "left_anti")


def delete_expired(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete the ``day=`` folders of a JSON sink beyond the newest ``keep``; returns their days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted((s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=")), reverse=True)
    for d in days[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, d), True)
    return [d[len("day="):] for d in days[keep:]]


def retained(alerts: DataFrame, keep: int) -> DataFrame:
    """Alerts of the newest ``keep`` days."""
    newest = alerts.select("day").distinct().orderBy(F.col("day").desc()).limit(keep)
    return alerts.join(F.broadcast(newest), "day", "left_semi")


def read_alerts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def fan_out(sinks: dict[str, Sink]) -> Sink:
    """Emit to every sink; one that fails is counted and never stops the rest. When none takes the batch, the last
    failure is raised, so that the batch is not taken for done.

    The returned function carries ``errors``, a dict of counts by sink name.
    """
    errors = dict.fromkeys(sinks, 0)

    def emit(df: DataFrame, batch_id: int) -> None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        taken, last = 0, None
        try:
            for name, sink in sinks.items():
                try:
                    sink(kept, batch_id)
                    taken += 1
                except Exception as exc:  # noqa: BLE001 - a sink must not stop scoring
                    errors[name] += 1
                    last = exc
            if last is not None and not taken:
                raise last
        finally:
            kept.unpersist()

    emit.errors = errors
    return emit


def syslog_line(payload: Column, at: Column, tag: str = "alert-score", priority: int = 134, most: int = 8000) -> Column:
    """``<pri>time tag: json`` with the payload cut to ``most`` characters, as receivers of the wire format ask."""
    return F.concat(F.lit(f"<{priority}>"), F.date_format(at, "MMM dd HH:mm:ss"), F.lit(f" {tag}: "),
                    F.substring(payload, 1, most))


def write_tables(tables: dict[str, DataFrame], path: str, formats: Iterable[str] = ("json", "csv")) -> None:
    """Small result tables, each in every format."""
    for name, df in tables.items():
        for fmt in formats:
            df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}.{fmt}")
