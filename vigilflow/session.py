"""Session set-up and the few helpers that need to look at the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 500_000


def get_session(app: str = "vigilflow", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution; cluster settings win where given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("VIGILFLOW_DRIVER_MEMORY", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on, and keep wide parsing stages within what the JIT compiles."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``, or a scratch folder in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="vigilflow-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, name) if name else root


def cut(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: later reads neither recompute nor drift, and they take
    the columns and row groups they need."""
    spark = df.sparkSession
    path = shared_dir(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop sees it and its file system, for the few places that handle files themselves."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows to learn whether ``df`` may be broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted size allows it; otherwise leave a shuffled join to AQE."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def parallelism(spark: SparkSession) -> int:
    """How many ranges ordered work is cut into; follows the session's shuffle width."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work at least one partition per core; a no-op for inputs that already have more."""
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
