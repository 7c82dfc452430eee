"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# What regular expressions of the contracts take as one word.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: what results depend on, batches for Python that long texts cannot swell, and
    short batches of readers and row groups of writers, as tasks hold whole texts in both."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("parquet.block.size", str(16 << 20))
    return spark


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB statement where there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; lost executors cost no recomputation."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as empty text); remainder 2 is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def hash_share(col: Column, have: int, bound: int, salt: int = 0) -> Column:
    """True for about ``bound`` of ``have`` rows, chosen by the hash of ``col``; for all rows when there are no more."""
    steps = 1 << 40
    limit = steps if have <= bound else int(steps * bound / have)
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(steps)) < F.lit(limit)


def texts(batch: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def release() -> None:
    """Give a worker's freed memory back to the system at the end of a task: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)
