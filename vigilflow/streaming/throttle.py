"""Keyed throttling with timers: the first row of a key passes, others within the period do not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_times(rows: pd.DataFrame) -> pd.DataFrame:
    """In the order of ``ts``, the first row of each by the other columns: no other row of a time can pass."""
    n = rows["ts"].to_numpy(float, na_value=np.nan)
    order = np.argsort(n, kind="stable")
    new = np.r_[True, n[order][1:] != n[order][:-1]] if len(n) else np.zeros(0, bool)  # rows without a time, last, stay each
    if new.all():
        return rows.iloc[order]
    # only times that several rows have are put in order by the other columns
    more = np.append(~new[1:], False)
    at, many = np.cumsum(new) - 1, np.zeros(new.sum(), bool)
    many[at[more]] = True
    tied = rows.iloc[order[many[at]]].sort_values([c for c in ("ts", *rows.columns)], kind="stable").drop_duplicates("ts")
    return pd.concat([rows.iloc[order[new & ~many[at]]], tied]).sort_values("ts", kind="stable")


def passing(ts: np.ndarray, last: float | None, period_s: float) -> list[int]:
    """Places in the ordered ``ts`` that pass: those more than the period after the one before. Steps from one to the next
    by bisection, so that the work grows with what passes."""
    out, at = [], 0
    while at < len(ts):
        if last is not None:
            lo, hi = at, len(ts)
            while lo < hi:  # the difference itself is compared, as rounding of the sum could decide otherwise
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if ts[mid] - last > period_s or ts[mid] != ts[mid] else (mid + 1, hi)
            at = lo
            if at == len(ts) or ts[at] != ts[at]:
                break
        out.append(at)
        last, at = ts[at], at + 1
    return out


class LeadingEdge(StatefulProcessor):
    """State of a key: the time of its last row that passed, kept until a timer of the period finds the watermark beyond
    it. Rows pass that come more than ``period_s`` after it; a key may return any number of times."""

    def __init__(self, key: str, period_s: float):
        self.key, self.period_s = key, period_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ts", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([first_of_times(b.drop(columns="event_time")) for b in rows], ignore_index=True)
        batch = first_of_times(batch)
        last = self.last.get()[0] if self.last.exists() else None
        passed = passing(batch["ts"].to_numpy(float, na_value=np.nan), last, self.period_s)
        if passed:
            last = batch["ts"].iloc[passed[-1]]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((float(last),))
            self.handle.registerTimer(int((last + self.period_s) * 1000))
        yield batch.iloc[passed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle(stream: DataFrame, key: str, period_s: float = 30.0, delay: str = "1 minute") -> DataFrame:
    """Rows of ``stream`` (with ``ts``, epoch seconds) that pass. Rows later than ``delay`` are dropped by the watermark; rows
    of one micro-batch are taken in the order of time, so out-of-order input within a batch gives the same result."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = stream.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(LeadingEdge(key, period_s), stream.schema, "append", "eventtime")
