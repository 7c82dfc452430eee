"""The throttle against a plain walk over the rows, and what stays in its state."""

import json
import os
import random

import numpy as np
import pandas as pd

from vigilflow.streaming import scoring as st
from vigilflow.streaming import throttle as th


def walk(rows, period):
    last, out = {}, []
    for ts, key, i in sorted(rows):
        if key not in last or ts - last[key] > period:
            out.append((key, ts, i))
            last[key] = ts
    return sorted(out)


def test_keys_return_and_state_is_evicted(spark, tmp_path):
    rnd = random.Random(3)
    slots = [[(float(b * 1000 + rnd.randrange(0, 9000) / 10), f"k{rnd.randrange(4)}", b * 100 + i) for i in range(60)] for b in range(4)]
    slots[3].append((3995.0, "end", 999))
    inbox = tmp_path / "in"
    inbox.mkdir()
    for b, rows in enumerate(slots):  # within a file in no order
        (inbox / f"{b}.json").write_text("\n".join(json.dumps({"ts": t, "k": k, "i": i}) for t, k, i in rows))
        os.utime(inbox / f"{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    s = spark.readStream.schema("ts double, k string, i long").option("maxFilesPerTrigger", 1).json(str(inbox))
    out = str(tmp_path / "out")
    st.replay(th.throttle(s, "k", 30.0, "10 seconds"), st.upsert_table(out), str(tmp_path / "cp"))
    got = sorted((r.k, r.ts, r.i) for r in spark.read.parquet(out).collect())
    assert got == walk([x for rows in slots for x in rows], 30.0)
    assert len(got) > 4 * 4  # keys came back


def test_timers_clear_keys_that_stay_away(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for b in range(6):
        (inbox / f"{b}.json").write_text("\n".join(json.dumps({"ts": 5000.0 + 1000.0 * b + i, "k": f"{b}-{i}", "i": i}) for i in range(5)))
        os.utime(inbox / f"{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    s = spark.readStream.schema("ts double, k string, i long").option("maxFilesPerTrigger", 1).json(str(inbox))
    q = st.run(th.throttle(s, "k", 30.0, "10 seconds"), st.upsert_table(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination()
    totals = [op["numRowsTotal"] for p in q.recentProgress for op in (json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p)["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    assert max(totals) <= 2 * max(totals[:1]), totals  # a slot's keys and timers go when the next one has passed


def test_steps_equal_a_walk_over_the_rows():
    rnd = random.Random(9)
    for last in (None, -3.0, 2.5):
        for period in (0.0, 0.3, 7.0):
            ts = sorted(round(rnd.random() * 60, 1) for _ in range(300)) + [float("nan")]
            want, at = [], last
            for i, t in enumerate(ts):
                if at is None or t - at > period:
                    want.append(i)
                    at = t
            assert th.passing(np.array(ts), last, period) == want
    assert th.passing(np.array([float("nan")]), None, 1.0) == [0] and th.passing(np.zeros(0), None, 1.0) == []


class _Counted(float):
    """A time that counts how often it is compared by difference."""
    seen = 0

    def __sub__(self, other):
        _Counted.seen += 1
        return float(self) - other


def test_the_walk_steps_over_rows_that_cannot_pass():
    assert len(th.passing([_Counted(i / 100) for i in range(20_000)], None, 50.0)) == 4
    assert _Counted.seen < 100  # not one for each row


def test_one_row_of_a_time_is_kept():
    rows = pd.DataFrame({"ts": [3.0, 1.0, 3.0, None, 1.0, 2.0, 3.0], "k": ["c", "b", "a", "z", "a", None, "b"], "i": range(7)})
    got = th.first_of_times(rows)
    assert got["i"].tolist() == [4, 5, 2, 3]
    assert th.first_of_times(rows[:0]).empty
