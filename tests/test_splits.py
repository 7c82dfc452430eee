"""Splits by borders of the hash order: exact sizes, and the same split for other columns."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from vigilflow.operators import splits


def plain(rows, seed=42):
    """label -> number of rows of each split, and the split of each key, by sorting."""
    out = {}
    for label in {r[1] for r in rows if r[1] is not None}:
        own = sorted((hashlib.md5(f"{seed}:{k}".encode() if k is not None else str(seed).encode()).hexdigest(), str(k)) for k, x in rows if x == label)
        a = round(len(own) * 0.2)
        out[label] = [(k, "test" if i < a else "val" if i < 2 * a else "train") for i, (_, k) in enumerate(own)]
    return out


def test_split_equals_sorting(spark):
    rows = [(i, i % 3 % 2 if i % 11 else None) for i in range(700)]
    got = splits.train_val_test(spark.createDataFrame(rows, "id long, label int"), "id").collect()
    want = {k: s for own in plain(rows).values() for k, s in own}
    assert {str(r["id"]): r["split"] for r in got} == want


def test_split_of_repeated_and_missing_keys_keeps_exact_sizes(spark):
    rows = [(None, 0)] * 60 + [(7, 1)] * 50 + [(i % 5, i % 2) for i in range(40)] + [(1, 2)]
    got = splits.train_val_test(spark.createDataFrame(rows, "id long, label int"), "id").collect()
    assert Counter((r["label"], r["split"]) for r in got) == Counter(
        (label, s) for label, own in plain(rows).items() for _, s in own)


def test_split_alike_equals_the_join(spark):
    rows = [(i % 90 if i % 13 else None, i % 2 if i % 7 else None, float(i)) for i in range(130)]
    flows = spark.createDataFrame(rows, "id long, label int, x double")
    ref = splits.train_val_test(flows, "id").localCheckpoint()
    other = flows.withColumn("y", F.col("x") * 2)
    want = other.join(ref.select("id", "split"), "id").select(*other.columns, "split")
    got = splits.split_alike(other, ref.select("id", "label", "split"), flows, "id")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    once = flows.where("id between 40 and 89 and x >= 40 and x < 90 and label is not null")
    ref = splits.train_val_test(once, "id").localCheckpoint()
    got = splits.split_alike(once, ref.select("id", "label", "split"), once, "id")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, ref.collect()))
