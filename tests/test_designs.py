"""Inputs of experiments are evaluated once, however many steps read them."""

from pyspark.sql import functions as F

from vigilflow.operators import models as ml
from vigilflow.plans import experiments as xp


def counted(spark, df):
    """``df`` whose rows are counted each time they are made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), seen


def test_design_reads_and_scores_once(spark, monkeypatch):
    d = spark.range(400).select(
        F.col("id").alias("flow_id"), F.col("id").cast("double").alias("ts"), (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.lit("x").alias("attack_cat"), (F.col("id") % 9).cast("double").alias("dur"), F.when(F.col("id") % 2 == 0, "tcp").otherwise("udp").alias("proto"))
    once, seen = counted(spark, d)
    rows, feats, _, _ = xp.designed(once)
    assert rows.count() == 400 and seen.value == 400
    s = ml.Settings(trees=2, max_depth=3)
    scored, plain = [], ml.score

    def score(model, df):
        out, seen = counted(spark, plain(model, df).select("label", "split", "score"))
        scored.append(seen)
        return out

    monkeypatch.setattr(ml, "score", score)
    ml.fit_and_score(xp.parts(rows, feats), ml.random_forest(s), s.target_recall)[2].collect()
    assert sum(x.value for x in scored) == 160
