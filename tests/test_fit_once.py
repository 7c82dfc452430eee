"""A fit computes its rows once, and leaves nothing kept."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilflow.operators import models as ml


def test_rows_of_a_fit_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(400).repartition(3).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.udf(noted, T.DoubleType())((F.col("id") % 17).cast("double")).alias("x"))
    d = ml.prepare(rows, ["x"], ("label",))
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept())  # other tests keep frames
    model = ml.fit(d, ml.random_forest(ml.Settings(trees=3, max_depth=3, min_leaf=2)))
    assert len(model.trees) == 3
    assert seen.value <= 2 * 400  # the class weights read the rows too, where the label alone does not spare the column
    assert set(kept()) <= before
