from pyspark.sql import functions as F

from .common import query, table
from .licenses import BASE, CONFIDENCE, scan


@query("op8_license_rules")
def op8_license_rules(spark, sf):
    """Base phrases and license labels of every document."""
    found = scan(table(spark, sf, "documents"))
    base = F.filter("detections", lambda d: d["priority"] == BASE)
    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])

    def names(d):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: confidence[d["priority"]])), F.lit(0.0)).alias("score"),
        "detections")
