from pyspark.sql import functions as F

from .common import bucket, query, table
from .secrets import find


@query("op1_secret_forest")
def op1_secret_forest(spark, sf):
    """Every candidate of every document and whether it is a secret."""
    found = find(table(spark, sf, "documents"))
    return found.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"), (bucket("doc_id") == 2).alias("held_out"), "score", "secret")
