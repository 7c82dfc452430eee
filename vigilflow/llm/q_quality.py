from .common import query, table
from .quality import classify


@query("op10_quality_pu")
def op10_quality_pu(spark, sf):
    """Positive-unlabelled quality score of every document."""
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
