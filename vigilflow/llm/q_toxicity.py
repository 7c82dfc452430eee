from .common import query, table
from .toxicity import classify


@query("op2_toxicity_knn")
def op2_toxicity_knn(spark, sf):
    """Calibrated nearest-example toxicity of every document."""
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
