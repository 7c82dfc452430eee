from pyspark.sql import functions as F

from .common import query, table
from .pages import extract


@query("op7_site_templates")
def op7_site_templates(spark, sf):
    """Main text of every page."""
    return extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))
