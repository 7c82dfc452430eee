"""The merge parses its text once, however many steps read the objects."""

from pyspark.sql import functions as F

from vigilflow.sources import kb


def test_merge_parses_objects_and_clusters_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return df.mapInPandas(run, df.schema)

    ref = '"external_references":[{"source_name":"mitre-attack","external_id":"%s"}]'
    text = ['{"objects":[{"type":"intrusion-set","id":"is-1","name":"A","description":"A long description of the group","aliases":["A","Other"],' + ref % "G0001" + "}]}",
            '{"objects":[{"type":"attack-pattern","id":"ap-1","name":"T",' + ref % "T1001" + "}]}",
            '{"objects":[{"type":"relationship","id":"r","relationship_type":"uses","source_ref":"is-1","target_ref":"ap-1"}]}']
    galaxy = ['{"values":[{"value":"A","description":"Cluster","meta":{"aliases":["Third"],"synonyms":[]}}]}']
    bundles = spark.createDataFrame([(t,) for t in text], "value string")
    docs = spark.createDataFrame([(1, t) for t in galaxy], "doc_no long, value string")
    empty = F.array().cast("array<string>")
    actors = spark.createDataFrame([("1", "A", "G0001")], "id string, name string, mitre_id string").select(
        "*", F.lit("N1").alias("origin"), F.lit("").alias("sponsor"), empty.alias("sectors"), F.array(F.lit("Own")).alias("aliases"),
        F.lit("short").alias("summary"), F.lit("reference-doc").alias("summary_source"), empty.alias("techniques"))
    r = kb.merge_actors(actors, kb.stix_objects(counted(bundles)), kb.galaxy_clusters(counted(docs))).collect()
    assert [(x["aliases"], x["summary_source"], x["techniques"]) for x in r] == [(["Own", "A", "Other", "Third"], "mitre-stix", ["T1001"])]
    assert seen.value == len(text) + len(galaxy)
