"""Actor knowledge sources: STIX bundles and galaxy clusters as JSON text, and their merge into a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

STIX_SCHEMA = """struct<objects:array<struct<type:string, id:string, name:string, description:string, revoked:boolean,
 x_mitre_deprecated:boolean, aliases:array<string>, relationship_type:string, source_ref:string, target_ref:string,
 external_references:array<struct<source_name:string, external_id:string>>>>>"""

GALAXY_SCHEMA = """struct<`values`:array<struct<value:string, description:string, meta:struct<aliases:array<string>,
 synonyms:array<string>, `cfr-suspected-state-sponsor`:string, `cfr-target-category`:array<string>>>>>"""

# words that are no alias on their own (fixed values)
GENERIC_NAMES = ("apt", "group", "actor", "apt group")


def clean(c) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def name_key(c) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def stix_objects(bundles: DataFrame) -> DataFrame:
    """Live objects of JSON bundles; ``ext_id`` is the first ATT&CK reference."""
    o = bundles.select(F.explode(F.from_json("value", STIX_SCHEMA)["objects"]).alias("o")).select("o.*")
    live = o.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return live.withColumn("ext_id", F.try_element_at(refs, F.lit(1))["external_id"])


def group_techniques(objects: DataFrame) -> DataFrame:
    """(group, technique) pairs along ``uses`` relationships, each once."""
    groups = objects.where((F.col("type") == "intrusion-set") & F.col("ext_id").isNotNull())
    techs = objects.where((F.col("type") == "attack-pattern") & F.col("ext_id").isNotNull())
    # repeats of one relationship are merged before they meet the joins
    uses = objects.where((F.col("type") == "relationship") & (F.col("relationship_type") == "uses")).select(
        "source_ref", "target_ref").distinct()
    return (
        uses.join(groups.select(F.col("id").alias("source_ref"), F.col("ext_id").alias("group_id")), "source_ref")
        .join(techs.select(F.col("id").alias("target_ref"), F.col("ext_id").alias("technique_id")), "target_ref")
        .select("group_id", "technique_id").distinct()
    )


def technique_sets(pairs: DataFrame) -> DataFrame:
    """Sorted technique list per group; a list is no longer than the catalogue of techniques."""
    return pairs.groupBy("group_id").agg(F.sort_array(F.collect_set("technique_id")).alias("techniques"))


def galaxy_clusters(docs: DataFrame) -> DataFrame:
    """One row per cluster with a running number (document order, then position)."""
    v = docs.select("doc_no", F.posexplode(F.from_json("value", GALAXY_SCHEMA)["values"]).alias("pos", "c"))
    empty = F.array().cast("array<string>")
    return v.select(
        F.struct("doc_no", "pos").alias("cluster"), F.col("c.value").alias("name"), F.col("c.description").alias("description"),
        F.coalesce("c.meta.aliases", empty).alias("aliases"), F.coalesce("c.meta.synonyms", empty).alias("synonyms"),
        F.col("c.meta.cfr-suspected-state-sponsor").alias("sponsor"),
        F.coalesce("c.meta.cfr-target-category", empty).alias("sectors"),
    )


def galaxy_keys(clusters: DataFrame) -> DataFrame:
    """name key -> first cluster that carries it as name, alias or synonym."""
    names = F.concat(F.array("name"), "aliases", "synonyms")
    return (
        clusters.select("cluster", F.explode(names).alias("n"))
        .where(F.coalesce("n", F.lit("")) != "")
        .groupBy(name_key("n").alias("key")).agg(F.min("cluster").alias("cluster"))
    )


def merge_aliases(base: Column, extra: Column) -> Column:
    """Aliases of ``base`` as they are, then new ones of ``extra`` by key, in order, without generic words."""
    keyed = F.transform(extra, lambda x: F.struct(name_key(x).alias("k"), clean(x).alias("v")))
    seen = F.transform(base, name_key)
    fresh = F.filter(keyed, lambda e: (e["k"] != "") & ~e["k"].isin(*GENERIC_NAMES) & ~F.array_contains(seen, e["k"]))
    # keep the first of each key
    first = F.filter(fresh, lambda e, i: F.array_position(F.transform(fresh, lambda f: f["k"]), e["k"]) == i + 1)
    return F.concat(base, F.transform(first, lambda e: e["v"]))


def drop_group_ids(aliases: Column) -> Column:
    return F.filter(aliases, lambda a: ~F.trim(a).rlike(r"^G\d{4}$") & (clean(a) != ""))


def longer_summary(summary: Column, source: Column, text: Column, label: str) -> tuple[Column, Column]:
    better = F.length(text) > F.length(summary)
    return F.when(better, text).otherwise(summary), F.when(better, label).otherwise(source)


def merge_actors(actors: DataFrame, objects: DataFrame, clusters: DataFrame) -> DataFrame:
    """Enrich actors from STIX by group id, then from the galaxy by name, else by first matching alias."""
    # several steps read them, each a few columns of one type of object: the text is parsed once
    objects = cut(objects.select("type", "id", "ext_id", "relationship_type", "source_ref", "target_ref", "description", "aliases"))
    clusters = cut(clusters)
    empty = F.array().cast("array<string>")
    tech = technique_sets(group_techniques(objects))
    sets = (
        objects.where((F.col("type") == "intrusion-set") & F.col("ext_id").isNotNull())
        .groupBy(F.col("ext_id").alias("group_id"))
        .agg(F.max_by("description", "id").alias("g_desc"), F.max_by("aliases", "id").alias("g_aliases"))
        .join(tech.withColumnRenamed("techniques", "g_tech"), "group_id")
    )
    a = actors.join(sets, actors["mitre_id"] == sets["group_id"], "left")
    known = F.col("group_id").isNotNull()
    base = F.coalesce("aliases", empty)
    text, src = longer_summary(F.coalesce("summary", F.lit("")), F.coalesce("summary_source", F.lit("reference-doc")),
                               F.when(known, clean("g_desc")).otherwise(""), "mitre-stix")
    a = a.select(
        "id", "name", "mitre_id", "origin", "sponsor", "sectors",
        F.when(known, merge_aliases(base, F.coalesce("g_aliases", empty))).otherwise(base).alias("aliases"),
        text.alias("summary"), src.alias("summary_source"),
        F.when(known, F.col("g_tech")).otherwise(F.coalesce("techniques", empty)).alias("techniques"),
    )
    # the name ranks before every alias, aliases rank by position
    tries = a.select("id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "n"))
    hit = tries.join(galaxy_keys(clusters), name_key("n") == F.col("key")).groupBy("id").agg(
        F.min_by("cluster", "pos").alias("cluster"))
    c = clusters.select(
        "cluster", F.col("description").alias("c_desc"), F.concat("aliases", "synonyms").alias("c_aliases"),
        clean("sponsor").alias("c_sponsor"),
        F.filter(F.transform("sectors", clean), lambda x: x != "").alias("c_sectors"))
    m = a.join(hit.join(c, "cluster").drop("cluster"), "id", "left")
    text, src = longer_summary(F.col("summary"), F.col("summary_source"), clean("c_desc"), "misp-galaxy")
    return m.select(
        "id", "name", "mitre_id", "origin",
        F.coalesce(F.nullif("sponsor", F.lit("")), F.nullif("c_sponsor", F.lit("")), "sponsor").alias("sponsor"),
        F.when(F.size(F.coalesce("sectors", empty)) > 0, F.col("sectors")).otherwise(
            F.coalesce("c_sectors", "sectors")).alias("sectors"),
        drop_group_ids(merge_aliases(F.col("aliases"), F.coalesce("c_aliases", empty))).alias("aliases"),
        text.alias("summary"), src.alias("summary_source"), "techniques",
    )


def corpus_stats(actors: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    names = actors.select(F.explode(F.concat(F.array("name"), "aliases")).alias("n")).where(name_key("n") != "")
    unique = names.agg(F.count_distinct(name_key("n"))).scalar()
    return actors.agg(
        F.count(F.lit(1)).alias("actors"),
        F.count_if(F.size(F.coalesce("techniques", empty)) > 0).alias("with_techniques"),
        F.count_if(F.coalesce("sponsor", F.lit("")) != "").alias("with_sponsor"),
        F.count_if(F.size(F.coalesce("sectors", empty)) > 0).alias("with_sectors"),
    ).withColumn("unique_names", unique)


def actor_document(df_cols=None) -> Column:
    """Text a retrieval model is fitted on."""
    def joined(c):
        return F.array_join(c, " ")

    return clean(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (
        F.col("name"), joined("aliases"), F.col("origin"), F.col("sponsor"), joined("sectors"), F.col("summary"),
        joined("techniques"))]))
