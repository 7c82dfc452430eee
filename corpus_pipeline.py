"""Corpus preparation: five stages that each take what their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilflow.llm import minhash, mixing, pieces, quality, secrets
from vigilflow.llm.common import prepare, store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Public vocabulary on the test box; a parameter of the last stage's operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    prepare(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return minhash.deduplicate(docs).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced."""
    prepare(spark)
    return secrets.redact(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    prepare(spark)
    return mixing.mix(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text of the mix."""
    prepare(spark)
    return pieces.encode_decode(docs, pieces.load(MODEL))


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]
ORACLE_SQL = None  # the trained stages have no SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
