"""Queries against their SQL at the smallest scale; ``PARITY_ALL=1`` runs every one."""

import os

import pytest

import __spark_entry__ as entry

from .parity import compare, duck

SF = os.environ.get("PARITY_TEST_DIR", "/root/testdata/sf0.001")
CORE = ["ioc_upsert", "ioc_stats", "cti_enrich", "cti_coverage", "cti_evidence_rank", "src_jsonl_flows", "src_zeek_flows", "src_eve_flows",
        "feed_urlhaus", "feed_plainlist", "met_folds", "split_tvt", "dash_timeline", "dash_targets", "reason_codes", "kb_merge",
        "tfidf_weights", "attr_verdict"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("PARITY_ALL") else CORE)
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
