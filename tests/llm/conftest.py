"""A small table with every awkward case: nulls, empty, blank and very long texts, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("th", "en", "lo", "qu") for b in ("er", "an", "i", "o") for c in ("st", "n", "ra", "ly", "d")]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def plain(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def with_clashes(df):
    """Extra columns named like those that operators add."""
    return df.withColumns({c: F.lit(f"own {c}") for c in ("score", "n", "kept", "component", "_key", "_size", "_copies", "_spans", "features", "rank", "node", "host", "v", "start")})


@pytest.fixture(scope="session")
def awkward():
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "a"), (5, "one two", "b"), (6, "one two", "b"), (None, "no id here at all", "b"),
            (7, prose(rnd, 60), None), (7, prose(rnd, 60), None)]
    base = prose(rnd, 80)
    rows += [(8, base, "c"), (9, base, "c"), (9, base, "c"), (10, base + " more", "c")]
    return rows
