import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark: SparkSession):
    """Documents from (doc_id, text, source) with extra columns whose names clash with those that operators use."""
    def build(rows, parts=3):
        full = [(i, t, "en", s, 0, -1, 2.5, "x", [1], "k") for i, t, s in rows]
        extra = ", size long, target double, run string, words array<int>, key string"
        return spark.createDataFrame(full, DOCS + extra).repartition(parts)
    return build


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty and blank texts, repeated rows, ties, one very long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    return [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "alpha beta", "b"), (5, "alpha beta", "b"), (5, "alpha beta", "b"),
            (6, long, "hot"), (7, long, "hot"), (8, "Ünï çødé ΣΑΣ <|endoftext|> it's 12", None), (None, "no id", "b"), (9, "\n\n", "hot")]
