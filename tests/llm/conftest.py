import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents as (id, text)."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


@pytest.fixture
def frame(spark):
    """Makes documents with more columns, some with names that operators use themselves."""

    def make(rows, parts=3):
        more = [(i, t, k, "x", None, 5) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(more, "doc_id long, text string, id int, lang string, h string, sha long").repartition(parts)

    return make
