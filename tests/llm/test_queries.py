"""Training-data queries that SQL can check, and that every query runs on the smallest test tables."""

import os
from pathlib import Path

import pytest

from compare import canon, views
from textloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")

FOUND = {
    "p1_found": {"doc_id_a", "doc_id_b"}, "p2_found": {"doc_id"}, "p3_found": {"doc_id"}, "p4_found": {"doc_id", "line_no"},
    "p6_found": {"doc_id", "kind", "start_pos", "end_pos"}, "p7_found": {"doc_id", "item_id"}, "p9_found": {"doc_id", "start_pos", "end_pos"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in FOUND:
        assert set(df.columns) == FOUND[name]
        assert df.count() == df.distinct().count()
    else:
        df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), views(DATA).execute(queries.SQL[name]).fetchdf()
    assert canon(got) == canon(want)
