"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from tools import check_results as C
from webloom.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def duck():
    return C.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    ok, note = C.compare(spark, duck, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert ok, note


def test_every_query_has_unique_purpose():
    assert len(QUERIES) > 200 and set(ORACLE) <= set(QUERIES)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "avg_quality" in df.columns
