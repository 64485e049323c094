"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from loomlake.plans import catalog
from tests.compare import differ, tables
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    assert differ(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bm25_score_makes_no_row_for_a_pair(spark):
    """Scores of a query and a document are summed where they are made; no join gives them as rows."""
    totals = catalog.QUERIES["bm25_score"](spark, SMALL)
    assert "Join" not in totals._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        pq.write_table(pq.read_table(f"{SMALL}/{f}").slice(0, 0), folder / f)
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() >= 0
