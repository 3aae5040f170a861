from pathlib import Path

import pytest

import __spark_entry__ as entry
from clinmill.plans import registry
from tests.oracle import compare

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, DATA, registry.queries()[name], registry.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    assert df.count() > 0 and len(df.columns) > 0


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
