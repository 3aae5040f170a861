from pathlib import Path

import pytest

from clinmill.llm import queries as Q
from tests.oracle import compare

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, DATA, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_columns(spark):
    want = {"p1_found": ["id", "groupe_id"], "p2_found": ["id_1", "id_2"], "p3_found": ["paire_id", "champ", "defaut"], "p4_found": ["nom_table", "id", "type_donnee", "debut"], "p6_found": ["id_1", "id_2"], "p9_found": ["doc_id"]}
    for name, columns in want.items():
        assert Q.queries()[name](spark, str(DATA)).columns == columns
