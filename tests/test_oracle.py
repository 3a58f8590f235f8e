import pytest
from conftest import SF, plain

from ledgermesh.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if not n.startswith("frs_f")))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = df.columns
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=str)
    assert got == oracle(ORACLE_SQL[name], columns)
