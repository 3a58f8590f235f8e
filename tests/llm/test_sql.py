"""Training-data queries against their SQL."""

import pytest

from ledgermesh.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF, plain


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == oracle(ORACLE_SQL[name], columns)
