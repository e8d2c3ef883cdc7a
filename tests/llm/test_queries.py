import pytest

from millrace.llm import queries as llm
from tests.oracle import connection, same


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    if name in llm.oracle_sql():
        same(df, connection(sf_dir), llm.oracle_sql()[name])
    else:
        assert df.count() > 0
