"""Every registered core query against its SQL, or at least to its end."""

import pytest

from millrace import queries as core
from tests.oracle import connection, same

NAMES = list(core.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    df = core.queries()[name](spark, sf_dir)
    if name in core.oracle_sql():
        same(df, connection(sf_dir), core.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(core.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
