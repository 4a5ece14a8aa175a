"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import connect, differences
from tidewatch.plans.registry import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = [d for d in differences(QUERIES[name].run(spark, sf_dir), duck, QUERIES[name].sql) if d != "EMPTY"]
    assert not found, "\n".join(found)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    assert df.count() > 0 and all(kind not in ("void",) for _, kind in df.dtypes)
