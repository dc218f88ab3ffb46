"""Every registered query with SQL against that SQL."""

import pytest

from weftline.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sf, sql, same):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.SQL:
        same(got, sql(catalogue.SQL[name]))
    else:
        assert len(got)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
