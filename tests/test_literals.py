"""The literal cases against their SQL."""

import literal_cases
import pytest


@pytest.mark.parametrize("name", [n for n in literal_cases.QUERIES if n in literal_cases.SQL])
def test_case(name, spark, sf, sql, same):
    same(literal_cases.QUERIES[name](spark, sf).toPandas(), sql(literal_cases.SQL[name]))


@pytest.mark.parametrize("name", [n for n in literal_cases.QUERIES if n not in literal_cases.SQL])
def test_case_without_sql(name, spark, sf):
    assert literal_cases.QUERIES[name](spark, sf).count() > 0
