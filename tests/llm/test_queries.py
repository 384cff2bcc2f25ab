"""The operators' queries against their SQL, over the smallest tables."""

import pytest

from lodestone.llm import queries
from tests.test_oracle import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
