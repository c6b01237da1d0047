"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import pytest

from chronofold.llm import registry
from tests.test_oracles import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, duck, name):  # noqa: F811
    found, wanted = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_thirteen_operators():
    numbers = sorted(int(name.split("_")[0].removeprefix("op")) for name in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
