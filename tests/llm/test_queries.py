import importlib

import pytest

from spindrel.llm.queries import oracle_sql, queries
from spindrel.session import ship

from ..compare import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    same(queries()[name](ship(spark), sf), duck, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](ship(spark), sf).count() > 0


def test_entry_adds_the_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())
