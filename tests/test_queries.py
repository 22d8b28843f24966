from __future__ import annotations

import pytest

from quire.plans import catalogue

from .compare import same_as_sql
from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, name):
    same_as_sql(spark, SMALL, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
