"""Every query with SQL gives what DuckDB gives; the others run."""

from __future__ import annotations

import pytest
from conftest import same

from siftline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, data, name):
    assert same(catalogue.QUERIES[name](spark, data).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).toPandas().shape[1] > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
