"""Every registered query of the engine against its oracle SQL; those without one give rows."""

from __future__ import annotations

import oracle
import pytest
from oracle import SF

from docengine import catalog

catalog.load()


@pytest.fixture(scope="module")
def tables():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, tables, name):
    assert oracle.compare(spark, tables, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
