"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from eventlens.catalog import ORACLES, QUERIES
from tools.compare import canonical, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names_match():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    result = queries()[name](spark, sf)
    left = [tuple(r) for r in result.collect()]
    checked = con.execute(oracle_sql()[name])
    columns = [c[0] for c in checked.description]
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, left) == canonical(columns, checked.fetchall())


def test_entry(spark):
    assert entry(spark).columns[:4] == ["ipo_id", "rival_fc", "event_date", "timestamp"]
