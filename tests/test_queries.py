"""Every registered query runs and equals its check SQL."""

import re

import pytest

from tests.parity import compare, duck
from tidemark.catalog import ORACLES, QUERIES

# Results that may be empty on the smallest tables.
MAY_BE_EMPTY = {"check_frequency", "quality_gate", "error_spikes", "stream_log_alerts", "missing_grid_points", "drop_correlated"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        problem = compare(got, con.sql(ORACLES[name]).df())
        assert not problem or (problem == "no rows" and name in MAY_BE_EMPTY)
    else:
        assert len(got)


def test_names_and_contract():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in QUERIES)
