"""Queries that were registered over part of their job cover all of it."""

from itertools import product

from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.fixtures import bars30


def all_windows(spark, sf):
    """Rows 61 to the last but one of each series have a window."""
    return sum(max(r["count"] - 61, 0) for r in bars30(spark, sf).groupBy("symbol").count().collect())


def test_every_window_is_scaled(spark, sf):
    got = QUERIES["scale_all_windows"](spark, sf)
    assert got.select("symbol", "ts").distinct().count() == all_windows(spark, sf) > QUERIES["scale_windows"](spark, sf).select("symbol", "ts").distinct().count()
    for c in ("close", "volume"):  # fitted on all of them
        mean, deviation = got.agg(F.avg(c), F.stddev_pop(c)).first()
        assert abs(mean) < 1e-6 and abs(deviation - 1) < 1e-6


def test_every_window_is_written(spark, sf):
    assert QUERIES["all_windows_parquet"](spark, sf).agg(F.sum("n")).first()[0] == all_windows(spark, sf)


def test_search_tries_the_whole_grid(spark, sf):
    got = QUERIES["search"](spark, sf).collect()
    assert {(r.trees, r.depth) for r in got} == set(product((10, 20, 40), (3, 5, 7))) and len(got) == 9
