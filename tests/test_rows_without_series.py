"""Fills return as many rows as they get."""

from datetime import datetime

import pytest

from tidemark.operators import clean as C
from tidemark.operators import quality as Q
from tidemark.operators.keys import dedupe_ts


@pytest.mark.parametrize("fill", [C.ffill, C.bfill, C.ffill_bfill, C.interpolate_linear, C.median_fill, C.mean_fill])
def test_rows_without_stamp_or_key_pass(spark, fill):
    day = lambda n: datetime(2024, 1, n)
    rows = [("a", day(1), 1.0), ("a", day(2), None), ("a", day(3), 3.0), ("a", None, 9.0), (None, day(1), 7.0), (None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    got = [tuple(r) for r in fill(df, ["close"]).collect()]
    assert len(got) == len(rows) and {("a", None, 9.0), (None, day(1), 7.0), (None, None, None)} <= set(got)
    assert all(v is not None for symbol, _, v in got if symbol)


@pytest.fixture
def odd(spark):
    """Bars of a series, and rows without a stamp, a key, or both, two of which are alike but for a value."""
    day = lambda n: datetime(2024, 1, n)
    rows = [("a", day(n), 1.0 + n, None if n % 2 else 0.1, None) for n in range(1, 6)]
    rows += [("a", None, 9.0, None, None), ("a", None, 8.0, None, None), (None, day(1), 7.0, None, 0.0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volatility double, returns_1 double")


@pytest.mark.parametrize("repair", [lambda df: C.adaptive_null_fix(df, ["volatility", "absent"]), C.rebuild_protected, C.recompute_dead_features, dedupe_ts])
def test_repairs_keep_rows_without_stamp_or_key(odd, repair):
    got = repair(odd)
    assert got.count() == odd.count()
    rest = got.filter("symbol is null or ts is null").select(*odd.columns)
    assert sorted(map(str, rest.collect())) == sorted(map(str, odd.filter("symbol is null or ts is null").collect()))
    assert got.filter("symbol is not null and ts is not null").count() == 5


def test_doubled_stamps_still_go(odd):
    assert dedupe_ts(odd.union(odd)).filter("ts is not null").count() == odd.filter("ts is not null").count()


@pytest.fixture
def odd_bars(spark):
    """Five sound bars, two without a stamp and one without a key."""
    day = lambda n: datetime(2024, 1, n)
    rows = [("a", day(n), 1.0 + n, 2.0 + n, 1.0 + n, 1.5 + n, 10) for n in range(1, 6)]
    rows += [("a", None, 9.0, 9.5, 9.0, 9.2, 1), ("a", None, 8.0, 8.5, 8.0, 8.2, 2), (None, day(1), 7.0, 7.5, 7.0, 7.2, 3)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint")


def test_repair_keeps_bars_without_stamp_or_key(odd_bars):
    assert Q.repair(odd_bars).count() == odd_bars.count()


def test_the_log_tells_of_every_bar_cleaning_takes(odd_bars):
    steps = dict(C.clean_steps(odd_bars))
    assert all(steps[name].count() == odd_bars.count() for name in ("missing", "ohlc", "volume", "outliers"))
    log = {(r.symbol, r.step): (r.rows, r.affected) for r in C.cleaning_log(odd_bars).collect()}
    assert log["a", "outliers"] == (7, 0) and log["a", "resample"] == (5, 2)
    assert log[None, "input"] == (1, None) and log[None, "resample"] == (1, 0) and log[None, "gaps"] == (0, 1)
    assert len(log) == 2 * len(steps)
