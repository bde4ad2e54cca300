"""Repairs against pandas, and edge shapes."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.operators import keys as K
from tidemark.operators import quality as Q
from tidemark.operators.keys import OHLCV
from tidemark.plans.series import Axis

START = dt.datetime(2024, 1, 2, 9, 30)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def perfect(n=50, symbol="a", seed=42, minutes=30):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 0.5, n).cumsum()
    open_ = np.r_[100, close[:-1]]
    rows = []
    for i in range(n):
        high, low = max(open_[i], close[i]) + 0.3, min(open_[i], close[i]) - 0.3
        rows.append([symbol, START + dt.timedelta(minutes=minutes * i), float(open_[i]), float(high), float(low), float(close[i]), int(rng.integers(1000, 9999))])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def faulty(kind):
    rows = perfect()
    if kind in ("missing", "complex"):
        for i in (5, 6, 7):
            rows[i][3] = None
        rows[20][5] = None
    if kind == "missing":
        rows[11] = rows[11][:2] + [None] * 5
        rows[30][6] = None
    if kind in ("outlier", "complex"):
        rows[15][5] *= 20
        rows[25][6] = -1000
    if kind == "time":
        rows = rows[:20] + rows[25:] + [list(rows[40])]
    if kind in ("logic", "complex"):
        rows[8][3] = rows[8][4] - 10
    if kind == "logic":
        rows[12][2], rows[13][5] = 0.0, -5.0
    return rows


def issues(spark, rows):
    return {(r.issue_type, r.column, r.severity) for r in Q.all_issues(frame(spark, rows)).collect()}


def test_perfect_bars_have_no_issue(spark):
    assert issues(spark, perfect()) == set()
    assert Q.health_report(frame(spark, perfect())).first().status == "healthy"


@pytest.mark.parametrize(
    "kind, expected",
    [
        ("missing", {("missing_values", "high", "warning"), ("missing_values", "close", "warning"), ("missing_values", "volume", "warning")}),
        ("outlier", {("volume_anomaly", "volume", "critical")}),
        ("time", {("time_continuity", "index", "warning"), ("duplicate_timestamps", "index", "warning")}),
        ("logic", {("price_anomaly", "high", "critical"), ("price_anomaly", "open", "critical"), ("price_anomaly", "close", "critical")}),
        ("complex", {("volume_anomaly", "volume", "critical"), ("price_anomaly", "high", "critical"), ("missing_values", "high", "warning")}),
    ],
)
def test_faults_are_found(spark, kind, expected):
    assert expected <= issues(spark, faulty(kind))


def test_checks_leave_their_input_alone(spark):
    df = frame(spark, faulty("complex"))
    before = df.orderBy("ts").toPandas()
    Q.all_issues(df).count()
    pd.testing.assert_frame_equal(before, df.orderBy("ts").toPandas())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = frame(spark, perfect(max(n, 1))[:n])
    assert Q.health_report(df).count() == (1 if n else 0)
    assert C.clean(df).count() == n
    assert Q.series_stats(df).count() == (1 if n else 0)


def test_many_rows(spark):
    report = Q.health_report(frame(spark, perfect(5000, minutes=1))).first()
    assert report.rows == 5000 and report.critical_issues == 0


@pytest.mark.parametrize("mode", ["conservative", "standard", "strict"])
def test_cleaned_bars_have_no_fault_left(spark, mode):
    rows = faulty("complex")
    out = C.clean(frame(spark, rows), mode).toPandas().sort_values("ts")
    assert out.notna().all().all() and (out.volume >= 0).all()
    assert (out.ts.diff().dropna() == pd.Timedelta(minutes=30)).all()
    if mode != "conservative":
        assert (out.low > 0).all()


def test_interpolation_and_fills_equal_pandas(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(200) < 0.4, np.nan, rng.normal(size=200))
    values[:3] = np.nan
    values[-4:] = np.nan
    series = pd.Series(values)
    rows = [("a", START + dt.timedelta(hours=i), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    axis = Axis(cell=3600 * 7)

    def column(out):
        return out.toPandas().sort_values("ts").x.to_numpy(float)

    np.testing.assert_allclose(column(C.interpolate_linear(df, ["x"], axis)), series.interpolate(), rtol=1e-12)
    np.testing.assert_array_equal(column(C.ffill(df, ["x"], axis)), series.ffill())
    np.testing.assert_array_equal(column(C.bfill(df, ["x"], axis)), series.bfill())
    np.testing.assert_array_equal(column(C.ffill_bfill(df, ["x"], axis)), series.ffill().bfill())
    np.testing.assert_allclose(column(C.median_fill(df, ["x"], axis)), series.fillna(series.median()))


def test_resample_equals_pandas(spark):
    rows = faulty("missing")
    data = pd.DataFrame(rows, columns=["symbol", "ts", *OHLCV]).set_index("ts")
    how = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    want = data[list(OHLCV)].astype(float).resample("2h").agg(how).dropna()
    got = K.resample_ohlcv(frame(spark, rows), 7200).toPandas().sort_values("ts").set_index("ts")[list(OHLCV)].astype(float)
    pd.testing.assert_frame_equal(got, want, check_freq=False, check_names=False, check_index_type=False, check_dtype=False)


def test_gaps_are_filled_on_long_grids(spark):
    rows = [("a", START, 1.0), ("a", START + dt.timedelta(minutes=5000), 2.0), ("b", START, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    out = K.fill_time_gaps(df, 60).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("symbol").collect()
    assert [(r.n, r.s) for r in out] == [(5001, 5002.0), (1, 3.0)]


def test_localize_skipped_and_doubled_hours(spark):
    rows = [(dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 11, 3, 1, 30),), (dt.datetime(2024, 7, 1, 12),), (dt.datetime(2024, 3, 10, 3, 0),)]
    got = [r.utc for r in K.localize(spark.createDataFrame(rows, "ts timestamp_ntz")).collect()]
    assert got == [dt.datetime(2024, 3, 10, 7, 0), None, dt.datetime(2024, 7, 1, 16), dt.datetime(2024, 3, 10, 7, 0)]


def test_dedupe_keeps_the_first_arrival(spark):
    rows = [("a", START, i, 100 - i) for i in range(100)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, x int")
    assert [(r.id, r.x) for r in K.dedupe_ts(df, arrival=["id"]).collect()] == [(0, 100)]
