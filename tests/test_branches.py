"""The fixtures reach each branch, and zero prices or doubled stamps break nothing."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.operators import clean as C
from tidemark.operators import indicators as X
from tidemark.operators import keys as K
from tidemark.operators import quality as Q
from tidemark.operators.process import process
from tidemark.plans.series import Axis

SF = "/root/testdata/sf0.01"
START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def values(spark, name, column):
    return {r[0] for r in QUERIES[name](spark, SF).select(column).distinct().collect()}


def test_calm_series_reach_all_levels_and_factors(spark):
    assert values(spark, "volatility_level_calm", "level") == {"high", "medium", "low"}
    assert values(spark, "market_state_calm", "market_state") == {0, 1, 2}
    assert values(spark, "dynamic_window_size_calm", "stepped") == {30, 45, 60}
    assert len(values(spark, "dynamic_window_size_calm", "size")) > 6
    assert values(spark, "imbalance_profile_of_lines", "strategy") | values(spark, "imbalance_profile", "strategy") == {"oversample", "weights"}


def rows(n=60):
    out = []
    for i in range(n):
        close = 0.0 if i % 50 == 10 else 100.0 + i % 7
        out.append(("a", START + dt.timedelta(minutes=30 * i), close, close + 1, max(close - 1, 0.0), close, 0 if i % 9 == 0 else 5))
    return out


def test_zero_prices(spark):
    df = spark.createDataFrame(rows(), BAR)
    dead = C.recompute_dead_features(df.withColumns({"volatility": F.lit(0.0), "returns_1": F.lit(None).cast("double")}))
    assert dead.count() == 60 and dead.filter("volatility is not null").count()
    flags = X.threshold_flags(df.withColumns({"close": F.lit(0.0), "atr": F.lit(1.0), "rsi": F.lit(50.0), "adx": F.lit(1.0)}))
    assert flags.filter("atr_ratio is null").count() == 60
    flat = spark.createDataFrame([(s, t, 0.0, 0.0, 0.0, 0.0, 0) for s, t, *_ in rows()], BAR)
    for frame in (df, flat):
        assert C.clean(frame).count() >= 0 and Q.health_report(frame).count() == 1
        assert X.realtime_features(frame).count() == 1 and process(frame).flow.count() == 1


def test_survivor_of_a_doubled_stamp_is_named(spark):
    double = [("a", START, 1.0, 5.0, 1.0, 4.0, 7), ("a", START, 1.0, 5.0, 1.0, 2.0, 9), ("a", START, 3.0, 5.0, 1.0, 1.0, 1)]
    for order in (double, double[::-1], [double[1], double[2], double[0]]):
        df = spark.createDataFrame(order, BAR).repartition(3)
        assert [r.close for r in K.dedupe_ts(df).collect()] == [2.0]
        assert [r.close for r in K.dedupe_ts(df, Axis(), arrival=["volume"]).collect()] == [1.0]
