"""Blocked and prefix plans against plain windows over whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ewm
from tidemark.plans import parts, series
from tidemark.plans.series import Axis, Halo, highest, latest, lowest, numbered, row_count, running, total, upcoming


def frame(seed=1, n=600):
    """One key holds a third of the rows, half of them in one burst; stamps repeat."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.integers(0, 9)}"
        minutes = 7 if key == "hot" and rng.random() < 0.5 else int(rng.integers(0, 60 * 24 * 20))
        x = None if rng.random() < 0.3 else float(np.round(rng.normal(50, 20), 2))
        rows.append((key, start + dt.timedelta(minutes=minutes), i, x))
    return rows


@pytest.fixture(scope="module")
def df(spark):
    schema = "symbol string, ts timestamp_ntz, id bigint, x double"
    return spark.createDataFrame(frame(), schema).persist()


AXES = [
    Axis(ties=("id",)),
    Axis(ties=("id",), cell=3600, block=7),
    Axis(ties=("id",), cell=86400 * 400, block=16),
    Axis(ties=("id",), cell=None, block=11),
]


@pytest.fixture(params=range(len(AXES)))
def axis(request, monkeypatch):
    # Small limits, so that the sketch cuts even these series.
    monkeypatch.setattr(parts, "FAN", 3)
    return AXES[request.param].with_(whole=20)


def same(a, b, cols):
    a = a.select("id", *cols).toPandas().sort_values("id").reset_index(drop=True)
    b = b.select("id", *cols).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_running_matches_whole_windows(df, axis):
    w = Window.partitionBy("symbol").orderBy("ts", "id")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumns(
        {
            "n": F.row_number().over(w),
            "s": F.coalesce(F.sum("x").over(upto), F.lit(0.0)),
            "hi": F.max("x").over(upto),
            "lo": F.min("x").over(upto),
            "prev": F.last("x", True).over(upto),
            "next": F.first("x", True).over(after),
            "rows": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        }
    )
    got = running(
        df, axis, size="rows", n=row_count(), s=total("x"), hi=highest("x"), lo=lowest("x"), prev=latest("x"), next=upcoming("x")
    )
    same(got, want, ["n", "s", "hi", "lo", "prev", "next", "rows"])


def test_halo_matches_whole_windows(df, axis):
    w = Window.partitionBy("symbol").orderBy("ts", "id")
    want = df.withColumns(
        {
            "mean": F.avg("x").over(w.rowsBetween(-4, 0)),
            "lag": F.lag("id", 3).over(w),
            "lead": F.lead("id", 2).over(w),
            "place": F.row_number().over(w),
        }
    )
    h = Halo.spread(df, axis, back=5, ahead=2)
    got = h.frame.withColumns(
        {"mean": F.avg("x").over(h.last(5)), "lag": F.lag("id", 3).over(h.w), "lead": F.lead("id", 2).over(h.w), "place": h.position()}
    )
    same(h.settle(got), want, ["mean", "lag", "lead", "place"])


def test_exact_blocks_hold_a_bounded_number_of_rows(df, axis):
    h = Halo.exact(df, axis, back=6, block=10)
    sizes = h.frame.groupBy("symbol", "_block").agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("k")).toPandas()
    assert sizes.n.max() <= 16 and (sizes.n == sizes.k).all()
    w = Window.partitionBy("symbol").orderBy("ts", "id")
    want = df.withColumn("mean", F.avg("x").over(w.rowsBetween(-5, 0)))
    same(h.settle(h.frame.withColumn("mean", F.avg("x").over(h.last(6)))), want, ["mean"])


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("span", [3, 10, 26])
def test_decayed_mean_equals_pandas(df, span, adjust, monkeypatch):
    monkeypatch.setattr(ewm, "_LARGEST", 200.0)  # several blocks even in short series
    filled = df.withColumn("v", F.coalesce("x", F.lit(1.0)))
    got = ewm.ema(filled, "v", span=span, adjust=adjust, axis=Axis(ties=("id",))).toPandas()
    for _, part in got.sort_values(["ts", "id"]).groupby("symbol"):
        want = part.v.ewm(span=span, adjust=adjust).mean()
        np.testing.assert_allclose(part.ema, want, rtol=1e-11)


def test_hot_series_is_spread_over_blocks(df):
    h = Halo.spread(df, Axis(ties=("id",), cell=3600, block=8), back=2)
    blocks = h.frame.filter("symbol = 'hot' and _core").groupBy("_block").count().toPandas()
    assert len(blocks) > 5


def test_sketched_cells_cut_a_burst(df, monkeypatch):
    monkeypatch.setattr(parts, "FAN", 3)
    # Bursts of one stamp stay together, everything else is cut evenly.
    spread = df.withColumn("ts", F.expr("ts + make_interval(0,0,0,0,0,0,id)")).filter("symbol = 'hot'")
    cells = Axis(ties=("id",), cell=None, whole=20).placed(spread).groupBy("_cell").count().toPandas()
    assert len(cells) >= 20 and cells["count"].max() <= 3 * 200 / 27


def test_global_axis(df):
    got = numbered(df, Axis(keys=(), ts="id", cell=50), "n").toPandas()
    assert (got.n == got.id + 1).all()


def test_other_time_zones_are_refused(df, spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            numbered(df, series.BARS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
