"""Caps and trade paths against row loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S

START = datetime(2024, 1, 1, 20)


def capped(rows, n, high_vol, high, gap):
    out, last, day, count = [], None, None, 0
    for symbol, ts, signal, vol in sorted(rows, key=lambda r: (r[0], r[1])):
        if day != (symbol, ts.date()):
            last = last if day and day[0] == symbol else None
            day, count = (symbol, ts.date()), 0
        limit = high_vol if vol is not None and vol > high else n
        if signal != "HOLD" and count < limit and (last is None or ts - last >= timedelta(minutes=gap)):
            out.append((symbol, ts))
            last, count = ts, count + 1
    return out


@pytest.mark.parametrize(("every", "gap", "n"), [(20, 30, 3), (7, 45, 50), (20, 300, 3), (1, 61, 40)])
def test_daily_cap(spark, every, gap, n):
    r = random.Random(every)
    rows = []
    for symbol in "ab":
        ts = START
        for _ in range(400):
            rows.append((symbol, ts, r.choice(["BUY", "SHORT", "HOLD"]), r.choice([None, 0.01, 0.01, 0.09])))
            ts += timedelta(minutes=r.randint(1, 2 * every))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, signal string, volatility double")
    got = S.daily_cap(df, n=n, min_gap_minutes=gap)
    assert got.columns == df.columns
    assert sorted((x.symbol, x.ts) for x in got.collect()) == capped(rows, n, 1, 0.05, gap)


def test_daily_cap_of_ticks(spark):
    """Very many signals of one symbol and day, doubled stamps, a series without a symbol, trades around midnight."""
    ticks = spark.range(300_000).select(
        F.when(F.col("id") % 3 > 0, "a").alias("symbol"),
        F.expr("timestamp_ntz'2024-01-01 22:00:00' + make_dt_interval(0, 0, 0, id div 30)").alias("ts"),
        F.when(F.col("id") % 7 == 0, "HOLD").when(F.col("id") % 2 == 0, "BUY").otherwise("SHORT").alias("signal"),
        F.when(F.col("id") % 11 > 0, F.lit(0.09)).alias("volatility"),
    )
    got = S.daily_cap(ticks, min_gap_minutes=17).select("symbol", "ts").collect()
    # Stamps are whole seconds with each kind of row: the first row of a second that may trade does.
    seconds = [(START.replace(hour=22) + timedelta(seconds=i), i) for i in range(10_000)]
    want = []
    for symbol in (None, "a"):
        last, day, count = None, None, 0
        for ts, i in seconds:
            if ts.date() != day:
                day, count = ts.date(), 0
            rows = [j for j in range(30 * i, 30 * i + 30) if (j % 3 > 0) == (symbol == "a") and j % 7]
            limit = 3 if any(j % 11 == 0 for j in rows) else 1
            if count < limit and (last is None or ts - last >= timedelta(minutes=17)):
                want.append((symbol, ts))
                last, count = ts, count + 1
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_daily_cap_without_gap(spark):
    """Without a gap rows with one stamp may all trade, and a day's limit is what ends it."""
    rows = [("a", START, "BUY", 0.01)] * 3 + [("a", START + timedelta(days=1), "SHORT", None)] * 5
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, signal string, volatility double")
    assert S.daily_cap(df, n=4, min_gap_minutes=0).count() == 7
    assert S.daily_cap(df.limit(0)).count() == 0


def path(bars, entry, until):
    symbol, start, side, price, atr = entry
    sign, reach = (1, 2 * atr if atr and atr > 0 else price * 0.05) if side == "LONG" else (-1, 2 * atr if atr and atr > 0 else price * 0.05)
    peak, out = price, []
    for s, ts, close, bar_atr in bars:
        if s != symbol or ts <= start:
            continue
        peak = max(peak, close) if sign > 0 else min(peak, close)
        stop, target = price - sign * reach, price + sign * 2 * reach
        if price and sign * (peak - price) / price > 0.05:
            stop = max(stop, peak * 0.99) if sign > 0 else min(stop, peak * 1.01)
        touched = "stop" if sign * (close - stop) <= 0 else "target" if sign * (close - target) >= 0 else None
        gain = (close / price - 1 if price else None) if sign > 0 else (price / close - 1 if close else None)
        held, gained = ts - start > timedelta(hours=4), gain is not None and gain > 0.03
        beyond = bool(bar_atr and bar_atr > 0 and sign * (close - price) > 2 * bar_atr)
        reason = "held" if held else "gain" if gained else "range" if beyond else None
        out.append((symbol, ts, start, touched, reason))
        if (touched if until == "touched" else reason) is not None:
            break
    return out


@pytest.mark.parametrize("until", ["touched", "reason"])
def test_overlapping_trades_keep_their_paths(spark, until):
    r = random.Random(5)
    bars, entries = [], []
    for symbol in "ab":
        ts, close = START, 100.0
        for i in range(260):
            ts += timedelta(minutes=r.choice([30, 30, 30, 1500]))
            close = 0.0 if i == 130 else max(1.0, (close or 100.0) * (1 + r.uniform(-0.02, 0.02)))
            atr = r.choice([None, 0.5, 3.0])
            bars.append((symbol, ts, close, atr))
            if r.random() < 0.15:
                entries.append((symbol, ts, r.choice(["LONG", "SHORT"]), close, atr))
        entries.append((symbol, ts, "LONG", close, 1.0))  # behind it there is no bar
        entries.append((symbol, START, "LONG", 1e9, 1e9))  # never exits by price
    b = spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, close double, atr double")
    e = spark.createDataFrame(entries, "symbol string, ts timestamp_ntz, side string, price double, atr double")
    got = S.trade_paths(b, e, until=until)
    want = [x for entry in entries for x in path(bars, entry, until)]
    key = lambda x: tuple(map(str, x))
    assert sorted([(x.symbol, x.ts, x.entry_ts, x.touched, x.reason) for x in got.collect()], key=key) == sorted(want, key=key)
    exits = S.first_exit(got, reason=until)
    ended = {(x[0], x[2], x[1]) for x in want if x[3 if until == "touched" else 4]}
    assert {(x.symbol, x.entry_ts, x.exit_ts) for x in exits.filter("exit_ts is not null").collect()} == ended


def test_paths_without_entries(spark):
    b = spark.createDataFrame([("a", START, 1.0, 1.0)], "symbol string, ts timestamp_ntz, close double, atr double")
    e = spark.createDataFrame([], "symbol string, ts timestamp_ntz, side string, price double, atr double")
    assert S.trade_paths(b, e).count() == 0


def test_kelly_by_hand(spark):
    df = spark.createDataFrame([(100.0, 0.0, 1.0), (100.0, 0.08, 0.1), (0.05, 0.0, 1.0), (None, 0.0, 1.0)], "p double, v double, c double")
    got = [x.s for x in df.select(S.kelly_shares(F.col("p"), F.col("v"), F.col("c"), max_pct=0.5).alias("s")).collect()]
    # 0.5 - 0.5 / 2 = 0.25 of 50,000; then halved for volatility and 0.7 for confidence.
    assert got == [125, 43, 0, 0]
