"""FIFO matching against a lot queue, and the literal cases of performance measures."""

import datetime as dt
from collections import deque

import numpy as np
import pytest

from tidemark.operators.ledger import equity_curve, mark_open, match_fifo, trade_stats
from tidemark.operators.performance import monthly_win_rate, performance, target_assessment, target_ratios
from tidemark.operators.signals import costs_per_share, kelly_shares

START = dt.datetime(2024, 1, 1)


def fills(n=400, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        symbol = "hot" if i % 3 == 0 else f"s{rng.integers(0, 4)}"
        action = str(rng.choice(["BUY", "SELL", "SHORT", "COVER"], p=[0.3, 0.3, 0.15, 0.25]))
        rows.append((symbol, START + dt.timedelta(minutes=int(rng.integers(0, 4000))), i, action, float(np.round(rng.uniform(1, 90), 2)), int(rng.integers(1, 40))))
    return rows


def commission(value):
    return max(value * 0.0005, 1.0)


def queue_match(rows, compat):
    """Lots in a queue per symbol and side; closes that find no lot are lost."""
    lots, pairs, left = {}, [], []
    for symbol, ts, id, action, price, shares in sorted(rows, key=lambda r: (r[1], r[2])):
        side = "LONG" if action in ("BUY", "SELL") else "SHORT"
        lot_queue = lots.setdefault((symbol, side), deque())
        if action in ("BUY", "SHORT"):
            lot_queue.append([ts, price, shares, shares])
            continue
        while shares and lot_queue:
            lot = lot_queue[0]
            m = min(lot[2], shares)
            part = m / (lot[2] if compat else lot[3])
            profit = (price - lot[1]) * m * (1 if side == "LONG" else -1) - commission(lot[1] * lot[3]) * part - commission(price * m)
            pairs.append((symbol, side, lot[0], lot[1], ts, price, m, round(profit, 6)))
            lot[2] -= m
            shares -= m
            if not lot[2]:
                lot_queue.popleft()
    for (symbol, side), lot_queue in lots.items():
        left += [(symbol, side, lot[0], lot[1], lot[2]) for lot in lot_queue]
    return pairs, left


SCHEMA = "symbol string, ts timestamp_ntz, event_id bigint, action string, price double, shares bigint"


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("seed", [9, 10])
def test_matches_a_lot_queue(spark, compat, seed):
    rows = fills(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, left = queue_match(rows, compat)
    got = match_fifo(df, compat=compat).collect()
    shown = sorted((r.symbol, r.side, r.entry_ts, r.entry_price, r.exit_ts, r.exit_price, r.shares, round(r.profit, 6)) for r in got)
    # Two pieces of one pair would differ only in shares; the queue makes none.
    assert [s[:7] for s in shown] == [s[:7] for s in sorted(pairs)]
    np.testing.assert_allclose([s[7] for s in shown], [s[7] for s in sorted(pairs)], atol=2e-6)
    last = spark.createDataFrame([(s, START + dt.timedelta(days=9), 50.0) for s in {r[0] for r in rows}], "symbol string, last_ts timestamp_ntz, last_price double")
    rest = mark_open(df, last, compat=compat).collect()
    assert sorted((r.symbol, r.side, r.entry_ts, r.entry_price, r.shares) for r in rest) == sorted(left)


def test_trade_statistics(spark):
    profits = [100.0, -50.0, 200.0, -30.0, 150.0, -20.0, 300.0]
    df = spark.createDataFrame([("a", p) for p in profits], "symbol string, profit double")
    row = trade_stats(df).first()
    assert (row.total_trades, row.winning_trades) == (7, 4) and row.win_rate == pytest.approx(4 / 7)


def curve(spark, values, days=None):
    days = days or range(len(values))
    rows = [("a", START + dt.timedelta(days=d), float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, portfolio_value double")


def test_performance_literals(spark):
    values = [50000, 55000, 52000, 48000, 51000, 67500]
    row = performance(curve(spark, values)).first()
    assert row.max_drawdown == pytest.approx((55000 - 48000) / 55000)
    assert row.total_return == pytest.approx(0.35) and row.total_days == 5
    assert row.annual_return == pytest.approx(1.35 ** (252 / 5) - 1)
    r = np.diff(values) / np.array(values[:-1])
    assert row.sharpe_ratio == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252))


def test_performance_of_flat_and_single_row_curves(spark):
    flat = performance(curve(spark, [100, 100, 100])).first()
    assert (flat.annual_return, flat.max_drawdown, flat.sharpe_ratio) == (0.0, 0.0, 0.0)
    one = performance(curve(spark, [100])).first()
    assert (one.annual_return, one.sharpe_ratio, one.total_days) == (0.0, 0.0, 0)


def test_monthly_win_rate(spark):
    row = monthly_win_rate(curve(spark, [100, 110, 110, 90, 90, 95], [0, 20, 31, 50, 60, 80])).first()
    assert (row.total_months, row.winning_months) == (3, 2)


def test_targets(spark):
    df = spark.createDataFrame([("a", 0.3456, 0.0821, 0.58), ("b", 0.1, 0.2, 0.2)], "symbol string, annual_return double, max_drawdown double, monthly_win_rate double")
    rows = {r.symbol: r for r in target_ratios(df).collect()}
    assert rows["a"].all_achieved and rows["a"].risk_tier == "low" and rows["b"].risk_tier == "high"
    assert rows["a"].annual_return_ratio == pytest.approx(1.728)
    verdict = {r.symbol: r for r in target_assessment(df).collect()}
    assert verdict["a"].feasible and (verdict["a"].targets_met, verdict["a"].missed) == (2, "monthly_win_rate")
    assert not verdict["b"].feasible and verdict["b"].score == 0


def test_equity_counts_fills_up_to_the_bar(spark):
    rows = [("a", START, 1, "BUY", 10.0, 5), ("a", START + dt.timedelta(hours=2), 2, "SELL", 12.0, 5)]
    bars = spark.createDataFrame([("a", START, 10.0), ("a", START + dt.timedelta(hours=1), 11.0), ("a", START + dt.timedelta(hours=3), 99.0)], "symbol string, ts timestamp_ntz, close double")
    got = [r.portfolio_value for r in equity_curve(spark.createDataFrame(rows, SCHEMA), bars, 1000.0).orderBy("ts").collect()]
    assert got == pytest.approx([999.0, 1004.0, 1008.0])


def test_sizing_and_costs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(100.0, 0.02, 1.0), (0.05, 0.02, 1.0), (20000.0, 0.02, 1.0), (100.0, 0.5, 0.5)], "p double, v double, c double")
    got = [r[0] for r in df.select(kelly_shares(F.col("p"), F.col("v"), F.col("c"))).collect()]
    assert got == [50, 0, 0, 43]
    cost = costs_per_share(spark.createDataFrame([(100.0, 100), (0.5, 10)], "price double, shares bigint")).collect()
    assert cost[0].total_cost == pytest.approx(1.0 + 10000 * 0.0000278 + 0.0145)
    assert cost[1].total_cost == pytest.approx(0.05 + 5 * 0.0000278 + 0.00145)
