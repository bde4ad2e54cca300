"""Signals, sizing, costs and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import decayed_halo, ewm_plain, forget, reach
from tidemark.functions.time import day, seconds_between
from tidemark.plans.series import BARS, Axis, latest, running
from tidemark.session import stage

HOLD, BUY, SHORT = "HOLD", "BUY", "SHORT"


def entry_signal(
    *,
    prediction: Column,
    close: Column,
    atr: Column,
    rsi: Column,
    volatility: Column,
    volume: Column,
    smoothed: Column | None = None,
    risk: float = 0.08,
    min_volume: float = 1e6,
) -> Column:
    """BUY, SHORT or HOLD for a row without an open position.

    A first rule proposes from regime, range and RSI; a second one holds in high volatility or thin volume
    and lets only outright regimes pass, so a buy proposed in the neutral regime is held. With ``smoothed``
    a range over three times the smoothed volatility halts trading.
    """
    wide = F.coalesce((atr / F.nullif(close, F.lit(0.0))) > risk, F.lit(False))
    level = F.when(F.coalesce(rsi, F.lit(0.0)) == 0, 50.0).otherwise(rsi)
    proposed = (
        F.when(wide, HOLD)
        .when((prediction == 2) | ((prediction == 1) & (level > 40) & (level < 60)), BUY)
        .when(prediction == 0, SHORT)
        .otherwise(HOLD)
    )
    quiet = (F.coalesce(volatility, F.lit(0.0)) > risk) | (F.coalesce(volume, F.lit(0)) < min_volume)
    signal = F.when((proposed == HOLD) | quiet, HOLD).when(prediction == 2, BUY).when(prediction == 0, SHORT).otherwise(HOLD)
    if smoothed is None:
        return signal
    current = F.coalesce(atr / F.nullif(close, F.lit(0.0)), smoothed)
    return F.when(current > 3 * smoothed, HOLD).otherwise(signal)


def daily_cap(
    df: DataFrame, n: int = 3, high_vol: int = 1, high: float = 0.05, min_gap_minutes: float = 30, axis: Axis = BARS
) -> DataFrame:
    """The signals that trade, in order of time: not within the gap after the last one that traded, and while fewer
    than ``n`` have traded that day, or ``high_vol`` for a signal in high volatility.

    A day has few trades, however many signals: each round finds the next trade of every series and day, the first
    signal that the state so far (last trade, number taken) lets pass, by one aggregate over stamps and limits. A trade
    shortly before midnight holds the next day back, so days whose last trade before changes are done again until none
    does. Signals with equal stamps and ties are taken in an order that follows from their content.
    """
    keys, ts = list(axis.keys), axis.ts
    limit = F.when(F.coalesce(F.col("volatility") > high, F.lit(False)), high_vol).otherwise(n)
    signals = df.filter((F.col("signal") != HOLD) & F.col(ts).isNotNull()).withColumns(
        {"_row": F.monotonically_increasing_id(), "_day": day(F.col(ts)), "_limit": limit, "_tie": F.xxhash64(*df.columns)}
    )
    signals = stage(signals, "signals")
    place = F.struct(*axis.order, "_tie", "_row")
    narrow = signals.select(*keys, "_day", "_limit", place.alias("_place"))
    ahead = signals.groupBy(*keys, "_day").agg(F.min(ts).alias("_first"))
    days = stage(ahead.withColumn("_seed", F.lit(None).cast(df.schema[ts].dataType)), "days")
    rounds, gap = max(n, high_vol), round(min_gap_minutes * 60e6)
    trades = _next_trades(narrow, days, keys, ts, rounds, gap)
    over = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ends = trades.groupBy(*keys, "_day").agg(F.max(f"_place.{ts}").alias("_last"))
        known = _of_days(days, ends, keys, "left").withColumn("_before", F.last("_last", ignorenulls=True).over(over))
        near = seconds_between(F.col("_before"), F.col("_first")) < min_gap_minutes * 60
        seeded = known.select(*keys, "_day", "_first", F.col("_seed").alias("_old"), F.when(near, F.col("_before")).alias("_seed"))
        days = stage(seeded, "days")
        again = days.filter(~F.col("_old").eqNullSafe(F.col("_seed")))
        if again.isEmpty():
            taken = trades.select(F.col("_place._row").alias("_row"))
            return signals.join(taken, "_row", "left_semi").select(*df.columns)
        trades = _of_days(trades, again.select(*keys, "_day"), keys, "left_anti").unionByName(_next_trades(narrow, again, keys, ts, rounds, gap))


def _of_days(rows: DataFrame, days: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by series (null is one) and day."""
    right = days.withColumnsRenamed({c: f"_right_{c}" for c in [*keys, "_day"]})
    same = F.col("_day") == F.col("_right__day")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return rows.join(right, same, how).drop(*[f"_right_{c}" for c in [*keys, "_day"]])


def _next_trades(narrow: DataFrame, days: DataFrame, keys: list[str], ts: str, rounds: int, gap: int) -> DataFrame:
    """The trades of ``days``, of which ``_seed`` is the last trade before, as places; a staged table for each round."""
    kind = narrow.schema["_place"].dataType
    state = days.select(*keys, "_day", F.col("_seed").alias("_last"), F.lit(None).cast(kind).alias("_after"))
    found = []
    for taken in range(rounds):
        rows = _of_days(narrow.filter(F.col("_limit") > taken), state, keys)
        waited = F.col("_last").isNull() | (F.timestamp_diff("MICROSECOND", F.col("_last"), F.col(f"_place.{ts}")) >= gap)
        later = F.col("_after").isNull() | (F.col("_place") > F.col("_after"))
        new = stage(rows.filter(waited & later).groupBy(*keys, "_day").agg(F.min("_place").alias("_place")), "trades")
        found.append(new)
        if new.isEmpty():
            break
        state = new.select(*keys, "_day", F.col(f"_place.{ts}").alias("_last"), F.col("_place").alias("_after"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def kelly_shares(
    price: Column,
    volatility: Column,
    confidence: Column,
    balance: float = 50_000.0,
    win_rate: float = 0.5,
    payoff: float = 2.0,
    max_pct: float = 0.1,
) -> Column:
    """Whole shares for the Kelly fraction ``p - (1 - p) / payoff``, where ``payoff`` is the mean win over the mean loss.

    The fraction falls with volatility, to half at 5% and more, and with confidence, to 0.7 at the least; between 1% and
    ``max_pct`` of the balance are staked. Prices outside 0.1..10,000 get no shares.
    """
    edge = win_rate - (1 - win_rate) / payoff
    calm = F.greatest(1 - 10 * volatility, F.lit(0.5))
    sure = F.greatest(confidence, F.lit(0.7))
    stake = F.greatest(F.least(edge * calm * sure, F.lit(max_pct)), F.lit(0.01))
    tradable = (price > 0.1) & (price < 10_000)
    return F.coalesce(F.when(tradable, F.floor(balance * stake / price)), F.lit(0)).cast("bigint")


def confidence_of(prediction: Column) -> Column:
    return F.when(prediction == 2, 1.0).when(prediction == 1, 0.8).otherwise(0.6)


def smoothed_volatility(df: DataFrame, name: str = "smoothed", alpha: float = 0.3, start: float = 0.02, axis: Axis = BARS) -> DataFrame:
    """0.7 x before + 0.3 x (atr / price within 0.01..0.5), from 0.02; rows without a range or with a price
    near 0 keep the value before."""
    usable = F.col("atr").isNotNull() & (F.col("close") >= 1e-3)
    known = df.filter(usable).select(*axis.id, F.greatest(F.least(F.col("atr") / F.col("close"), F.lit(0.5)), F.lit(0.01)).alias("_x"))
    h = decayed_halo(known, [alpha], reach(alpha), axis)
    first_block = F.col("_rn") == F.col("_k")
    value = ewm_plain(h, F.col("_x"), alpha) + F.when(first_block, start * forget(alpha, F.col("_k"))).otherwise(0.0)
    smooth = h.settle(h.frame.withColumn("_y", value)).select(*axis.id, "_y")
    filled = running(df.join(smooth, axis.id, "left"), axis, _last=latest("_y"))
    return filled.withColumn(name, F.coalesce(F.col("_last"), F.lit(start))).drop("_y", "_last")


# Mean slippage by volatility, flat commission.
SLIPPAGE, SLIPPAGE_HIGH, SLIPPAGE_UNKNOWN = 0.0003, 0.0012, 0.001
COMMISSION, MIN_COMMISSION = 0.0005, 1.0


def flat_commission(value: Column) -> Column:
    return F.greatest(value * COMMISSION, F.lit(MIN_COMMISSION))


def slippage_rate(price: Column, volatility: Column, fallback: float = 0.02) -> Column:
    """Mean slippage: higher when volatility exceeds 5%; a missing price gets the default rate."""
    v = F.when(volatility > 0, volatility).otherwise(fallback)
    return F.when(price.isNull() | (price <= 0), SLIPPAGE_UNKNOWN).when(v > 0.05, SLIPPAGE_HIGH).otherwise(SLIPPAGE)


def costs_flat(df: DataFrame, action: str = "action", price: str = "price", shares: str = "shares", volatility: str = "volatility") -> DataFrame:
    """Append executed price, commission and slippage cost; buying slips up, selling down."""
    rate = slippage_rate(F.col(price), F.col(volatility))
    sign = F.when(F.col(action).isin("BUY", "COVER"), 1).otherwise(-1)
    out = df.withColumn("executed_price", F.col(price) * (1 + sign * rate))
    value = F.col("executed_price") * F.col(shares)
    return out.withColumns({"commission": flat_commission(value), "slippage_cost": value * rate})


# Per-share commission with its limits, fees, and mean slippage by order type.
PER_SHARE, PER_ORDER_MIN, MAX_SHARE_OF_VALUE = 0.005, 1.0, 0.01
SEC_FEE, ACTIVITY_FEE, ACTIVITY_FEE_MAX = 0.0000278, 0.000145, 8.30
ORDER_SLIPPAGE = {"market_order": 0.0008, "limit_order": 0.0002}


def costs_per_share(df: DataFrame, price: str = "price", shares: str = "shares", order_type: str = "market_order") -> DataFrame:
    """Append commission per share with regulatory fees, and the slippage rate with its size impact."""
    n, value = F.col(shares), F.col(shares) * F.col(price)
    commission = F.least(F.greatest(n * PER_SHARE, F.lit(PER_ORDER_MIN)), value * MAX_SHARE_OF_VALUE)
    fees = value * SEC_FEE + F.least(n * ACTIVITY_FEE, F.lit(ACTIVITY_FEE_MAX))
    impact = F.least(n / F.lit(10_000.0), F.lit(0.001))
    return df.withColumns({"total_cost": commission + fees, "slippage_rate": F.abs(F.lit(ORDER_SLIPPAGE[order_type]) + impact)})


def cost_totals(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    return df.groupBy(*axis.keys).agg(F.sum("commission").alias("total_commission"), F.sum("slippage_cost").alias("total_slippage"))


# Open trades and exits ----------------------------------------------------------------------------------


def with_open_trade(bars: DataFrame, entries: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Each bar with the newest entry before it: entry_ts, entry_price, side, entry_atr.

    As-of by one union and a carried value. For the whole path of trades that may overlap see ``trade_paths``.
    ``entries``: (keys, ts, side, price, atr).
    """
    lot = F.struct(
        F.col(axis.ts).alias("entry_ts"), F.col("price").alias("entry_price"), F.col("side"), F.col("atr").alias("entry_atr")
    )
    opened = entries.select(*axis.keys, axis.ts, F.lit(1).alias("_order"), lot.alias("_lot"))
    both = bars.withColumn("_order", F.lit(0)).unionByName(opened, allowMissingColumns=True)
    at = axis.with_(ties=("_order",))
    # An entry sorts behind the bar of its own stamp, so a trade starts with the next bar.
    carried = running(both, at, _open=latest("_lot")).filter("_order = 0 and _open is not null")
    return carried.select(*bars.columns, "_open.*")


def gain_of(side: Column, entry: Column, price: Column) -> Column:
    """Gain as a share, positive when the trade earns; null where it would divide by a zero price."""
    zero = F.lit(0.0)
    return F.when(side == "LONG", price / F.nullif(entry, zero) - 1).otherwise(entry / F.nullif(price, zero) - 1)


def _levels(df: DataFrame, price: str) -> DataFrame:
    """Stop, target and what a bar touches, from the extremes ``_high`` and ``_low`` since the entry."""
    entry, atr, long = F.col("entry_price"), F.col("entry_atr"), F.col("side") == "LONG"
    zero = F.lit(0.0)
    reach_ = F.when(atr > 0, 2 * atr).otherwise(entry * 0.05)
    first_stop = F.when(long, entry - reach_).otherwise(entry + reach_)
    target = F.when(long, entry + 2 * reach_).otherwise(entry - 2 * reach_)
    peak = F.when(long, F.greatest(F.col("_high"), entry)).otherwise(F.least(F.col("_low"), entry))
    earned = F.when(long, (peak - entry) / F.nullif(entry, zero)).otherwise((entry - peak) / F.nullif(entry, zero))
    trailing = F.when(long, F.greatest(first_stop, peak * 0.99)).otherwise(F.least(first_stop, peak * 1.01))
    out = df.withColumns({"stop": F.when(earned > 0.05, trailing).otherwise(first_stop), "target": target})
    p = F.col(price)
    hit_stop = F.when(long, p <= F.col("stop")).otherwise(p >= F.col("stop"))
    hit_target = F.when(long, p >= F.col("target")).otherwise(p <= F.col("target"))
    return out.withColumn("touched", F.when(hit_stop, "stop").when(hit_target, "target"))


def trade_paths(bars: DataFrame, entries: DataFrame, axis: Axis = BARS, price: str = "close", until: str = "touched") -> DataFrame:
    """Each bar of each trade, from the first one after its entry to the first one with an exit: entry columns, stop,
    target, ``touched`` (levels) and held, gained, beyond, ``reason`` (rules, where ``bars`` have ``atr``).

    ``entries``: (keys, ts, side, price, atr). Trades may overlap, each keeps its own path; one that never exits goes
    on to the last bar. The stop starts two ranges (5% without one) from the entry and the target twice that risk
    away; once the best price has earned 5%, the stop trails it by 1%. ``until``: ``touched`` or ``reason``.

    Open trades meet the bars of the next cell of their series, those left the next four cells, then sixteen, and
    so on: the work is that of the paths themselves.
    """
    keys, trade = list(axis.keys), ["entry_ts", "entry_price", "side", "entry_atr", "_trade"]
    placed = axis.placed(bars)
    over = Window.partitionBy(*keys).orderBy("_cell")
    cells = stage(placed.select(*keys, "_cell").distinct().withColumn("_at", F.row_number().over(over)), "cells")
    rows = stage(placed.join(cells, [*keys, "_cell"]), "bars")
    opened = entries.select(*keys, axis.ts, F.col("price").alias("entry_price"), "side", F.col("atr").alias("entry_atr"))
    first = axis.placed(opened).withColumn("_trade", F.monotonically_increasing_id())
    # The first cell that can hold a bar after the entry: its own or the next one there is.
    begins = cells.select(*keys, "_cell", F.col("_at")).unionByName(first.select(*keys, "_cell").distinct(), allowMissingColumns=True)
    begins = begins.groupBy(*keys, "_cell").agg(F.max("_at").alias("_at"))
    back = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(0, Window.unboundedFollowing)
    begins = begins.withColumn("_at", F.first("_at", ignorenulls=True).over(back)).filter("_at is not null")
    number = F.lit(None).cast(bars.schema[price].dataType)
    todo = first.join(begins, [*keys, "_cell"]).select(*keys, F.col(axis.ts).alias("entry_ts"), *trade[1:], "_at", number.alias("_best"), number.alias("_worst"))
    todo, span, parts = stage(todo, "trades"), 1, []
    at = Window.partitionBy("_trade").orderBy(*axis.order)
    while not todo.isEmpty():
        reach_ = todo.withColumn("_from", F.col("_at")).withColumn("_at", F.explode(F.sequence(F.col("_at"), F.col("_at") + span - 1)))
        pairs = rows.join(reach_, [*keys, "_at"]).filter(F.col(axis.ts) > F.col("entry_ts"))
        so_far = at.rowsBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("_high", F.greatest(F.max(price).over(so_far), F.col("_best"))).withColumn("_low", F.least(F.min(price).over(so_far), F.col("_worst")))
        pairs = _levels(pairs, price)
        if "atr" in bars.columns:
            pairs = exit_signal_columns(pairs, axis, price)
        ended = F.coalesce(F.max(F.col(until).isNotNull()).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        part = stage(pairs.withColumn("_ended", ended).filter("not _ended"), "paths")
        parts.append(part)
        state = part.groupBy("_trade").agg(F.max("_high").alias("_h"), F.min("_low").alias("_l"), F.max(F.col(until).isNotNull()).alias("_done"))
        ends = cells.groupBy(*keys).agg(F.max("_at").alias("_end"))
        left = todo.join(state, "_trade", "left").filter("not coalesce(_done, false)").join(ends, keys)
        left = left.withColumns({"_at": F.col("_at") + span, "_best": F.coalesce("_h", "_best"), "_worst": F.coalesce("_l", "_worst")})
        todo, span = stage(left.filter("_at <= _end").select(*todo.columns), "trades"), span * 4
    named = [*bars.columns, *trade[:4], "stop", "target", "touched", *(["held", "gained", "beyond", "reason"] if "atr" in bars.columns else [])]
    if not parts:
        empty = _levels(rows.join(todo, [*keys, "_at"]).withColumns({"_high": F.col("_best"), "_low": F.col("_worst")}), price)
        return (exit_signal_columns(empty, axis, price) if "atr" in bars.columns else empty).select(*named)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*named)


def first_exit(levels: DataFrame, axis: Axis = BARS, reason: str = "touched", price: str = "close") -> DataFrame:
    """The first row of each trade with a ``reason``; one row per trade and task is shuffled."""
    hit = F.when(F.col(reason).isNotNull(), F.col(axis.ts))
    exits = levels.groupBy(*axis.keys, "entry_ts", "side", "entry_price").agg(
        F.min(hit).alias("exit_ts"), F.min_by(F.struct(F.col(price).alias("exit_price"), F.col(reason).alias("reason")), hit).alias("_x")
    )
    return exits.select(*axis.keys, "entry_ts", "side", "entry_price", "exit_ts", "_x.*")


def exit_signal_columns(paths: DataFrame, axis: Axis = BARS, price: str = "close") -> DataFrame:
    """Append the three exit rules and the first that holds: held over 4 hours, gain over 3%, move over two
    ranges."""
    long, entry, p, atr = F.col("side") == "LONG", F.col("entry_price"), F.col(price), F.col("atr")
    held = seconds_between(F.col("entry_ts"), F.col(axis.ts)) > 4 * 3600
    gained = gain_of(F.col("side"), entry, F.nullif(p, F.lit(0.0))) > 0.03
    move = F.when(long, p - entry).otherwise(entry - p)
    beyond = F.coalesce((atr > 0) & (move > 2 * atr), F.lit(False))
    gained = F.coalesce(gained, F.lit(False))
    reason = F.when(held, "held").when(gained, "gain").when(beyond, "range")
    return paths.withColumns({"held": held, "gained": gained, "beyond": beyond, "reason": reason})
