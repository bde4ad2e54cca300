"""Trade ledgers: first-in-first-out matching, equity, margin and day trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import day, seconds_between
from tidemark.operators.signals import flat_commission
from tidemark.plans.series import Axis, Halo, highest, running, total, upcoming
from tidemark.session import stage

FILLS = Axis(ts="ts", ties=("event_id",), cell=None)


def sided(fills: DataFrame) -> DataFrame:
    """Append ``side`` (LONG for BUY/SELL, SHORT for SHORT/COVER) and ``opens``."""
    action = F.col("action")
    return fills.withColumns(
        {"side": F.when(action.isin("BUY", "SELL"), "LONG").otherwise("SHORT"), "opens": action.isin("BUY", "SHORT")}
    )


def lot_segments(fills: DataFrame, axis: Axis = FILLS, cell: float | None = None) -> DataFrame:
    """Pieces of opening fills with the closing fill that takes them (null: still open).

    Laid out along the cumulative number of shares of a side, opening fills are intervals, and so are closing
    fills once shares that found nothing to close are left out. What is left out up to a fill is the running
    maximum of closed minus opened shares. The ends of both kinds of interval, merged in order, cut the line
    into pieces that belong to one fill of each kind: the next end of that kind. So matching is a sort, not a
    join, and no lot queue is kept anywhere.
    """
    keys = list(axis.keys)
    by_side = axis.with_(keys=(*keys, "side"))
    opens, shares = F.col("opens"), F.col("shares").cast("bigint")
    # The cells are found once and kept for the second pass.
    placed = by_side.placed(sided(fills)).withColumnRenamed("_cell", "_at")
    sums = running(
        placed,
        by_side,
        cell=F.col("_at"),
        _opened=total(F.when(opens, shares).otherwise(0)),
        _closed=total(F.when(opens, 0).otherwise(shares)),
    )
    sums = stage(sums, "fills")
    ahead = F.col("_closed") - F.col("_opened")
    ahead_before = ahead + F.when(opens, shares).otherwise(-shares)
    lost = running(sums, by_side, cell=F.col("_at"), _lost=highest(ahead), _lost_before=highest(ahead_before))
    zero = F.lit(0).cast("bigint")
    matched = F.col("_closed") - F.greatest(F.col("_lost"), zero)
    matched_before = F.col("_closed") - shares - F.greatest(F.col("_lost_before"), zero)
    fill = F.struct(*axis.order, "price", shares.alias("shares"), F.col("_opened").alias("end"))
    ends = lost.filter(opens | (matched > matched_before)).select(
        *keys,
        "side",
        F.when(opens, F.col("_opened")).otherwise(matched).alias("_end"),
        F.when(opens, fill).alias("_open"),
        F.when(~opens, fill).alias("_close"),
    )
    # An end can belong to one opening and one closing fill.
    merged = ends.groupBy(*keys, "side", "_end").agg(F.max("_open").alias("_open"), F.max("_close").alias("_close"))
    merged = stage(merged, "ends")
    along = Axis(keys=(*keys, "side"), ts="_end", cell=cell)
    pieces = running(merged, along, _open=upcoming("_open"), _close=upcoming("_close"))
    h = Halo.spread(pieces, along, back=1, block=4096)
    start = F.coalesce(F.lag("_end").over(h.w), zero)
    cut = h.settle(h.frame.withColumn("_from", start)).filter("_open is not null")
    return cut.select(
        *keys, "side", F.col("_open").alias("opened"), F.col("_close").alias("closed"), F.col("_from"), (F.col("_end") - F.col("_from")).alias("shares")
    )


def _direction() -> Column:
    return F.when(F.col("side") == "LONG", 1).otherwise(-1)


def _open_commission(segments: DataFrame, compat: bool) -> DataFrame:
    """Append the part of the opening commission a piece bears: by its share of the lot, or (``compat``) of
    what was left of the lot before it."""
    whole = flat_commission(F.col("opened.price") * F.col("opened.shares"))
    if not compat:
        return segments.withColumn("_commission", whole * F.col("shares") / F.col("opened.shares"))
    left = F.col("opened.end") - F.col("_from")
    return segments.withColumn("_commission", whole * F.col("shares") / left)


def match_fifo(fills: DataFrame, axis: Axis = FILLS, compat: bool = False, segments: DataFrame | None = None) -> DataFrame:
    """Closed pairs: entry, exit, shares, profit net of both commissions, holding hours."""
    pieces = segments if segments is not None else lot_segments(fills, axis)
    pairs = _open_commission(pieces, compat).filter("closed is not null")
    move = (F.col("closed.price") - F.col("opened.price")) * F.col("shares") * _direction()
    close_commission = flat_commission(F.col("closed.price") * F.col("shares"))
    return pairs.select(
        *axis.keys,
        "side",
        F.col(f"opened.{axis.ts}").alias("entry_ts"),
        F.col("opened.price").alias("entry_price"),
        F.col(f"closed.{axis.ts}").alias("exit_ts"),
        F.col("closed.price").alias("exit_price"),
        "shares",
        (move - F.col("_commission") - close_commission).alias("profit"),
        (seconds_between(F.col(f"opened.{axis.ts}"), F.col(f"closed.{axis.ts}")) / 3600).alias("holding_hours"),
    )


def mark_open(
    fills: DataFrame, last: DataFrame, axis: Axis = FILLS, compat: bool = False, segments: DataFrame | None = None
) -> DataFrame:
    """Lots still open, valued at the last price; ``last``: (keys, last_ts, last_price).

    A lot bears the commission of its open share, or (``compat``) the whole.
    """
    pieces = segments if segments is not None else lot_segments(fills, axis)
    rest = pieces.filter("closed is null").groupBy(*axis.keys, "side", "opened").agg(F.sum("shares").alias("shares"))
    whole = flat_commission(F.col("opened.price") * F.col("opened.shares"))
    commission = whole if compat else whole * F.col("shares") / F.col("opened.shares")
    joined = rest.join(last, list(axis.keys))
    move = (F.col("last_price") - F.col("opened.price")) * F.col("shares") * _direction()
    return joined.select(
        *axis.keys,
        "side",
        F.col(f"opened.{axis.ts}").alias("entry_ts"),
        F.col("opened.price").alias("entry_price"),
        F.col("last_ts").alias("exit_ts"),
        F.col("last_price").alias("exit_price"),
        "shares",
        (move - commission).alias("profit"),
        (seconds_between(F.col(f"opened.{axis.ts}"), F.col("last_ts")) / 3600).alias("holding_hours"),
    )


def trade_stats(pairs: DataFrame, axis: Axis = FILLS) -> DataFrame:
    """Pairs, winners, win rate and total profit per series."""
    n, wins = F.count(F.lit(1)), F.count_if(F.col("profit") > 0)
    return pairs.groupBy(*axis.keys).agg(
        n.alias("total_trades"), wins.alias("winning_trades"), (wins / n).alias("win_rate"), F.sum("profit").alias("total_profit")
    )


def equity_curve(fills: DataFrame, bars: DataFrame, cash: float = 50_000.0, axis: Axis = FILLS, price: str = "close") -> DataFrame:
    """Value at each bar: cash after all fills up to it plus signed shares at the bar's price.

    Fills and bars are one ordered table with running sums; no as-of join.
    """
    action = F.col("action")
    value = F.col("price") * F.col("shares")
    pays = action.isin("BUY", "COVER")
    flow = F.when(pays, -value).otherwise(value) - flat_commission(value)
    moves = fills.select(
        *axis.keys,
        axis.ts,
        F.lit(0).alias("_order"),
        F.col(axis.ties[0]).cast("bigint").alias("_tie"),
        flow.alias("_flow"),
        F.when(pays, F.col("shares")).otherwise(-F.col("shares")).cast("bigint").alias("_shares"),
        F.lit(None).cast("double").alias("_price"),
    )
    marks = bars.select(
        *axis.keys,
        axis.ts,
        F.lit(1).alias("_order"),
        F.lit(0).cast("bigint").alias("_tie"),
        F.lit(0.0).alias("_flow"),
        F.lit(0).cast("bigint").alias("_shares"),
        F.col(price).cast("double").alias("_price"),
    )
    both = axis.with_(ties=("_order", "_tie"))
    sums = running(moves.unionByName(marks), both, _cash=total("_flow"), _position=total("_shares"))
    held = sums.filter("_order = 1")
    return held.select(
        *axis.keys,
        axis.ts,
        F.col("_position").alias("position"),
        (cash + F.col("_cash") + F.col("_position") * F.col("_price")).alias("portfolio_value"),
    )


def margin_requirement(positions: DataFrame, prices: DataFrame, rate: float = 0.25, by: tuple[str, ...] = ("account",)) -> DataFrame:
    """``rate`` of the gross value of long and short positions. ``positions``: (by..., symbol, shares)."""
    gross = F.sum(F.abs(F.col("shares") * F.col("price")))
    return positions.join(prices, ["symbol"]).groupBy(*by).agg(gross.alias("gross_value"), (gross * rate).alias("margin"))


def day_trade_check(
    pairs: DataFrame, fills: DataFrame, accounts: DataFrame, limit: int = 3, days: int = 3, minimum: float = 25_000.0, axis: Axis = FILLS
) -> DataFrame:
    """Per series and trading day: pairs opened and closed that day, their number over the last ``days``
    trading days, and whether an account below ``minimum`` exceeds ``limit``.

    The window runs over days, of which a series has as many as the calendar. ``accounts``: (keys, account_size).
    """
    keys = list(axis.keys)
    same = day(F.col("entry_ts")) == day(F.col("exit_ts"))
    per_day = pairs.filter(same).groupBy(*keys, day(F.col("exit_ts")).alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    traded = fills.select(*keys, day(F.col(axis.ts)).alias("day")).distinct()
    joined = traded.join(per_day, [*keys, "day"], "left").withColumn("day_trades", F.coalesce("_n", F.lit(0).cast("bigint")))
    over = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(days - 1), 0)
    counted = joined.withColumn("recent", F.sum("day_trades").over(over)).join(accounts, keys)
    flagged = (F.col("account_size") < minimum) & (F.col("recent") > limit)
    return counted.select(*keys, "day", "day_trades", "recent", flagged.alias("flagged"))
