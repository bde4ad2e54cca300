"""Indicators and regime labels on bars.

Bounded frames run in blocks with copied edges, decayed means as running sums in exact blocks, cumulative
values with per-cell carries; see ``tidemark.plans.series``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ewm import Rate, decayed_halo, ewm_from, ewm_mean, rate, rate_columns, reach, span_alpha
from tidemark.plans.parts import join_stats
from tidemark.plans.series import BARS, Axis, Halo, numbered, row_count, running, total

TINY = 1e-10


def _or_tiny(x: Column) -> Column:
    return F.when(x == 0, TINY).otherwise(x)


def _delta(h: Halo, column: str = "close") -> Column:
    return F.col(column) - F.lag(column).over(h.w)


def gains(delta: Column) -> Column:
    return F.when(delta > 0, delta).otherwise(0.0)


def losses(delta: Column) -> Column:
    return F.when(delta < 0, -delta).otherwise(0.0)


def relative_strength(gain: Column, loss: Column) -> Column:
    return F.least(F.greatest(100 - 100 / (1 + gain / _or_tiny(loss)), F.lit(0.0)), F.lit(100.0))


def rsi(df: DataFrame, n: int = 14, name: str = "rsi", axis: Axis = BARS) -> DataFrame:
    """Relative strength from plain means over up to ``n`` rows, within 0..100."""
    h = Halo.spread(df, axis, back=n)
    frame = h.frame.withColumn("_d", _delta(h))
    gain, loss = F.avg(gains(F.col("_d"))).over(h.last(n)), F.avg(losses(F.col("_d"))).over(h.last(n))
    return h.settle(frame.withColumn(name, relative_strength(gain, loss)), "_d")


def rsi_strict(df: DataFrame, n: int = 14, name: str = "rsi", axis: Axis = BARS) -> DataFrame:
    """As ``rsi`` but 50 before ``n`` rows are there or when nothing moved, 100 when nothing fell."""
    h = Halo.spread(df, axis, back=n)
    frame = h.frame.withColumn("_d", _delta(h))
    gain, loss = F.avg(gains(F.col("_d"))).over(h.last(n)), F.avg(losses(F.col("_d"))).over(h.last(n))
    full = F.count(F.lit(1)).over(h.last(n)) >= n
    frame = frame.withColumns({"_g": gain, "_l": loss, "_full": full})
    value = (
        F.when(~F.col("_full") | ((F.col("_g") == 0) & (F.col("_l") == 0)), 50.0)
        .when(F.col("_l") == 0, 100.0)
        .otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    )
    return h.settle(frame.withColumn(name, value), "_d", "_g", "_l", "_full")


def rsi_fast(df: DataFrame, n: int = 7, name: str = "rsi", axis: Axis = BARS) -> DataFrame:
    """The short RSI of realtime features."""
    return rsi(df, n, name, axis)


def _macd(h: Halo, frame: DataFrame, rates: Sequence[float | Rate], name: str) -> DataFrame:
    """``rates``: fast, slow, signal."""
    x = F.col("close").cast("double")
    fast, slow, signal = rates
    line = ewm_mean(h, x, fast, adjust=False) - ewm_mean(h, x, slow, adjust=False)
    frame = frame.withColumn(f"_line_{name}", line)
    hist = F.col(f"_line_{name}") - ewm_mean(h, F.col(f"_line_{name}"), signal, adjust=False)
    return frame.withColumn(name, hist).drop(f"_line_{name}")


def _macd_halo(df: DataFrame, params: list[tuple[int, int, int]], axis: Axis) -> Halo:
    alphas = [span_alpha(s) for p in params for s in p]
    back = max(reach(span_alpha(max(p[:2]))) + reach(span_alpha(p[2])) for p in params)
    return decayed_halo(df, alphas, back, axis)


def macd_hist(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd_hist", axis: Axis = BARS) -> DataFrame:
    """EMA(fast) - EMA(slow), minus its own EMA(signal)."""
    h = _macd_halo(df, [(fast, slow, signal)], axis)
    return h.settle(_macd(h, h.frame, [span_alpha(s) for s in (fast, slow, signal)], name))


# MACD spans and true-range window per volatility level.
MACD_PARAMS = {"high": (8, 17, 7), "medium": (12, 26, 9), "low": (15, 30, 12)}
ATR_WINDOWS = {"high": 10, "medium": 14, "low": 20}


def level_of(volatility: Column) -> Column:
    return F.when(volatility > 0.02, "high").when(volatility > 0.01, "medium").otherwise("low")


def _returns(df: DataFrame, axis: Axis) -> DataFrame:
    h = Halo.spread(df, axis, back=1)
    change = F.col("close") / F.nullif(F.lag("close").over(h.w), F.lit(0.0)) - 1
    return h.settle(h.frame.withColumn("_ret", change))


def volatility_level(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """One row per series: the deviation of its returns, the last one left out, as high, medium or low.

    Sums are combined on the map side; the newest return is subtracted from them.
    """
    rows = _returns(df.select(*axis.id, "close"), axis)
    newest = F.max_by("_ret", axis.order_key())
    stats = rows.groupBy(*axis.keys).agg(
        F.count("_ret").alias("_n"), F.avg("_ret").alias("_m"), F.var_pop("_ret").alias("_v"), newest.alias("_x")
    )
    n, m, v, x = F.col("_n"), F.col("_m"), F.col("_v"), F.col("_x")
    # Removing x from n values: the sum of squares falls by (x - m)^2 * n / (n - 1).
    squares = F.greatest(v * n - (x - m) * (x - m) * n / (n - 1), F.lit(0.0))
    volatility = F.when(n - 1 >= 30, F.sqrt(squares / (n - 2)))
    return stats.select(*axis.keys, volatility.alias("volatility"), level_of(volatility).alias("level"))


def volatility_level_asof(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Append ``level`` per row from the returns before that row only (at least 30 of them)."""
    r = F.col("_ret")
    sums = running(_returns(df, axis), axis, _n=total(r.isNotNull().cast("bigint")), _s=total(r), _q=total(r * r))
    n, s, q = (F.col(c) - F.coalesce(v, F.lit(0)) for c, v in (("_n", r.isNotNull().cast("bigint")), ("_s", r), ("_q", r * r)))
    volatility = F.when(n >= 30, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
    return sums.withColumns({"volatility": volatility, "level": level_of(volatility)}).drop("_ret", "_n", "_s", "_q")


def _leveled(df: DataFrame, axis: Axis) -> DataFrame:
    """Numbered rows with the level of their series; numbering first keeps the level out of its count pass."""
    levels = volatility_level(df, axis).drop("volatility")
    return join_stats(numbered(df, axis, "_rn", size="_rows"), levels, axis.keys)


def macd_dynamic(
    df: DataFrame,
    params: Mapping[str, tuple[int, int, int]] = MACD_PARAMS,
    name: str = "macd_hist",
    axis: Axis = BARS,
    level: str = "last",
) -> DataFrame:
    """MACD histogram with the spans of the series' volatility level (``last``) or of the row's (``asof``)."""
    if level == "last":
        h = _macd_halo(_leveled(df, axis), list(params.values()), axis)
        frame = h.frame.withColumns(_macd_rates(params))
        return h.settle(_macd(h, frame, [rate(n) for n in _RATES], name), "level", *_macd_rates(params))
    h = _macd_halo(volatility_level_asof(df, axis).drop("volatility"), list(params.values()), axis)
    frame = h.frame
    for key, spans in params.items():
        frame = _macd(h, frame, [span_alpha(s) for s in spans], f"_hist_{key}")
    return h.settle(frame.withColumn(name, pick_level(params, "_hist_")), "level", *[f"_hist_{k}" for k in params])


_RATES = ("_fast", "_slow", "_signal")


def by_level(values: Mapping[str, float]) -> Column:
    """The value for the row's ``level``."""
    out = F.lit(None).cast("double")
    for key, value in values.items():
        out = F.when(F.col("level") == key, float(value)).otherwise(out)
    return out


def _macd_rates(params: Mapping[str, tuple[int, int, int]]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for i, name in enumerate(_RATES):
        out |= rate_columns(name, {k: span_alpha(p[i]) for k, p in params.items()}, by_level)
    return out


def pick_level(params: Mapping[str, object], prefix: str) -> Column:
    value = F.lit(None).cast("double")
    for key in params:
        value = F.when(F.col("level") == key, F.col(f"{prefix}{key}")).otherwise(value)
    return value


def macd_fast(df: DataFrame, fast: int = 8, slow: int = 17, name: str = "macd_hist", axis: Axis = BARS) -> DataFrame:
    """EMA(fast) - EMA(slow) with normalised weights, without a signal line."""
    alphas = [span_alpha(fast), span_alpha(slow)]
    h = decayed_halo(df, alphas, max(map(reach, alphas)), axis)
    x = F.col("close").cast("double")
    return h.settle(h.frame.withColumn(name, ewm_mean(h, x, alphas[0]) - ewm_mean(h, x, alphas[1])))


def true_range_of(previous_close: Column) -> Column:
    """Widest of the bar and its reach to the close before (``greatest`` skips the null of the first row)."""
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def true_range(df: DataFrame, name: str = "tr", axis: Axis = BARS) -> DataFrame:
    h = Halo.spread(df, axis, back=1)
    return h.settle(h.frame.withColumn(name, true_range_of(F.lag("close").over(h.w))))


def atr_sma(df: DataFrame, n: int = 14, min_rows: int = 14, name: str = "atr", axis: Axis = BARS) -> DataFrame:
    """Mean true range over ``n`` rows, null before ``min_rows`` of them."""
    h = Halo.spread(df, axis, back=n)
    frame = h.frame.withColumn("_tr", true_range_of(F.lag("close").over(h.w)))
    mean = F.when(F.count("_tr").over(h.last(n)) >= min_rows, F.avg("_tr").over(h.last(n)))
    return h.settle(frame.withColumn(name, mean), "_tr")


def _wilder(h: Halo, tr: str, n: int | Column, weight: float | Rate) -> Column:
    """Needs ``_mean_tr``, the mean of the ranges of the block so far, which on row n is the mean of the
    first n ranges. Earlier rows give 0. ``weight`` is 1 / n."""
    rn = F.col("_rn")
    x = F.when(rn < n, 0.0).when(rn == n, F.col("_mean_tr")).otherwise(F.col(tr))
    return ewm_from(h, x, weight, (rn == n) | ((F.col("_k") == 1) & (rn > n)))


def atr_wilder(df: DataFrame, n: int = 14, name: str = "atr", axis: Axis = BARS) -> DataFrame:
    """Wilder's average range: the mean of the first ``n`` ranges, then (before * (n-1) + range) / n;
    0 before row ``n``."""
    h = decayed_halo(df, [1.0 / n], reach(1.0 / n), axis)
    frame = h.frame.withColumn("_tr", true_range_of(F.lag("close").over(h.w)))
    frame = frame.withColumn("_mean_tr", F.avg("_tr").over(h.so_far))
    return h.settle(frame.withColumn(name, _wilder(h, "_tr", n, 1.0 / n)), "_tr", "_mean_tr")


def adx(df: DataFrame, n: int = 14, name: str = "adx", axis: Axis = BARS) -> DataFrame:
    """Average directional index with decayed means of weight 1/n."""
    alpha = 1.0 / n
    h = decayed_halo(df, [alpha], 2 * reach(alpha), axis)
    return h.settle(_adx(h, h.frame, n, name))


def _adx(h: Halo, frame: DataFrame, n: int, name: str) -> DataFrame:
    alpha = 1.0 / n
    up, down = F.col("high") - F.lag("high").over(h.w), F.lag("low").over(h.w) - F.col("low")
    frame = frame.withColumns({"_up": up, "_down": down, "_adx_tr": true_range_of(F.lag("close").over(h.w))})
    up, down = F.col("_up"), F.col("_down")
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
    ranges = F.nullif(ewm_mean(h, F.col("_adx_tr"), alpha), F.lit(0.0))
    frame = frame.withColumns(
        {"_plus": 100 * ewm_mean(h, plus, alpha) / ranges, "_minus": 100 * ewm_mean(h, minus, alpha) / ranges}
    )
    plus, minus = F.col("_plus"), F.col("_minus")
    frame = frame.withColumn("_dx", 100 * F.abs(plus - minus) / _or_tiny(plus + minus))
    value = F.coalesce(ewm_mean(h, F.col("_dx"), alpha), F.lit(0.0))
    return frame.withColumn(name, value).drop("_up", "_down", "_adx_tr", "_plus", "_minus", "_dx")


def bb_width(df: DataFrame, n: int = 20, deviations: float = 2.0, name: str = "bb_width", axis: Axis = BARS) -> DataFrame:
    """Width of the Bollinger band (population deviation) relative to close, null before ``n`` rows."""
    h = Halo.spread(df, axis, back=n)
    return h.settle(h.frame.withColumn(name, _bb_width(h, n, deviations)))


def _bb_width(h: Halo, n: int = 20, deviations: float = 2.0) -> Column:
    width = 2 * deviations * F.stddev_pop("close").over(h.last(n)) / F.nullif(F.col("close"), F.lit(0.0))
    return F.when(F.count("close").over(h.last(n)) >= n, width)


def vwap(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Append the cumulative volume-weighted price ``vwap`` and the relative distance ``vwap_gap`` to it."""
    sums = running(df, axis, _pv=total(F.col("close") * F.col("volume")), _v=total("volume"))
    price = F.col("_pv") / _or_tiny(F.col("_v").cast("double"))
    return sums.withColumn("vwap", price).withColumn("vwap_gap", (F.col("close") - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0))).drop("_pv", "_v")


def volume_ma_ratio(df: DataFrame, n: int = 5, min_rows: int = 5, name: str = "volume_ma_ratio", axis: Axis = BARS) -> DataFrame:
    h = Halo.spread(df, axis, back=n)
    return h.settle(h.frame.withColumn(name, _volume_ma_ratio(h, n, min_rows)))


def _volume_ma_ratio(h: Halo, n: int, min_rows: int) -> Column:
    mean = F.avg("volume").over(h.last(n))
    return F.when(F.count("volume").over(h.last(n)) >= min_rows, F.col("volume") / _or_tiny(mean))


def rolling_slope(df: DataFrame, n: int, column: str = "close", name: str = "slope", axis: Axis = BARS) -> DataFrame:
    """Least-squares slope of the last ``n`` values against 0..n-1, null before ``n`` rows."""
    h = Halo.spread(df, axis, back=n)
    return h.settle(h.frame.withColumn(name, _slope(h, n, column)))


def _slope(h: Halo, n: int, column: str) -> Column:
    centre = (n - 1) / 2.0
    spread = n * (n * n - 1) / 12.0
    lags = [F.lag(column, n - 1 - i).over(h.w) * (i - centre) for i in range(n)]
    return sum(lags[1:], lags[0]) / spread


def _market_state(h: Halo, frame: DataFrame, name: str) -> DataFrame:
    """Needs ``level`` on the row."""
    if "_tr" not in frame.columns:
        frame = frame.withColumn("_tr", true_range_of(F.lag("close").over(h.w)))
    rates = rate_columns("_wilder", {k: 1.0 / n for k, n in ATR_WINDOWS.items()}, by_level)
    frame = frame.withColumns({"_mean_tr": F.avg("_tr").over(h.so_far), "_n": by_level(ATR_WINDOWS), **rates})
    frame = frame.withColumns(
        {
            "_atr": _wilder(h, "_tr", F.col("_n"), rate("_wilder")),
            "_m5": F.avg("close").over(h.w.rowsBetween(-5, -1)),
            "_m20": F.avg("close").over(h.w.rowsBetween(-20, -1)),
        }
    )
    before = h.w.rowsBetween(-30, -1)
    frame = frame.withColumns(
        {
            "_band": F.when(F.col("_rn") > 30, F.avg("_atr").over(before) * 0.3),
            "_slope": _slope(h, 5, "_m5"),
        }
    )
    frame = frame.withColumn("_slope", F.lag("_slope").over(h.w))
    up = (F.col("_m5") > F.col("_m20") + F.col("_band")) & (F.col("_slope") > 0.05)
    down = (F.col("_m5") < F.col("_m20") - F.col("_band")) & (F.col("_slope") < -0.05)
    helpers = [*rates, "_tr", "_mean_tr", "_n", "_atr", "_m5", "_m20", "_band", "_slope"]
    return frame.withColumn(name, F.when(up, 2).when(down, 0).otherwise(1)).drop(*helpers)


def _state_alphas() -> list[float]:
    return [1.0 / n for n in ATR_WINDOWS.values()]


def market_state(df: DataFrame, name: str = "market_state", axis: Axis = BARS) -> DataFrame:
    """Regime 2 (up), 0 (down) or 1: short mean beyond the long one by 0.3 mean ranges, slope agreeing.

    All inputs are shifted back, so a row's label uses earlier rows only (but for the series' level).
    """
    alphas = _state_alphas()
    h = decayed_halo(_leveled(df, axis), alphas, max(map(reach, alphas)) + 40, axis)
    return h.settle(_market_state(h, h.frame, name), "level")


def simple_state(short: Column, long: Column) -> Column:
    return F.when(short > long * 1.002, 2).when(short < long * 0.998, 0).otherwise(1)


def market_state_simple(df: DataFrame, name: str = "market_state", axis: Axis = BARS) -> DataFrame:
    """Regime from the means of 5 and 20 rows, 0.2% apart."""
    h = Halo.spread(df, axis, back=20)
    frame = h.frame.withColumns({"_s": F.avg("close").over(h.last(5)), "_l": F.avg("close").over(h.last(20))})
    return h.settle(frame.withColumn(name, simple_state(F.col("_s"), F.col("_l"))), "_s", "_l")


def relative_changes(df: DataFrame, changes: Mapping[str, tuple[str, int]], axis: Axis = BARS) -> DataFrame:
    """Append relative changes ``name: (column, rows)`` in one pass; a change from 0 is null."""
    h = Halo.spread(df, axis, back=max(k for _, k in changes.values()))
    cols = {
        name: F.col(c) / F.nullif(F.lag(c, k).over(h.w).cast("double"), F.lit(0.0)) - 1 for name, (c, k) in changes.items()
    }
    return h.settle(h.frame.withColumns(cols))


def rolling_volatility(df: DataFrame, n: int, min_rows: int, whole: int = 0, name: str = "volatility", axis: Axis = BARS) -> DataFrame:
    """Deviation of the last ``n`` returns, null before ``min_rows`` of them and for series that have
    fewer than ``whole`` in all."""
    h = Halo.spread(df, axis, back=n + 1)
    change = F.col("close") / F.nullif(F.lag("close").over(h.w), F.lit(0.0)) - 1
    frame = h.frame.withColumn("_ret", change)
    spread = F.when(F.count("_ret").over(h.last(n)) >= max(min_rows, 2), F.stddev_samp("_ret").over(h.last(n)))
    out = h.settle(frame.withColumn(name, spread), *([] if whole else ["_ret"]))
    if whole:
        counts = out.groupBy(*axis.keys).agg(F.count("_ret").alias("_n"))
        out = join_stats(out, counts, axis.keys).withColumn(name, F.when(F.col("_n") >= whole, F.col(name))).drop("_ret", "_n")
    return out


def rolling_pct_rank(df: DataFrame, column: str, n: int = 50, name: str = "pct_rank", axis: Axis = BARS) -> DataFrame:
    """Average rank of the last value among the last ``n``, as a share; null unless all are known."""
    h = Halo.spread(df, axis, back=n)
    frame = h.frame.withColumn("_values", F.collect_list(column).over(h.last(n)))
    x = F.col(column)
    below = F.size(F.filter("_values", lambda v: v < x))
    same = F.size(F.filter("_values", lambda v: v == x))
    rank = (below + (same + 1) / 2) / F.lit(float(n))
    return h.settle(frame.withColumn(name, F.when((F.size("_values") == n) & x.isNotNull(), rank)), "_values")


def volume_osc(df: DataFrame, n: int = 20, name: str = "volume_osc", axis: Axis = BARS) -> DataFrame:
    """Rolling z-score of volume; a deviation of 0 counts as 1, a missing value is 0."""
    h = Halo.spread(df, axis, back=n)
    mean, spread = F.avg("volume").over(h.last(n)), F.stddev_samp("volume").over(h.last(n))
    frame = h.frame.withColumns({"_m": mean, "_s": F.when(spread == 0, 1.0).otherwise(spread)})
    return h.settle(frame.withColumn(name, F.coalesce((F.col("volume") - F.col("_m")) / F.col("_s"), F.lit(0.0))), "_m", "_s")


def threshold_flags(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Flags adx > 25, rsi > 70, rsi < 30, and atr relative to the mean close of 20 rows (at least 5)."""
    h = Halo.spread(df, axis, back=20)
    mean = F.when(F.count("close").over(h.last(20)) >= 5, F.avg("close").over(h.last(20)))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    frame = h.frame.withColumns(
        {
            "adx_above_25": flag(F.col("adx") > 25),
            "rsi_overbought": flag(F.col("rsi") > 70),
            "rsi_oversold": flag(F.col("rsi") < 30),
            "atr_ratio": F.col("atr") / F.nullif(mean, F.lit(0.0)),
        }
    )
    return h.settle(frame)


def trend_strength(df: DataFrame, n: int = 14, name: str = "trend_strength", axis: Axis = BARS) -> DataFrame:
    """Distance of the half-window mean from the window mean, relative; 0.5 before ``n`` rows."""
    h = Halo.spread(df, axis, back=n)
    short, long = F.avg("close").over(h.last(n // 2)), F.avg("close").over(h.last(n))
    full = F.count("close").over(h.last(n)) >= n
    frame = h.frame.withColumns({"_s": short, "_l": long, "_full": full})
    value = F.when(F.col("_full"), F.abs(F.col("_s") - F.col("_l")) / F.nullif(F.col("_l"), F.lit(0.0)))
    return h.settle(frame.withColumn(name, F.coalesce(value, F.lit(0.5))), "_s", "_l", "_full")


BASE_FEATURES = ("rsi", "atr", "bb_width", "macd_hist", "vwap_gap", "volume_ma_ratio", "adx", "ema_short")


def base_features(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """All base features and the regime label of complete bars, in one numbering and one blocked pass.

    Numbering and the cumulative price share their cells; every other feature shares the blocks, so
    Spark sorts each block once.
    """
    prefixes = {"_rn": row_count(), "_pv": total(F.col("close") * F.col("volume")), "_v": total("volume")}
    rows = running(df, axis, size="_rows", **prefixes)
    rows = join_stats(rows, volatility_level(df, axis).drop("volatility"), axis.keys)
    spans = [span_alpha(s) for p in MACD_PARAMS.values() for s in p] + [span_alpha(10), 1 / 14, *_state_alphas()]
    back = max(
        max(reach(span_alpha(max(p[:2]))) + reach(span_alpha(p[2])) for p in MACD_PARAMS.values()),
        2 * reach(1 / 14),
        max(map(reach, _state_alphas())) + 40,
    )
    h = decayed_halo(rows, spans, back, axis)
    frame = h.frame.withColumns({"_d": _delta(h), "_tr": true_range_of(F.lag("close").over(h.w))})
    over = h.last(14)
    price = F.col("_pv") / _or_tiny(F.col("_v").cast("double"))
    frame = frame.withColumns(
        {
            "rsi": relative_strength(F.avg(gains(F.col("_d"))).over(over), F.avg(losses(F.col("_d"))).over(over)),
            "atr": F.when(F.col("_rn") >= 14, F.avg("_tr").over(over)),
            "bb_width": F.when(F.col("_rn") >= 20, 4 * F.stddev_pop("close").over(h.last(20)) / F.nullif(F.col("close"), F.lit(0.0))),
            "vwap_gap": (F.col("close") - price) / F.nullif(price, F.lit(0.0)),
            "ema_short": ewm_mean(h, F.col("close").cast("double"), span_alpha(10), adjust=False),
            "volume_ma_ratio": F.when(F.col("_rn") >= 5, F.col("volume") / _or_tiny(F.avg("volume").over(h.last(5)))),
        }
    )
    frame = _adx(h, frame, 14, "adx")
    frame = _macd(h, frame.withColumns(_macd_rates(MACD_PARAMS)), [rate(n) for n in _RATES], "macd_hist")
    frame = _market_state(h, frame, "market_state")
    drop = ["_d", "_pv", "_v", "level", *_macd_rates(MACD_PARAMS)]
    return h.settle(frame, *drop).select(*df.columns, *BASE_FEATURES, "market_state")


def realtime_window(n: Column) -> Column:
    """Rows used for realtime features of a series of ``n``: all up to 50, 80 up to 200, else 60."""
    return F.when(n <= 50, n).when(n <= 200, F.least(F.lit(80), n)).otherwise(F.lit(60))


REALTIME = ("rsi", "macd_hist", "atr", "ema_short", "volume_ma_ratio", "price_change", "market_state")


def realtime_features(df: DataFrame, axis: Axis = BARS, length: DataFrame | None = None) -> DataFrame:
    """Features of the newest row of every series from its last rows with short windows.

    Only the last 80 rows per series leave the map side, so the windows see a bounded group. If ``df`` has only the tails
    of the series, ``length`` (keys, n) says how long they are.
    """
    from tidemark.operators.keys import latest_n

    counts = df.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("_n")) if length is None else length.withColumnRenamed("n", "_n")
    tail = latest_n(df.select(*axis.id, "high", "low", "close", "volume"), 80, axis).join(counts, list(axis.keys))
    rows = [F.col(c) for c in ("high", "low", "close", "volume")]
    bars = F.sort_array(F.collect_list(F.struct(*axis.order, *rows)))
    series = tail.groupBy(*axis.keys).agg(bars.alias("_bars"), F.first("_n").alias("_n"))
    series = series.withColumn("_bars", F.slice("_bars", -F.least(realtime_window(F.col("_n")), F.size("_bars")).cast("int"), F.lit(80)))
    series = series.withColumn(axis.ts, F.col("_bars")[F.size("_bars") - 1][axis.ts])
    return with_realtime(series, "_bars").select(*axis.keys, axis.ts, *REALTIME)


def _fold(values: Column, zero: Column, merge) -> Column:
    return F.aggregate(values, zero, merge)


def _mean(values: Column) -> Column:
    return _fold(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _tail(values: Column, n: int) -> Column:
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def _ewm_last(values: Column, span: float) -> Column:
    """Normalised decayed mean of an array, as a fold."""
    keep = 1.0 - span_alpha(span)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    merge = lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["w"] * keep + 1.0).alias("w"))
    return F.aggregate(values, zero, merge, lambda a: a["s"] / a["w"])


def with_realtime(df: DataFrame, bars: str) -> DataFrame:
    """Append the short-window features of the last of an ordered array of bars; shared by batch and streams.

    The arrays are columns of their own, so each is made once per row.
    """
    df = df.withColumns(
        {
            "_close": F.transform(bars, lambda b: b["close"].cast("double")),
            "_recent": _tail(F.col(bars), 7),
            "_volumes": F.transform(_tail(F.col(bars), 5), lambda b: b["volume"].cast("double")),
        }
    )
    # The closes before the recent bars; null before the first bar of all.
    before = F.slice(F.concat(F.array(F.lit(None).cast("double")), F.col("_close")), -F.size("_recent") - 1, F.size("_recent"))
    df = df.withColumn("_before", before)
    df = df.withColumns(
        {
            "_delta": F.zip_with("_recent", "_before", lambda b, p: b["close"].cast("double") - p),
            "_ranges": F.zip_with("_recent", "_before", lambda b, p: F.greatest(b["high"] - b["low"], F.abs(b["high"] - p), F.abs(b["low"] - p))),
        }
    )
    df = df.withColumns(
        {"_gain": _mean(F.transform("_delta", gains)), "_loss": _mean(F.transform("_delta", losses)), "_mean_volume": _mean(F.col("_volumes"))}
    )
    close, zero = F.col("_close"), F.lit(0.0)
    last_close = F.element_at(close, -1)
    change = last_close / F.nullif(F.element_at("_before", -1), zero) - 1
    out = df.withColumns(
        {
            "rsi": F.coalesce(100 - 100 / (1 + F.col("_gain") / _or_tiny(F.col("_loss"))), F.lit(50.0)),
            "macd_hist": F.coalesce(_ewm_last(close, 8) - _ewm_last(close, 17), zero),
            "atr": F.coalesce(_mean(F.col("_ranges")), zero),
            "ema_short": F.coalesce(_ewm_last(close, 5), zero),
            "volume_ma_ratio": F.coalesce(F.element_at("_volumes", -1) / F.nullif(F.col("_mean_volume"), zero), zero),
            "price_change": F.coalesce(change, zero),
            "_short": _mean(_tail(close, 5)),
            "_long": _mean(_tail(close, 20)),
        }
    )
    out = out.withColumn("market_state", simple_state(F.col("_short"), F.col("_long")))
    return out.drop("_close", "_recent", "_volumes", "_before", "_delta", "_ranges", "_gain", "_loss", "_mean_volume", "_short", "_long")
