"""Queries on indicators and regime labels."""

from tidemark.catalog.base import query, rounded
from tidemark.fixtures import bars30, bars_user
from tidemark.functions.ewm import ema
from tidemark.operators import clean as C
from tidemark.operators import indicators as X
from tidemark.operators.keys import OHLCV
from tidemark.session import stage

# ---------------------------------------------------------------------------------------------------------
# SQL pieces. Each reads `b`: bars with row number rn, close before pc, change d and true range tr.


def bars(source: str = "bars30") -> str:
    return f"""b0 AS (SELECT symbol, ts, open, high, low, close, volume, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
        FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      b AS (SELECT *, close - pc AS d, close / nullif(pc, 0) - 1 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM b0)"""


def frame(n: int, first: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1 + first} PRECEDING AND {first} PRECEDING)" if first else (
        f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


def rsi_sql(n: int = 14) -> str:
    gain = f"avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER {frame(n)}"
    loss = f"avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER {frame(n)}"
    return f"least(greatest(100 - 100 / (1 + {gain} / CASE WHEN {loss} = 0 THEN 1e-10 ELSE {loss} END), 0), 100)"


def ema_cte(name: str, alpha: float, x: str = "close", source: str = "b") -> str:
    """y = alpha x + (1 - alpha) y_before from the first row."""
    return f"""{name} AS (SELECT symbol, rn, {x}::DOUBLE AS y FROM {source} WHERE rn = 1 UNION ALL
        SELECT n.symbol, n.rn, {alpha!r} * n.{x} + {1 - alpha!r} * e.y FROM {name} e JOIN {source} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


def macd_ctes(name: str, fast: int, slow: int, signal: int) -> str:
    a, z, s = (2 / (k + 1) for k in (fast, slow, signal))
    return f"""{ema_cte(name + '_f', a)}, {ema_cte(name + '_s', z)},
      {name}_l AS (SELECT symbol, rn, f.y - s.y AS line FROM {name}_f f JOIN {name}_s s USING (symbol, rn)),
      {ema_cte(name + '_g', s, 'line', name + '_l')},
      {name} AS (SELECT symbol, rn, line - g.y AS hist FROM {name}_l JOIN {name}_g g USING (symbol, rn))"""


def adx_ctes(n: int = 14) -> str:
    keep = 1 - 1 / n
    return f"""dm AS (SELECT symbol, rn, tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS p,
                 CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS m FROM b),
      di AS (SELECT symbol, rn, p::DOUBLE AS p, m::DOUBLE AS m, tr::DOUBLE AS t FROM dm WHERE rn = 1 UNION ALL
             SELECT dm.symbol, dm.rn, {keep!r} * di.p + dm.p, {keep!r} * di.m + dm.m, {keep!r} * di.t + dm.tr FROM di JOIN dm ON dm.symbol = di.symbol AND dm.rn = di.rn + 1),
      dx AS (SELECT symbol, rn, 100 * abs(100 * p / t - 100 * m / t) / CASE WHEN 100 * p / t + 100 * m / t = 0 THEN 1e-10 ELSE 100 * p / t + 100 * m / t END AS dx
             FROM (SELECT symbol, rn, p, m, nullif(t, 0) AS t FROM di)),
      ax AS (SELECT symbol, rn, coalesce(dx, 0)::DOUBLE AS s, (dx IS NOT NULL)::INT::DOUBLE AS w FROM dx WHERE rn = 1 UNION ALL
             SELECT dx.symbol, dx.rn, {keep!r} * ax.s + coalesce(dx.dx, 0), {keep!r} * ax.w + (dx.dx IS NOT NULL)::INT FROM ax JOIN dx ON dx.symbol = ax.symbol AND dx.rn = ax.rn + 1),
      adx AS (SELECT symbol, rn, CASE WHEN w > 0 THEN s / w ELSE 0 END AS adx FROM ax)"""


def wilder_cte(n: int) -> str:
    return f"""w{n} AS (SELECT symbol, rn, (SELECT avg(tr) FROM b c WHERE c.symbol = b.symbol AND c.rn <= {n})::DOUBLE AS y FROM b WHERE rn = {n} UNION ALL
        SELECT b.symbol, b.rn, (w{n}.y * {n - 1} + b.tr) / {n} FROM w{n} JOIN b ON b.symbol = w{n}.symbol AND b.rn = w{n}.rn + 1)"""


LEVELS = """vol AS (SELECT symbol, CASE WHEN count(ret) >= 30 THEN stddev_samp(ret) END AS volatility
          FROM (SELECT symbol, ret, rn, max(rn) OVER (PARTITION BY symbol) AS last FROM b) WHERE rn < last GROUP BY 1),
      lev AS (SELECT symbol, volatility, CASE WHEN volatility > 0.02 THEN 'high' WHEN volatility > 0.01 THEN 'medium' ELSE 'low' END AS level FROM vol)"""

STATE = f"""{wilder_cte(10)}, {wilder_cte(14)}, {wilder_cte(20)},
      st0 AS (SELECT b.symbol, b.ts, b.rn, close, coalesce(CASE level WHEN 'high' THEN w10.y WHEN 'medium' THEN w14.y ELSE w20.y END, 0) AS atr
              FROM b JOIN lev USING (symbol) LEFT JOIN w10 USING (symbol, rn) LEFT JOIN w14 USING (symbol, rn) LEFT JOIN w20 USING (symbol, rn)),
      st1 AS (SELECT *, avg(close) OVER {frame(5, 1)} AS m5, avg(close) OVER {frame(20, 1)} AS m20,
                     CASE WHEN rn > 30 THEN avg(atr) OVER {frame(30, 1)} * 0.3 END AS band FROM st0),
      st2 AS (SELECT *, CASE WHEN rn >= 7 THEN regr_slope(m5, rn) OVER {frame(5, 1)} END AS slope FROM st1),
      state AS (SELECT symbol, ts, rn, CASE WHEN m5 > m20 + band AND slope > 0.05 THEN 2 WHEN m5 < m20 - band AND slope < -0.05 THEN 0 ELSE 1 END AS market_state FROM st2)"""


def simple_state_sql() -> str:
    short, long = f"avg(close) OVER {frame(5)}", f"avg(close) OVER {frame(20)}"
    return f"CASE WHEN {short} > {long} * 1.002 THEN 2 WHEN {short} < {long} * 0.998 THEN 0 ELSE 1 END"


def close(spark, sf):
    return bars30(spark, sf).select("symbol", "ts", "close")


def register(name, value, build, columns=None, digits=6, ctes="", rec=False, source="bars30", frame_of=bars30):
    """A query that appends one column to bars, and its SQL over `b`."""
    columns = columns or [name]
    select = ", ".join(f"R{digits if digits != 6 else ''}({v}) AS {c}" for c, v in zip(columns, value if isinstance(value, list) else [value]))
    extra = f", {ctes}" if ctes else ""
    text = f"WITH {'RECURSIVE ' if rec else ''}{bars(source)}{extra} SELECT b.symbol, b.ts, {select} FROM b" + (
        f" JOIN {rec} USING (symbol, rn)" if rec else ""
    )

    @query(name, text, (source,))
    def _(spark, sf):
        return rounded(build(frame_of(spark, sf)).select("symbol", "ts", *columns), *columns, digits=digits)


# ---------------------------------------------------------------------------------------------------------

register("rsi_14", rsi_sql(14), lambda df: X.rsi(df, 14, "rsi_14"))
register("rsi_14_user_bars", rsi_sql(14), lambda df: X.rsi(df, 14, "rsi_14_user_bars"), source="bars_user", frame_of=bars_user)
register("rsi_fast", rsi_sql(7), lambda df: X.rsi_fast(df, 7, "rsi_fast"))
_G = f"avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER {frame(14)}"
_L = f"avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER {frame(14)}"
register(
    "rsi_strict",
    f"CASE WHEN rn < 14 OR ({_G} = 0 AND {_L} = 0) THEN 50 WHEN {_L} = 0 THEN 100 ELSE 100 - 100 / (1 + {_G} / {_L}) END",
    lambda df: X.rsi_strict(df, 14, "rsi_strict"),
)
register("ema_span10", "e.y", lambda df: ema(df, span=10, name="ema_span10"), ctes=ema_cte("e", 2 / 11), rec="e")
_KEEP = 1 - 2 / 6
register(
    "ema_adjusted",
    "e.s / e.w",
    lambda df: ema(df, span=5, adjust=True, name="ema_adjusted"),
    ctes=f"""e AS (SELECT symbol, rn, close::DOUBLE AS s, 1.0::DOUBLE AS w FROM b WHERE rn = 1 UNION ALL
      SELECT n.symbol, n.rn, {_KEEP!r} * e.s + n.close, {_KEEP!r} * e.w + 1 FROM e JOIN b n ON n.symbol = e.symbol AND n.rn = e.rn + 1)""",
    rec="e",
)
register("macd_hist", "m.hist", lambda df: X.macd_hist(df), ctes=macd_ctes("m", 12, 26, 9), rec="m")
_ALL_MACD = ", ".join(macd_ctes(f"m_{k}", *p) for k, p in X.MACD_PARAMS.items())
_PICK = f"""{LEVELS}, {_ALL_MACD},
   picked AS (SELECT symbol, rn, CASE level WHEN 'high' THEN h.hist WHEN 'medium' THEN m.hist ELSE l.hist END AS hist
              FROM m_high h JOIN m_medium m USING (symbol, rn) JOIN m_low l USING (symbol, rn) JOIN lev USING (symbol))"""
register("macd_dynamic", "picked.hist", lambda df: X.macd_dynamic(stage(df, "bars"), name="macd_dynamic"), ctes=_PICK, rec="picked")

_ASOF = f"""asof0 AS (SELECT symbol, ts, rn, CASE WHEN count(ret) OVER past >= 30 THEN stddev_samp(ret) OVER past END AS volatility FROM b
     WINDOW past AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
   asof1 AS (SELECT *, CASE WHEN volatility > 0.02 THEN 'high' WHEN volatility > 0.01 THEN 'medium' ELSE 'low' END AS level FROM asof0)"""


@query("volatility_level_asof", f"WITH {bars()}, {_ASOF} SELECT symbol, ts, R(volatility) AS volatility, level FROM asof1", ("bars30",))
def _(spark, sf):
    return rounded(X.volatility_level_asof(close(spark, sf)).drop("close"), "volatility")


@query(
    "macd_dynamic_asof",
    f"""WITH RECURSIVE {bars()}, {_ASOF}, {_ALL_MACD}
        SELECT a.symbol, a.ts, R(CASE level WHEN 'high' THEN h.hist WHEN 'medium' THEN m.hist ELSE l.hist END) AS macd_hist
        FROM asof1 a JOIN m_high h USING (symbol, rn) JOIN m_medium m USING (symbol, rn) JOIN m_low l USING (symbol, rn)""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(X.macd_dynamic(stage(close(spark, sf), "bars"), level="asof").drop("close"), "macd_hist")


_FAST = {s: 1 - 2 / (s + 1) for s in (8, 17)}
register(
    "macd_fast",
    "e.a / e.aw - e.z / e.zw",
    lambda df: X.macd_fast(df, name="macd_fast"),
    ctes=f"""e AS (SELECT symbol, rn, close::DOUBLE AS a, 1.0::DOUBLE AS aw, close::DOUBLE AS z, 1.0::DOUBLE AS zw FROM b WHERE rn = 1 UNION ALL
      SELECT n.symbol, n.rn, {_FAST[8]!r} * e.a + n.close, {_FAST[8]!r} * e.aw + 1, {_FAST[17]!r} * e.z + n.close, {_FAST[17]!r} * e.zw + 1
      FROM e JOIN b n ON n.symbol = e.symbol AND n.rn = e.rn + 1)""",
    rec="e",
)
register("adx_14", "adx.adx", lambda df: X.adx(df, name="adx_14"), ctes=adx_ctes(), rec="adx")
register("true_range", "tr", lambda df: X.true_range(df, "true_range"))
register("atr_14", f"CASE WHEN rn >= 14 THEN avg(tr) OVER {frame(14)} END", lambda df: X.atr_sma(df, name="atr_14"))
register("atr_fast", f"avg(tr) OVER {frame(7)}", lambda df: X.atr_sma(df, 7, 1, "atr_fast"))
register(
    "atr_wilder",
    "w.y",
    lambda df: X.atr_wilder(df, 14, "atr_wilder"),
    ctes=f"{wilder_cte(14)}, w AS (SELECT symbol, rn, coalesce(w14.y, 0) AS y FROM b LEFT JOIN w14 USING (symbol, rn))",
    rec="w",
)
register("bb_width", f"CASE WHEN rn >= 20 THEN 4 * stddev_pop(close) OVER {frame(20)} / nullif(close, 0) END", X.bb_width)
_PV = "sum(close * volume) OVER (PARTITION BY symbol ORDER BY rn)"
_V = "sum(volume) OVER (PARTITION BY symbol ORDER BY rn)"
_VWAP = f"({_PV} / CASE WHEN {_V} = 0 THEN 1e-10 ELSE {_V} END)"
register("vwap", [_VWAP, f"(close - {_VWAP}) / nullif({_VWAP}, 0)"], X.vwap, columns=["vwap", "vwap_gap"])
_MEAN5 = f"avg(volume) OVER {frame(5)}"
_RATIO = f"volume / CASE WHEN {_MEAN5} = 0 THEN 1e-10 ELSE {_MEAN5} END"
register("volume_ma_ratio", f"CASE WHEN rn >= 5 THEN {_RATIO} END", X.volume_ma_ratio)
register("volume_ma_ratio_fast", _RATIO, lambda df: X.volume_ma_ratio(df, 5, 1, "volume_ma_ratio_fast"))


@query("volatility_level", f"WITH {bars()}, {LEVELS} SELECT symbol, R(volatility) AS volatility, level FROM lev", ("bars30",))
def _(spark, sf):
    return rounded(X.volatility_level(bars30(spark, sf)), "volatility")


register("rolling_slope", f"CASE WHEN rn >= 5 THEN regr_slope(close, rn) OVER {frame(5)} END", lambda df: X.rolling_slope(df, 5, name="rolling_slope"))


@query("market_state", f"WITH RECURSIVE {bars()}, {LEVELS}, {STATE} SELECT symbol, ts, market_state FROM state", ("bars30",))
def _(spark, sf):
    return X.market_state(stage(bars30(spark, sf), "bars")).select("symbol", "ts", "market_state")


@query("market_state_simple", f"WITH {bars()} SELECT symbol, ts, {simple_state_sql()} AS market_state FROM b", ("bars30",))
def _(spark, sf):
    return X.market_state_simple(close(spark, sf)).drop("close")


def pct(c: str, k: int) -> str:
    return f"{c} / nullif(lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY rn), 0) - 1"


_CHANGES = {
    "returns_1": ("close", 1),
    "returns_3": ("close", 3),
    "returns_6": ("close", 6),
    "price_change_5": ("close", 5),
    "price_change_10": ("close", 10),
    "volume_change_5": ("volume", 5),
}
register("returns", [pct(*v) for v in _CHANGES.values()], lambda df: X.relative_changes(df, _CHANGES), columns=list(_CHANGES), digits=8)


def vol(n: int, least: int) -> str:
    return f"CASE WHEN count(ret) OVER {frame(n)} >= {max(least, 2)} THEN stddev_samp(ret) OVER {frame(n)} END"


register("volatility_30", vol(30, 10), lambda df: X.rolling_volatility(df, 30, 10, whole=30, name="volatility_30"))
register("volatility_20_min5", vol(20, 5), lambda df: X.rolling_volatility(df, 20, 5, name="volatility_20_min5"))
register("volatility_20", vol(20, 1), lambda df: X.rolling_volatility(df, 20, 1, name="volatility_20"))
register(
    "volatility_whole",
    f"CASE WHEN count(ret) OVER (PARTITION BY symbol) >= 29 THEN {vol(20, 10)} END",
    lambda df: X.rolling_volatility(stage(df, "bars"), 20, 10, whole=29, name="volatility_whole"),
    source="bars_user",
    frame_of=bars_user,
)
register(
    "volatility_rank",
    f"""CASE WHEN rn >= 50 THEN ((SELECT count(*) FILTER (WHERE c.close < b.close) + (count(*) FILTER (WHERE c.close = b.close) + 1) / 2
          FROM b c WHERE c.symbol = b.symbol AND c.rn BETWEEN b.rn - 49 AND b.rn) / 50) END""",
    lambda df: X.rolling_pct_rank(df, "close", 50, "volatility_rank"),
)
_M, _S = f"avg(volume) OVER {frame(20)}", f"stddev_samp(volume) OVER {frame(20)}"
register("volume_osc", f"coalesce((volume - {_M}) / CASE WHEN {_S} = 0 THEN 1 ELSE {_S} END, 0)", X.volume_osc)


@query(
    "threshold_flags",
    f"""WITH RECURSIVE {bars()}, {adx_ctes()}, f AS (SELECT b.*, adx, {rsi_sql()} AS rsi, CASE WHEN rn >= 14 THEN avg(tr) OVER {frame(14)} END AS atr FROM b JOIN adx USING (symbol, rn))
        SELECT symbol, ts, coalesce(adx > 25, FALSE)::INT AS adx_above_25, (rsi > 70)::INT AS rsi_overbought, (rsi < 30)::INT AS rsi_oversold,
               R(atr / CASE WHEN rn >= 5 THEN avg(close) OVER {frame(20)} END) AS atr_ratio FROM f""",
    ("bars30",),
)
def _(spark, sf):
    base = stage(X.base_features(stage(bars30(spark, sf), "bars")), "features")
    cols = ["adx_above_25", "rsi_overbought", "rsi_oversold", "atr_ratio"]
    return rounded(X.threshold_flags(base).select("symbol", "ts", *cols), "atr_ratio")


register(
    "trend_strength",
    f"CASE WHEN rn >= 14 THEN coalesce(abs(avg(close) OVER {frame(7)} - avg(close) OVER {frame(14)}) / nullif(avg(close) OVER {frame(14)}, 0), 0.5) ELSE 0.5 END",
    X.trend_strength,
)

# The full base feature table over bars without zero fields.
STRIPPED = "stripped AS (SELECT * FROM bars30 WHERE open <> 0 AND high <> 0 AND low <> 0 AND close <> 0 AND volume <> 0)"
FEATURES = f"""{STRIPPED}, {bars('stripped')}, {LEVELS}, {_ALL_MACD}, {adx_ctes()}, {STATE}, {ema_cte('ema10', 2 / 11)},
   features AS (SELECT b.symbol, b.ts, b.rn, b.open, b.high, b.low, b.close, b.volume, {rsi_sql()} AS rsi, CASE WHEN rn >= 14 THEN avg(tr) OVER {frame(14)} END AS atr,
     CASE WHEN rn >= 20 THEN 4 * stddev_pop(close) OVER {frame(20)} / nullif(close, 0) END AS bb_width,
     CASE level WHEN 'high' THEN m_high.hist WHEN 'medium' THEN m_medium.hist ELSE m_low.hist END AS macd_hist,
     (close - {_VWAP}) / nullif({_VWAP}, 0) AS vwap_gap, CASE WHEN rn >= 5 THEN {_RATIO} END AS volume_ma_ratio, adx.adx AS adx, ema10.y AS ema_short, market_state
     FROM b JOIN lev USING (symbol) JOIN m_high USING (symbol, rn) JOIN m_medium USING (symbol, rn) JOIN m_low USING (symbol, rn) JOIN adx USING (symbol, rn)
     JOIN ema10 USING (symbol, rn) JOIN (SELECT symbol, rn, market_state FROM state) USING (symbol, rn))"""


def stripped(spark, sf):
    return stage(C.strip_zero_bars(bars30(spark, sf)), "bars")


@query(
    "base_features",
    f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, market_state, " + ", ".join(f"R({c}) AS {c}" for c in X.BASE_FEATURES) + " FROM features",
    ("bars30",),
)
def _(spark, sf):
    return rounded(X.base_features(stripped(spark, sf)).drop(*OHLCV), *X.BASE_FEATURES)


def tail_sql() -> str:
    """Last rows of each series renumbered, so that the short windows start fresh."""
    return """cnt AS (SELECT symbol, count(*) AS n FROM bars30 GROUP BY 1),
      tail AS (SELECT t.* FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS z FROM bars30) t JOIN cnt USING (symbol)
               WHERE z <= CASE WHEN n <= 50 THEN n WHEN n <= 200 THEN least(80, n) ELSE 60 END)"""


def _decayed(span: int) -> str:
    keep = 1 - 2 / (span + 1)
    return f"sum(close * pow({keep!r}, z - 1)) / sum(pow({keep!r}, z - 1))"


REALTIME_SQL = f"""{tail_sql()}, {bars('tail')},
   bz AS (SELECT *, {rsi_sql(7)} AS rsi, avg(tr) OVER {frame(7)} AS atr, volume / nullif(avg(volume) OVER {frame(5)}, 0) AS vr, {simple_state_sql()} AS state,
                 row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS z FROM b),
   decays AS (SELECT symbol, {_decayed(8)} - {_decayed(17)} AS macd, {_decayed(5)} AS ema FROM bz GROUP BY 1)
   SELECT symbol, ts, R(rsi) AS rsi, R(macd) AS macd_hist, R(atr) AS atr, R(ema) AS ema_short, R(coalesce(vr, 0)) AS volume_ma_ratio,
          R(coalesce(ret, 0)) AS price_change, state AS market_state FROM bz JOIN decays USING (symbol) WHERE z = 1"""


@query("realtime_features", f"WITH {REALTIME_SQL}", ("bars30",))
def _(spark, sf):
    return rounded(X.realtime_features(bars30(spark, sf)), *X.REALTIME[:-1])


@query("realtime_features_short", f"WITH {REALTIME_SQL.replace('bars30', 'bars_user')}", ("bars_user",))
def _(spark, sf):
    return rounded(X.realtime_features(bars_user(spark, sf)), *X.REALTIME[:-1])

