"""Queries on repair of series tables."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.fixtures import bars30, dirty_bars
from tidemark.operators import clean as C
from tidemark.operators.keys import OHLCV, PRICES
from tidemark.session import stage


def dirty(spark, sf):
    """The faulty bars without doubled rows, written once: the operators read their input several times."""
    return stage(dirty_bars(spark, sf).filter("dup = 0").drop("dup"), "dirty")


def lean(spark, sf):
    return dirty(spark, sf).select("symbol", "ts", *OHLCV)


@query(
    "drop_null_rows",
    "SELECT symbol, ts, open, high, low, close, volume FROM dirty WHERE high IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL",
    ("dirty",),
)
def _(spark, sf):
    return C.drop_null_rows(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", *OHLCV))


def line(c: str) -> str:
    """SQL of one interpolated column, by window functions."""
    known = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    return f"""(CASE WHEN {c} IS NOT NULL THEN {c}
      WHEN first({known} IGNORE NULLS) OVER nxt IS NULL THEN last({c} IGNORE NULLS) OVER prv
      ELSE last({c} IGNORE NULLS) OVER prv + (first({c} IGNORE NULLS) OVER nxt - last({c} IGNORE NULLS) OVER prv)
           * (rn - last({known} IGNORE NULLS) OVER prv)::DOUBLE
           / (first({known} IGNORE NULLS) OVER nxt - last({known} IGNORE NULLS) OVER prv) END)"""


AROUND = """WINDOW prv AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  nxt AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query(
    "interpolate_linear",
    f"SELECT symbol, ts, R({line('high')}) AS high, R({line('close')}) AS close, R({line('volume')}) AS volume FROM dirty {AROUND}",
    ("dirty",),
)
def _(spark, sf):
    cols = ["high", "close", "volume"]
    return rounded(C.interpolate_linear(dirty(spark, sf).select("symbol", "ts", *cols), cols), *cols)


@query("zero_fill", "SELECT symbol, ts, coalesce(volume, 0) AS volume FROM dirty", ("dirty",))
def _(spark, sf):
    return C.zero_fill(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", "volume"))


FILL = "last({c} IGNORE NULLS) OVER prv"
BACK = "first({c} IGNORE NULLS) OVER nxt"


@query(
    "ffill",
    f"SELECT symbol, ts, {FILL.format(c='high')} AS high, {FILL.format(c='close')} AS close, {FILL.format(c='volume')} AS volume FROM dirty {AROUND}",
    ("dirty",),
)
def _(spark, sf):
    return C.ffill(dirty(spark, sf).select("symbol", "ts", "high", "close", "volume"), ["high", "close", "volume"])


@query(
    "bfill",
    f"SELECT symbol, ts, {BACK.format(c='high')} AS high, {BACK.format(c='close')} AS close, {BACK.format(c='volume')} AS volume FROM dirty {AROUND}",
    ("dirty",),
)
def _(spark, sf):
    return C.bfill(dirty(spark, sf).select("symbol", "ts", "high", "close", "volume"), ["high", "close", "volume"])


@query(
    "ffill_bfill",
    "WITH late AS (SELECT symbol, rn, ts, CASE WHEN rn > 40 THEN high END AS high FROM dirty) "
    f"SELECT symbol, ts, coalesce({FILL.format(c='high')}, {BACK.format(c='high')}) AS high FROM late {AROUND}",
    ("dirty",),
)
def _(spark, sf):
    late = dirty(spark, sf).select("symbol", "ts", F.when(F.col("rn") > 40, F.col("high")).alias("high"))
    return C.ffill_bfill(late, ["high"])


@query(
    "median_fill",
    """SELECT symbol, ts, R(coalesce(high, median(high) OVER (PARTITION BY symbol))) AS high,
              R(coalesce(volume, median(volume) OVER (PARTITION BY symbol))) AS volume FROM dirty""",
    ("dirty",),
)
def _(spark, sf):
    df = dirty(spark, sf).select("symbol", "ts", "high", "volume")
    return rounded(C.median_fill(df, ["high", "volume"]), "high", "volume")


@query(
    "impute_mean",
    """SELECT symbol, ts, R(coalesce(high, avg(high) OVER (PARTITION BY symbol))) AS high,
              R(coalesce(volume, avg(volume) OVER (PARTITION BY symbol))) AS volume FROM dirty""",
    ("dirty",),
)
def _(spark, sf):
    df = dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", "high", "volume")
    return rounded(C.impute(df, ["high", "volume"], "mean"), "high", "volume")


def fences(cols=OHLCV) -> str:
    parts = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}, "
        f"median({c}) AS med_{c}"
        for c in cols
    )
    return f"fences AS (SELECT symbol, {parts} FROM dirty GROUP BY 1)"


def out(c: str) -> str:
    return f"({c} < lo_{c} OR {c} > hi_{c})"


@query(
    "fix_outliers_median",
    f"WITH {fences()} SELECT symbol, ts, "
    + ", ".join(f"R(CASE WHEN {out(c)} THEN med_{c} ELSE {c} END) AS {c}" for c in OHLCV)
    + " FROM dirty JOIN fences USING (symbol)",
    ("dirty",),
)
def _(spark, sf):
    return rounded(C.fix_outliers_iqr(lean(spark, sf), how="median"), *OHLCV)


@query(
    "fix_outliers_interpolate",
    f"WITH {fences(('open', 'close'))}, holes AS (SELECT symbol, ts, rn, "
    + ", ".join(f"CASE WHEN {out(c)} THEN NULL ELSE {c} END AS {c}" for c in ("open", "close"))
    + f" FROM dirty JOIN fences USING (symbol)) SELECT symbol, ts, R({line('open')}) AS open, R({line('close')}) AS close FROM holes {AROUND}",
    ("dirty",),
)
def _(spark, sf):
    df = dirty(spark, sf).select("symbol", "ts", "open", "close")
    return rounded(C.fix_outliers_iqr(df, ["open", "close"], "interpolate"), "open", "close")


def drop_chain(source: str, cols) -> tuple[str, str]:
    """CTEs that drop the outliers of one column after another."""
    parts = []
    for i, c in enumerate(cols):
        q = f"quantile_cont({c}, [0.25, 0.75])"
        parts.append(
            f"q{i} AS (SELECT symbol, {q} AS q FROM {source} GROUP BY 1), "
            f"d{i} AS (SELECT s.* FROM {source} s JOIN q{i} USING (symbol) WHERE "
            f"coalesce({c} >= q[1] - 1.5 * (q[2] - q[1]) AND {c} <= q[2] + 1.5 * (q[2] - q[1]), TRUE))"
        )
        source = f"d{i}"
    return ", ".join(parts), source


_DROPS, _LEFT = drop_chain("dirty", OHLCV)


@query("fix_outliers_drop", f"WITH {_DROPS} SELECT symbol, ts, open, high, low, close, volume FROM {_LEFT}", ("dirty",))
def _(spark, sf):
    return C.fix_outliers_iqr(lean(spark, sf), how="drop")


VALID = """high >= open AND high >= close AND high >= low AND low <= open AND low <= close
           AND open > 0 AND high > 0 AND low > 0 AND close > 0"""


@query("filter_valid_ohlc", f"SELECT symbol, ts, open, high, low, close, volume FROM dirty WHERE {VALID}", ("dirty",))
def _(spark, sf):
    return C.filter_valid_ohlc(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", *OHLCV))


@query("fix_negative_volume_zero", "SELECT symbol, ts, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume FROM dirty", ("dirty",))
def _(spark, sf):
    return C.fix_negative_volume(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", "volume"))


@query("fix_negative_volume_drop", "SELECT symbol, ts, volume FROM dirty WHERE coalesce(volume >= 0, TRUE)", ("dirty",))
def _(spark, sf):
    return C.fix_negative_volume(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", "volume"), "drop")


@query(
    "winsorize",
    "WITH q AS (SELECT symbol, "
    + ", ".join(f"quantile_cont({c}, 0.05) AS l_{c}, quantile_cont({c}, 0.95) AS h_{c}" for c in PRICES)
    + " FROM dirty GROUP BY 1) SELECT symbol, ts, "
    + ", ".join(
        f"R(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, l_{c} - 3 * (h_{c} - l_{c})), h_{c} + 3 * (h_{c} - l_{c})) END) AS {c}"
        for c in PRICES
    )
    + " FROM dirty JOIN q USING (symbol)",
    ("dirty",),
)
def _(spark, sf):
    return rounded(C.winsorize(dirty(spark, sf).select("symbol", "ts", *PRICES)), *PRICES)


@query(
    "strip_zero_bars",
    "SELECT symbol, ts, open, high, low, close, volume FROM dirty WHERE high <> 0 AND close <> 0 AND volume <> 0 AND open <> 0 AND low <> 0",
    ("dirty",),
)
def _(spark, sf):
    return C.strip_zero_bars(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", *OHLCV))


@query(
    "adaptive_null_fix",
    f"""WITH f AS (SELECT symbol, ts, rn, high, CASE WHEN rn % 3 = 0 THEN close END AS sparse,
                          CASE WHEN symbol <> 'click' THEN close END AS gone FROM dirty),
        m AS (SELECT *, median(sparse) OVER (PARTITION BY symbol) AS ms FROM f)
        SELECT symbol, ts, R(coalesce(high, {FILL.format(c='high')}, {BACK.format(c='high')}, 0)) AS high,
               R(coalesce(sparse, ms, 0)) AS sparse,
               R(coalesce(gone, {FILL.format(c='gone')}, {BACK.format(c='gone')}, 0)) AS gone, 0::DOUBLE AS absent
        FROM m {AROUND}""",
    ("dirty",),
)
def _(spark, sf):
    df = dirty(spark, sf).select(
        "symbol",
        "ts",
        "high",
        F.when(F.col("rn") % 3 == 0, F.col("close")).alias("sparse"),
        F.when(F.col("symbol") != "click", F.col("close")).alias("gone"),
    )
    cols = ["high", "sparse", "gone", "absent"]
    return rounded(C.adaptive_null_fix(df, cols), *cols)


@query(
    "nonfinite_to_null",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS b
       FROM events""",
)
def _(spark, sf):
    from tidemark.fixtures import table

    inf, nan = F.lit(float("-inf")), F.lit(float("nan"))
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, inf).otherwise(F.col("value")).alias("a"),
        F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("value")).alias("b"),
    )
    return C.nonfinite_to_null(df, ["a", "b"])


@query(
    "rebuild_protected",
    """SELECT symbol, ts, price, price AS close, price AS high, price AS low, 0::BIGINT AS volume, 1 AS market_state,
              lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS open
       FROM (SELECT symbol, ts, close AS price FROM bars30)""",
    ("bars30",),
)
def _(spark, sf):
    return C.rebuild_protected(stage(bars30(spark, sf).select("symbol", "ts", F.col("close").alias("price")), "bars"))


@query(
    "recompute_dead_features",
    """WITH r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret FROM bars30 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
       SELECT symbol, ts,
              R(CASE WHEN symbol IN ('click', 'view') THEN CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v END
                   WHEN symbol = 'error' THEN coalesce(stddev_samp(ret) OVER v, 0) ELSE 1.5 END) AS volatility,
              R8(CASE WHEN symbol IN ('error', 'signup') THEN coalesce(ret, 0) ELSE 0.25 END) AS returns_1
       FROM r WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    ("bars30",),
)
def _(spark, sf):
    symbol, half = F.col("symbol"), F.minute("ts") == 0
    df = bars30(spark, sf).select(
        "symbol",
        "ts",
        "close",
        F.when(symbol.isin("click", "view"), 0.0).when((symbol == "error") & half, None).otherwise(1.5).alias("volatility"),
        F.when(symbol.isin("error", "signup") & half, None).otherwise(0.25).alias("returns_1"),
    )
    fixed = C.recompute_dead_features(stage(df, "bars")).drop("close")
    return rounded(rounded(fixed, "volatility"), "returns_1", digits=8)


def cleaning_sql(mode: str) -> str:
    """CTE ``cleaned`` from the definition of each mode."""
    if mode == "strict":
        start = "SELECT symbol, ts, rn, open, high, low, close, volume FROM dirty WHERE high IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL"
    else:
        lines = ", ".join(f"{line(c)} AS {c}" for c in PRICES)
        start = f"SELECT symbol, ts, rn, {lines}, coalesce(volume, 0) AS volume FROM dirty {AROUND}"
    valid = VALID if mode != "conservative" else "TRUE"
    volume = "SELECT * FROM c1 WHERE volume >= 0" if mode == "strict" else "SELECT * REPLACE (greatest(volume, 0) AS volume) FROM c1"
    if mode == "strict":
        chain, left = drop_chain("c2", OHLCV)
        outliers = f"{chain}, c3 AS (SELECT * FROM {left})"
    else:
        outliers = (
            fences().replace("FROM dirty", "FROM c2")
            + ", c3 AS (SELECT symbol, ts, rn, "
            + ", ".join(f"CASE WHEN {out(c)} THEN med_{c} ELSE {c} END AS {c}" for c in OHLCV)
            + " FROM c2 JOIN fences USING (symbol))"
        )
    return f"""c0 AS ({start}), c1 AS (SELECT * FROM c0 WHERE {valid}), c2 AS ({volume}), {outliers},
      c4 AS (SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts, first(open ORDER BY rn) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high,
                    min(low) AS low, last(close ORDER BY rn) FILTER (WHERE close IS NOT NULL) AS close, sum(volume) AS volume FROM c3 GROUP BY 1, 2
             HAVING count(open) > 0 AND count(high) > 0 AND count(low) > 0 AND count(close) > 0),
      c_grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM c4 GROUP BY 1),
      cleaned AS (SELECT symbol, g.ts, c4.open, c4.high, c4.low, c4.close, c4.volume FROM (SELECT * FROM c_grid) g ASOF JOIN c4 USING (symbol, ts))"""


def _register(mode: str) -> None:
    @query(
        f"clean_{mode}",
        f"WITH {cleaning_sql(mode)} SELECT symbol, ts, " + ", ".join(f"R({c}) AS {c}" for c in OHLCV) + " FROM cleaned",
        ("dirty",),
    )
    def _(spark, sf):
        return rounded(C.clean(dirty_bars(spark, sf).filter("dup = 0"), mode), *OHLCV)


for _mode in C.MODES:
    _register(_mode)

_LOG_STEPS = ("dirty", "c0", "c1", "c2", "c3", "c4", "cleaned")
_LOG_NAMES = ("input", "missing", "ohlc", "volume", "outliers", "resample", "gaps")


@query(
    "cleaning_log",
    f"WITH {cleaning_sql('strict')}, n AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, {i} AS step_no, '{name}' AS step, count(*) AS rows FROM {cte} GROUP BY 1"
        for i, (cte, name) in enumerate(zip(_LOG_STEPS, _LOG_NAMES))
    )
    + ") SELECT symbol, step_no, step, rows, abs(rows - lag(rows) OVER (PARTITION BY symbol ORDER BY step_no)) AS affected FROM n",
    ("dirty",),
)
def _(spark, sf):
    return C.cleaning_log(dirty_bars(spark, sf).filter("dup = 0"), "strict")

