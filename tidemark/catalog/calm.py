"""Queries over series of different calm, so that each level, regime and window factor occurs."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.indicators import _PICK, FEATURES, LEVELS, STATE, bars
from tidemark.catalog.sampling import LABELED, SIZE, WINDOWS, window_summary
from tidemark.fixtures import calm, table
from tidemark.operators import clean as C
from tidemark.operators import indicators as X
from tidemark.operators import sampling as P
from tidemark.operators.keys import OHLCV
from tidemark.session import stage

CALM_FEATURES, CALM_LABELED = FEATURES.replace("bars30", "calm"), LABELED.replace("bars30", "calm")


@query("volatility_level_calm", f"WITH {bars('calm')}, {LEVELS} SELECT symbol, R(volatility) AS volatility, level FROM lev", ("calm",))
def _(spark, sf):
    return rounded(X.volatility_level(calm(spark, sf)), "volatility")


@query("macd_dynamic_calm", f"WITH RECURSIVE {bars('calm')}, {_PICK} SELECT symbol, ts, R(hist) AS macd_hist FROM b JOIN picked USING (symbol, rn)", ("calm",))
def _(spark, sf):
    return rounded(X.macd_dynamic(stage(calm(spark, sf).select("symbol", "ts", "close"), "bars")).drop("close"), "macd_hist")


@query("market_state_calm", f"WITH RECURSIVE {bars('calm')}, {LEVELS}, {STATE} SELECT symbol, ts, market_state FROM state", ("calm",))
def _(spark, sf):
    return X.market_state(stage(calm(spark, sf), "bars")).select("symbol", "ts", "market_state")


@query(
    "base_features_calm",
    f"WITH RECURSIVE {CALM_FEATURES} SELECT symbol, ts, market_state, " + ", ".join(f"R({c}) AS {c}" for c in X.BASE_FEATURES) + " FROM features",
    ("calm",),
)
def _(spark, sf):
    return rounded(X.base_features(stage(C.strip_zero_bars(calm(spark, sf)), "bars")).drop(*OHLCV), *X.BASE_FEATURES)


@query("dynamic_window_size_calm", f"WITH {CALM_LABELED} SELECT symbol, ts, {SIZE} AS size, CASE WHEN v > 0.03 THEN 30 WHEN v > 0.015 THEN 45 ELSE 60 END AS stepped FROM lab", ("calm",))
def _(spark, sf):
    df = X.trend_strength(X.rolling_volatility(calm(spark, sf).select("symbol", "ts", "close"), 20, 5))
    v = F.coalesce(F.col("volatility"), F.lit(0.0))
    return df.select("symbol", "ts", P.dynamic_window_size(v, F.col("trend_strength")).alias("size"), P.stepped_window_size(v).alias("stepped"))


@query(
    "sequences_calm",
    f"""WITH {CALM_LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n)
        SELECT * REPLACE (R(first_close) AS first_close, R(last_close) AS last_close) FROM (
        {WINDOWS.format(stamp='w.ts', label='w.market_state')} GROUP BY w.symbol, w.ts, w.market_state HAVING count(*) >= 30)""",
    ("calm",),
)
def _(spark, sf):
    """Every row's window."""
    rows = stage(X.market_state_simple(calm(spark, sf).select("symbol", "ts", "close", "volume")), "labeled")
    return rounded(window_summary(P.sequences(rows, ["close", "volume"])), "first_close", "last_close")


@query(
    "imbalance_profile_of_lines",
    """WITH c AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT min(n) AS smallest, max(n) AS largest, R(min(n) / max(n)) AS ratio, CASE WHEN min(n) / max(n) < 0.3 THEN 'oversample' ELSE 'weights' END AS strategy FROM c""",
)
def _(spark, sf):
    found = P.imbalance_profile(table(spark, sf, "lineitem").select("l_linenumber"), "l_linenumber")
    return rounded(found.select("smallest", "largest", "ratio", "strategy"), "ratio")
