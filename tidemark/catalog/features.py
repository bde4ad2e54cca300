"""Queries on feature matrices and column selection."""

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.indicators import FEATURES, bars, pct, vol
from tidemark.fixtures import bars30
from tidemark.operators import features as S
from tidemark.operators import indicators as X
from tidemark.operators.keys import OHLCV
from tidemark.plans.series import BARS, numbered
from tidemark.session import stage

BASE = X.BASE_FEATURES


def fixed(c: str) -> str:
    around = f"last({c} IGNORE NULLS) OVER prv, first({c} IGNORE NULLS) OVER nxt"
    return f"""CASE WHEN count({c}) OVER (PARTITION BY symbol) / count(*) OVER (PARTITION BY symbol) < 0.8
      THEN coalesce({c}, median({c}) OVER (PARTITION BY symbol), 0) ELSE coalesce({c}, {around}, 0) END"""


FIXED = f"""{FEATURES}, fixed AS (SELECT symbol, ts, rn, open, high, low, close, volume, market_state, {', '.join(f'{fixed(c)} AS {c}' for c in BASE)} FROM features
   WINDOW prv AS (PARTITION BY symbol ORDER BY rn), nxt AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
MATRIX = [f"R({c}) AS {c}" for c in (*BASE, *OHLCV)] + [f"R({c}) AS poly_{c}" for c in BASE] + [
    f"R({a} * {b}) AS poly_{a}_{b}" for a, b in combinations(BASE, 2)
]


@query("feature_matrix", f"WITH RECURSIVE {FIXED} SELECT symbol, ts, market_state, {', '.join(MATRIX)} FROM fixed", ("bars30",))
def _(spark, sf):
    matrix = S.build_features(bars30(spark, sf))
    return rounded(matrix, *BASE, *OHLCV, *S.interaction_names(BASE))


_PAIRS = ("open", "high", "low", "close")


@query(
    "interactions",
    "SELECT symbol, ts, "
    + ", ".join(f"{c} AS poly_{c}" for c in _PAIRS)
    + ", "
    + ", ".join(f"R({a} * {b}) AS poly_{a}_{b}" for a, b in combinations(_PAIRS, 2))
    + " FROM bars30",
    ("bars30",),
)
def _(spark, sf):
    wide = S.interactions(bars30(spark, sf), _PAIRS).drop(*OHLCV)
    return rounded(wide, *[f"poly_{a}_{b}" for a, b in combinations(_PAIRS, 2)])


@query(
    "interactions_squares",
    "SELECT symbol, ts, " + ", ".join(f"R({c} * {c}) AS poly_{c}" for c in _PAIRS) + " FROM bars30",
    ("bars30",),
)
def _(spark, sf):
    return rounded(S.interactions(bars30(spark, sf), _PAIRS, squares=True).drop(*OHLCV), *[f"poly_{c}" for c in _PAIRS])


@query("lasso_select")
def _(spark, sf):
    """Interaction columns with a nonzero L1 coefficient for the next change of close, with their rank."""
    matrix = stage(S.build_features(bars30(spark, sf)), "matrix")
    pairs = S.lasso_coefficients(matrix, S.interaction_names(BASE))
    rows = [(i + 1, c, v) for i, (c, v) in enumerate(pairs) if v != 0.0]
    return spark.createDataFrame(rows, "place int, feature string, coefficient double")


WIDE = f"""{bars()}, wide AS (SELECT symbol, ts, open, high, low, close, volume, close * 1.01 + 0.5 AS close_up, {pct('close', 1)} AS returns_1, {pct('close', 3)} AS returns_3,
   {vol(20, 5)} AS volatility, 0.25 + rn % 2 / 10000 AS flat FROM b)"""
WIDE_COLUMNS = ("open", "high", "low", "close", "volume", "close_up", "returns_1", "returns_3", "volatility", "flat")


def wide(spark, sf):
    df = stage(bars30(spark, sf), "bars")
    df = X.relative_changes(df, {"returns_1": ("close", 1), "returns_3": ("close", 3)})
    df = numbered(X.rolling_volatility(stage(df, "bars"), 20, 5), BARS)
    return df.withColumns({"close_up": F.col("close") * 1.01 + 0.5, "flat": 0.25 + F.col("rn") % 2 / 10000}).drop("rn")


def pair_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS corr FROM wide" for a, b in combinations(WIDE_COLUMNS, 2)
    )


@query("correlated_pairs", f"WITH {WIDE} SELECT first, second, R(corr) AS corr FROM ({pair_sql()})", ("bars30",))
def _(spark, sf):
    return rounded(S.correlated_pairs(wide(spark, sf), WIDE_COLUMNS), "corr")


@query(
    "drop_correlated",
    f"""WITH {WIDE} SELECT DISTINCT second AS column FROM ({pair_sql()}) WHERE abs(corr) > 0.95
        AND second NOT IN ('open', 'high', 'low', 'close', 'volume', 'market_state')""",
    ("bars30",),
)
def _(spark, sf):
    return S.correlated_columns(wide(spark, sf), WIDE_COLUMNS)


@query(
    "drop_low_variance",
    f"""WITH {WIDE} SELECT name AS column, R8(value) AS std FROM (SELECT stddev_samp(flat) AS flat, stddev_samp(returns_1) AS returns_1, stddev_samp(returns_3) AS returns_3,
          stddev_samp(volatility) AS volatility, stddev_samp(close_up) AS close_up FROM wide) UNPIVOT (value FOR name IN (flat, returns_1, returns_3, volatility, close_up)) WHERE value < 0.001""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(S.low_variance_columns(wide(spark, sf), WIDE_COLUMNS), "std", digits=8)


@query(
    "lasso_one_column",
    """WITH n AS (SELECT symbol, ts, open, high, low, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS y FROM bars30),
       k AS (SELECT * FROM n WHERE y IS NOT NULL), l AS (SELECT 'open' AS feature, open AS x, y FROM k UNION ALL SELECT 'high', high, y FROM k UNION ALL SELECT 'low', low, y FROM k)
       SELECT feature, R4(sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) - 500, 0) / var_pop(x)) AS coefficient FROM l GROUP BY 1""",
    ("bars30",),
)
def _(spark, sf):
    """With one column the L1 coefficient is the covariance, shrunk by the penalty, over the variance."""
    rows = stage(bars30(spark, sf), "bars")
    found = [S.lasso_coefficients(rows, [c], 500.0)[0] for c in ("open", "high", "low")]
    return rounded(spark.createDataFrame(found, "feature string, coefficient double"), "coefficient", digits=4)


@query(
    "lasso_two_columns",
    """WITH n AS (SELECT open AS a, volume::DOUBLE AS b, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS y FROM bars30),
       m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM n WHERE y IS NOT NULL),
       p AS (SELECT *, share * greatest(abs(ay), abs(byy)) AS k FROM m, (VALUES (0.02::DOUBLE), (0.3), (0.9), (1.1)) v(share), (VALUES (-1), (0), (1)) s(sa), (VALUES (-1), (0), (1)) t(sb)),
       x AS (SELECT *, CASE WHEN sa = 0 THEN 0 WHEN sb = 0 THEN (ay - k * sa) / aa ELSE ((ay - k * sa) * bb - (byy - k * sb) * ab) / (aa * bb - ab * ab) END AS wa,
                    CASE WHEN sb = 0 THEN 0 WHEN sa = 0 THEN (byy - k * sb) / bb ELSE ((byy - k * sb) * aa - (ay - k * sa) * ab) / (aa * bb - ab * ab) END AS wb FROM p),
       o AS (SELECT * FROM x WHERE sign(wa) = sa AND sign(wb) = sb AND (sa <> 0 OR abs(ay - ab * wb) <= k) AND (sb <> 0 OR abs(byy - ab * wa) <= k))
       SELECT share, R(wa) AS open, R8(wb) AS volume FROM o""",
    ("bars30",),
)
def _(spark, sf):
    """Of the nine patterns of signs the one that fulfils the conditions of optimality, for four penalties."""
    rows = stage(S.next_change(bars30(spark, sf).select("symbol", "ts", "open", "volume", "close")), "changes")
    _, _, matrix = S.covariances(rows, ["open", "volume", "label"])
    most = float(abs(matrix[:-1, -1]).max())
    found = [(share, *map(float, S.lasso(matrix[:-1, :-1], matrix[:-1, -1], share * most))) for share in (0.02, 0.3, 0.9, 1.1)]
    return rounded(rounded(spark.createDataFrame(found, "share double, open double, volume double"), "open"), "volume", digits=8)


@query(
    "protect",
    """SELECT 'close' AS name, count(close) AS known, TRUE AS kept FROM bars30 UNION ALL SELECT 'volume', count(volume), TRUE FROM bars30 UNION ALL SELECT 'market_state', count(*), TRUE FROM bars30
       UNION ALL SELECT 'poly_close', count(close), FALSE FROM bars30 UNION ALL SELECT 'closeness', count(*), FALSE FROM bars30""",
    ("bars30",),
)
def _(spark, sf):
    """Which columns of a table the patterns protect from selection."""
    rows = bars30(spark, sf).select("close", "volume", F.lit(1).alias("market_state"), F.col("close").alias("poly_close"), F.lit(1).alias("closeness"))
    kept = set(S.protect(rows.columns))
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("known"), F.lit(c in kept).alias("kept")) for c in rows.columns])))
