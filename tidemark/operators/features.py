"""Feature matrices: interactions, selection and pruning of columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import PROTECTED, adaptive_null_fix, strip_zero_bars
from tidemark.operators.indicators import BASE_FEATURES, base_features
from tidemark.operators.keys import OHLCV, PRICES
from tidemark.plans.series import BARS, Axis, Halo
from tidemark.session import stage

# Patterns of columns that selection never drops.
PROTECTED_PATTERNS = (
    "^datetime$",
    "^open$",
    "^high$",
    "^low$",
    "^close$",
    "^volume$",
    "^market_state$",
    "^scaled_rsi$",
    "^scaled_macd_hist$",
)


def protect(cols: Iterable[str], patterns: Sequence[str] = PROTECTED_PATTERNS) -> list[str]:
    """The columns that match a pattern from their start."""
    return [c for c in cols if any(re.match(p, c) for p in patterns)]


def interaction_names(cols: Sequence[str]) -> list[str]:
    return [f"poly_{c}" for c in cols] + [f"poly_{a}_{b}" for a, b in combinations(cols, 2)]


def interactions(df: DataFrame, cols: Sequence[str] = BASE_FEATURES, squares: bool = False) -> DataFrame:
    """Append the columns and all their pairwise products (or, with ``squares``, only the squares); a
    missing or infinite value counts as 0. One projection."""
    known = {c: F.when(F.abs(c) < F.lit(float("inf")), F.col(c).cast("double")).otherwise(0.0) for c in cols}
    if squares:
        return df.select("*", *[(known[c] * known[c]).alias(f"poly_{c}") for c in cols])
    single = [known[c].alias(f"poly_{c}") for c in cols]
    pairs = [(known[a] * known[b]).alias(f"poly_{a}_{b}") for a, b in combinations(cols, 2)]
    return df.select("*", *single, *pairs)


def feature_matrix(df: DataFrame, chosen: Sequence[str] | None = None, base: Sequence[str] = BASE_FEATURES, axis: Axis = BARS) -> DataFrame:
    """Base features, chosen interactions, prices and regime; absent base features are 0, an absent
    regime is neutral."""
    absent = {c: F.lit(0.0) for c in base if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    state = F.coalesce(F.col("market_state"), F.lit(1)) if "market_state" in df.columns else F.lit(1)
    wide = interactions(df, base)
    names = interaction_names(base) if chosen is None else [c for c in interaction_names(base) if c in set(chosen)]
    rest = [c for c in OHLCV if c in df.columns]
    return wide.select(*axis.id, *base, *names, *rest, state.cast("int").alias("market_state"))


def build_features(df: DataFrame, chosen: Sequence[str] | None = None, axis: Axis = BARS) -> DataFrame:
    """Bars to feature matrix: bars with zero fields go, indicators and regime, nulls fixed, interactions."""
    bars = stage(strip_zero_bars(df.select(*axis.id, *OHLCV), axis), "bars")
    features = stage(base_features(bars, axis), "features")
    return feature_matrix(adaptive_null_fix(features, BASE_FEATURES, axis), chosen, axis=axis)


def next_change(df: DataFrame, column: str = "close", name: str = "label", axis: Axis = BARS) -> DataFrame:
    """Append the change to the next row's value (null on the last row)."""
    h = Halo.spread(df, axis, ahead=1)
    return h.settle(h.frame.withColumn(name, F.lead(column).over(h.w) - F.col(column)))


def covariances(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of complete rows, means and covariances (over all rows) of ``cols``.

    One pass finds the means, another the products of deviations: tasks add up a matrix each, so columns squared numbers
    a task are grouped and come back.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    known = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), rows.columns, F.lit(True))
    rows = rows.filter(known)
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in rows.columns]).first()
    size, n = len(cols), one["n"]
    means = np.array([one[c] or 0.0 for c in rows.columns])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            total += x.T @ x
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    matrix = np.zeros((size, size))
    for r in rows.mapInArrow(products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["x"] / n if n else 0.0
    return n, means, matrix


def lasso(matrix: np.ndarray, target: np.ndarray, penalty: float, tolerance: float = 1e-10) -> np.ndarray:
    """Least b @ matrix @ b / 2 - target @ b + penalty * sum(abs(b)), by soft thresholds, one coefficient after the other.

    Once the nonzero ones and their signs stay, they are solved for together; the result is taken if it fulfils the
    conditions of optimality: a slope of exactly the penalty, against the sign, or of at most that at zero.
    """
    spread = np.sqrt(np.diag(matrix))
    used = np.flatnonzero(spread > 0)
    b = np.zeros(len(target))
    if not len(used):
        return b
    # In units of one deviation all columns are alike; the penalty is then each column's own.
    g, c, limit = matrix[np.ix_(used, used)] / np.outer(spread[used], spread[used]), target[used] / spread[used], penalty / spread[used]
    z, scale = np.zeros(len(used)), max(np.abs(c).max(), np.finfo(float).tiny)

    def off(x: np.ndarray) -> float:
        slope = c - g @ x
        return np.where(x != 0, np.abs(slope - limit * np.sign(x)), np.maximum(np.abs(slope) - limit, 0)).max() / scale

    for sweep in range(100_000):
        for j in range(len(z)):
            slope = c[j] - g[j] @ z + g[j, j] * z[j]
            z[j] = np.sign(slope) * max(abs(slope) - limit[j], 0) / g[j, j]
        if sweep % 20 == 19:
            some = np.flatnonzero(z)
            exact = np.zeros(len(z))
            exact[some] = np.linalg.lstsq(g[np.ix_(some, some)], (c - limit * np.sign(z))[some], rcond=None)[0]
            if (np.sign(exact) == np.sign(z)).all() and off(exact) <= tolerance:
                z = exact
                break
            if off(z) <= tolerance:
                break
    b[used] = z / spread[used]
    return b


def lasso_coefficients(df: DataFrame, cols: Sequence[str], penalty: float = 0.005, axis: Axis = BARS) -> list[tuple[str, float]]:
    """L1 coefficients for the next change of close, by size, over rows with all values; the covariances are aggregates,
    and the fit takes as many numbers as there are columns, squared."""
    labeled = next_change(df.select(*axis.id, "close", *[c for c in cols if c != "close"]), axis=axis)
    _, _, matrix = covariances(labeled, [*cols, "label"])
    found = lasso(matrix[:-1, :-1], matrix[:-1, -1], penalty)
    return sorted(zip(cols, map(float, found)), key=lambda p: (-abs(p[1]), p[0]))


def lasso_select(df: DataFrame, cols: Sequence[str], penalty: float = 0.005, axis: Axis = BARS) -> list[str]:
    """Columns with a nonzero L1 coefficient, by size, then protected ones."""
    chosen = [c for c, v in lasso_coefficients(df, cols, penalty, axis) if v != 0.0]
    return chosen + [c for c in protect(cols) if c not in chosen]


def correlated_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (first, second, corr) for every pair of columns, from one aggregate over complete pairs."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*entries)))


def correlated_columns(df: DataFrame, cols: Sequence[str], limit: float = 0.95, keep: Sequence[str] = PROTECTED) -> DataFrame:
    """Later columns of pairs whose absolute correlation exceeds ``limit``, protected ones excepted."""
    high = correlated_pairs(df, cols).filter((F.abs("corr") > limit) & ~F.isnan("corr"))
    return high.filter(~F.col("second").isin(*keep)).select(F.col("second").alias("column")).distinct()


def drop_correlated(df: DataFrame, cols: Sequence[str], limit: float = 0.95, keep: Sequence[str] = PROTECTED) -> DataFrame:
    """``df`` without those columns; the list read here has at most one row per column."""
    return df.drop(*[r["column"] for r in correlated_columns(df, cols, limit, keep).collect()])


def low_variance_columns(df: DataFrame, cols: Sequence[str], limit: float = 0.001, keep: Sequence[str] = (*PROTECTED, *PRICES)) -> DataFrame:
    """Columns whose deviation is below ``limit``, protected ones and prices excepted."""
    one = df.agg(*[F.stddev_samp(c).alias(f"_{c}") for c in cols])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("std")) for c in cols if c not in keep]
    return one.select(F.inline(F.array(*entries))).filter(F.col("std") < limit)


def drop_low_variance(df: DataFrame, cols: Sequence[str], limit: float = 0.001) -> DataFrame:
    return df.drop(*[r["column"] for r in low_variance_columns(df, cols, limit).collect()])
