"""Repair of series tables: missing values, outliers, broken bars, and the cleaning recipe."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import OHLCV, PRICES, fill_time_gaps, resample_ohlcv
from tidemark.plans.parts import join_stats
from tidemark.plans.quantiles import quantile_columns
from tidemark.plans.series import BARS, Axis, Halo, latest, running, surrounded, upcoming
from tidemark.session import stage


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Complete cases only."""
    return df.na.drop(subset=list(cols) if cols else None)


def _passing(fill):
    """Rows that have no key or no stamp belong to no series: they pass on unchanged, with null in columns the fill adds."""
    names = list(signature(fill).parameters)

    @wraps(fill)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        axis = dict(zip(names[1:], args)).get("axis", named.get("axis", BARS))
        known = F.lit(True)
        for c in (*axis.keys, axis.ts):
            known = known & F.col(c).isNotNull()
        if "cols" in names:
            args = (list(args[0]), *args[1:]) if args else args
        return fill(df.filter(known), *args, **named).unionByName(df.filter(~known), allowMissingColumns=True)

    return run


@_passing
def interpolate_linear(df: DataFrame, cols: Sequence[str], axis: Axis = BARS) -> DataFrame:
    """Straight line by row position between known values.

    Rows after the last known value repeat it; rows before the first stay null.
    """
    cols = list(cols)
    around = surrounded(df, axis, cols)
    filled = {}
    for c in cols:
        v0, v1, at0, at1 = (F.col(f"_{n}_{c}.{f}") for f in ("value", "at") for n in ("prev", "next"))
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(at1.isNull(), v0)
            .when(at0.isNotNull(), v0 + (v1 - v0) * ((F.col("_rn") - at0) / (at1 - at0)))
        )
    return around.withColumns(filled).select(*df.columns)


def zero_fill(df: DataFrame, cols: Iterable[str] = ("volume",)) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


@_passing
def ffill(df: DataFrame, cols: Iterable[str], axis: Axis = BARS) -> DataFrame:
    """Nulls take the last known value before them."""
    return running(df, axis, **{c: latest(c) for c in cols}).select(*df.columns)


@_passing
def bfill(df: DataFrame, cols: Iterable[str], axis: Axis = BARS) -> DataFrame:
    """Nulls take the next known value after them."""
    return running(df, axis, **{c: upcoming(c) for c in cols}).select(*df.columns)


@_passing
def ffill_bfill(df: DataFrame, cols: Iterable[str], axis: Axis = BARS) -> DataFrame:
    """Forward, then backward, in one pass over the series."""
    cols = list(cols)
    both = {f"_prev_{c}": latest(c) for c in cols} | {f"_next_{c}": upcoming(c) for c in cols}
    filled = running(df, axis, **both)
    return filled.withColumns({c: F.coalesce(f"_prev_{c}", f"_next_{c}") for c in cols}).select(*df.columns)


def with_stats(df: DataFrame, stats: DataFrame, axis: Axis) -> DataFrame:
    return join_stats(df, stats, axis.keys)


def median_fill(df: DataFrame, cols: Sequence[str], axis: Axis = BARS) -> DataFrame:
    """Nulls take the median of their column and series."""
    medians = quantile_columns(df, {f"_median_{c}": (c, 0.5) for c in cols}, axis.keys)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in cols}
    return with_stats(df, medians, axis).withColumns(filled).select(*df.columns)


def mean_fill(df: DataFrame, cols: Sequence[str], axis: Axis = BARS) -> DataFrame:
    """Nulls take the mean of their column and series."""
    means = df.groupBy(*axis.keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in cols}
    return with_stats(df, means, axis).withColumns(filled).select(*df.columns)


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", axis: Axis = BARS) -> DataFrame:
    return {"median": median_fill, "mean": mean_fill}[strategy](df, cols, axis)


def iqr_bounds(df: DataFrame, cols: Sequence[str], axis: Axis = BARS, reach: float = 1.5) -> DataFrame:
    """Per series ``lo_<c>``, ``hi_<c>`` (quartiles -/+ reach * IQR) and ``median_<c>``."""
    names = {f"{q}_{c}": (c, p) for c in cols for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    q = quantile_columns(df, names, axis.keys)
    bounds = []
    for c in cols:
        spread = F.col(f"q3_{c}") - F.col(f"q1_{c}")
        bounds += [
            (F.col(f"q1_{c}") - reach * spread).alias(f"lo_{c}"),
            (F.col(f"q3_{c}") + reach * spread).alias(f"hi_{c}"),
            F.col(f"median_{c}"),
        ]
    return q.select(*axis.keys, *bounds)


def fix_outliers_iqr(df: DataFrame, cols: Sequence[str] = OHLCV, how: str = "median", axis: Axis = BARS) -> DataFrame:
    """Values outside the IQR fences: replace by the median, interpolate, or drop the row.

    Replacing one column leaves the others alone, so all fences come from one pass. Dropping takes the
    columns in turn, since the fences of a column use the rows its predecessors left; the rows are
    written between turns so that a turn does not recompute the ones before it.
    """
    cols = list(cols)
    if how == "drop":
        for i, c in enumerate(cols):
            kept = with_stats(df, iqr_bounds(df, [c], axis), axis)
            outside = (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
            df = kept.filter(~F.coalesce(outside, F.lit(False))).select(*df.columns)
            if i < len(cols) - 1:
                df = stage(df, "outliers")
        return df
    fenced = with_stats(df, iqr_bounds(df, cols, axis), axis)
    fixed = {}
    for c in cols:
        outside = (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
        instead = F.col(f"median_{c}") if how == "median" else F.lit(None)
        fixed[c] = F.when(outside, instead).otherwise(F.col(c).cast("double"))
    fixed_df = fenced.withColumns(fixed).select(*df.columns)
    return fixed_df if how == "median" else interpolate_linear(fixed_df, cols, axis)


def high_ok() -> Column:
    return (F.col("high") >= F.col("open")) & (F.col("high") >= F.col("close")) & (F.col("high") >= F.col("low"))


def low_ok() -> Column:
    return (F.col("low") <= F.col("open")) & (F.col("low") <= F.col("close")) & (F.col("low") <= F.col("high"))


def filter_valid_ohlc(df: DataFrame) -> DataFrame:
    """Rows whose high and low bound the bar and whose prices are positive."""
    positive = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    return df.filter(high_ok() & low_ok() & positive)


def fix_negative_volume(df: DataFrame, how: str = "zero") -> DataFrame:
    """Negative volume becomes 0, or the row goes; null volume stays."""
    negative = F.coalesce(F.col("volume") < 0, F.lit(False))
    if how == "drop":
        return df.filter(~negative)
    return df.withColumn("volume", F.when(negative, 0).otherwise(F.col("volume")).cast(df.schema["volume"].dataType))


def winsorize(df: DataFrame, cols: Sequence[str] = PRICES, axis: Axis = BARS) -> DataFrame:
    """Clip to q05 - 3 * (q95 - q05) .. q95 + 3 * (q95 - q05)."""
    q = quantile_columns(df, {f"_{n}_{c}": (c, p) for c in cols for n, p in (("lo", 0.05), ("hi", 0.95))}, axis.keys)
    clipped = {}
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        reach = 3 * (hi - lo)
        clipped[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo - reach), hi + reach))
    return with_stats(df, q, axis).withColumns(clipped).select(*df.columns)


def nonfinite_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: F.when(F.abs(c) < F.lit(float("inf")), F.col(c)) for c in cols})


def strip_zero_bars(df: DataFrame, axis: Axis = BARS, extra: Sequence[str] = ()) -> DataFrame:
    """Bars with a null or 0 in any of open..volume go; zeros in ``extra`` columns are filled instead."""
    nulled = df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in (*OHLCV, *extra)})
    kept = nulled.na.drop(subset=list(OHLCV))
    return ffill_bfill(kept, extra, axis) if extra else kept


@_passing
def adaptive_null_fix(df: DataFrame, cols: Sequence[str], axis: Axis = BARS) -> DataFrame:
    """Per series and column: all null (or absent) 0, mostly null the median, else the neighbours' value."""
    absent = [c for c in cols if c not in df.columns]
    df = df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
    cols = [c for c in cols if c not in absent]
    shares = df.groupBy(*axis.keys).agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"_known_{c}") for c in cols])
    medians = quantile_columns(df, {f"_median_{c}": (c, 0.5) for c in cols}, axis.keys)
    around = {f"_prev_{c}": latest(c) for c in cols} | {f"_next_{c}": upcoming(c) for c in cols}
    filled = with_stats(with_stats(running(df, axis, **around), shares, axis), medians, axis)
    fixed = {}
    for c in cols:
        by_median = F.coalesce(F.col(c), F.col(f"_median_{c}"))
        by_neighbour = F.coalesce(F.col(c), F.col(f"_prev_{c}"), F.col(f"_next_{c}"))
        fixed[c] = F.coalesce(F.when(F.col(f"_known_{c}") < 0.8, by_median).otherwise(by_neighbour), F.lit(0.0))
    return filled.withColumns(fixed).select(*df.columns)


PROTECTED = ("close", "open", "high", "low", "volume", "market_state")


@_passing
def rebuild_protected(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Restore absent required columns: close from last/price, open from the close before it, high and low
    from close, volume 0, state neutral."""
    if "close" not in df.columns:
        source = next((c for c in ("last", "price") if c in df.columns), None)
        df = df.withColumn("close", F.col(source) if source else F.lit(0.0))
    simple = {c: F.col("close") for c in ("high", "low") if c not in df.columns}
    if "volume" not in df.columns:
        simple["volume"] = F.lit(0).cast("bigint")
    if "market_state" not in df.columns:
        simple["market_state"] = F.lit(1)
    df = df.withColumns(simple) if simple else df
    if "open" not in df.columns:
        halo = Halo.spread(df, axis, back=1)
        df = halo.settle(halo.frame.withColumn("open", F.lag("close").over(halo.w)))
        df = ffill(df, ["open"], axis)
    return df


@_passing
def recompute_dead_features(df: DataFrame, axis: Axis = BARS, volatility: str = "volatility", returns: str = "returns_1") -> DataFrame:
    """Per series: an all-zero volatility column, or a volatility or return column with over 30% nulls, is
    computed anew from close (volatility over 20 rows, one-row return)."""
    share = [
        (F.sum((F.col(volatility) != 0).cast("int")) == 0).alias("_dead"),
        (F.avg(F.col(volatility).isNull().cast("int")) > 0.3).alias("_sparse_v"),
        (F.avg(F.col(returns).isNull().cast("int")) > 0.3).alias("_sparse_r"),
    ]
    flags = df.groupBy(*axis.keys).agg(*share)
    halo = Halo.spread(df, axis, back=21)
    change = F.col("close") / F.nullif(F.lag("close").over(halo.w), F.lit(0.0)) - 1
    frame = halo.frame.withColumn("_ret", F.when(F.abs(change) < F.lit(float("inf")), change))
    over = halo.last(20)
    spread = F.stddev_samp("_ret").over(over)
    frame = frame.withColumns({"_strict": F.when(F.count("_ret").over(over) >= 20, spread), "_loose": F.coalesce(spread, F.lit(0.0))})
    rows = with_stats(halo.settle(frame), flags, axis)
    fixed = {
        volatility: F.when(F.col("_dead"), F.col("_strict")).when(F.col("_sparse_v"), F.col("_loose")).otherwise(F.col(volatility)),
        returns: F.when(F.col("_sparse_r"), F.coalesce(F.col("_ret"), F.lit(0.0))).otherwise(F.col(returns)),
    }
    return rows.withColumns(fixed).select(*df.columns)


@dataclass(frozen=True)
class Recipe:
    """What ``clean`` does in each step; ``seconds`` is the target bar length (None: keep the frequency)."""

    missing: str = "interpolate"
    valid_ohlc: bool = True
    negative_volume: str = "zero"
    outliers: str = "median"
    seconds: int | None = 1800
    fill_gaps: bool = True


MODES = {
    "conservative": Recipe(valid_ohlc=False),
    "standard": Recipe(),
    "strict": Recipe(missing="drop", negative_volume="drop", outliers="drop"),
}


def fix_missing(df: DataFrame, how: str, axis: Axis = BARS) -> DataFrame:
    """One of drop, interpolate (prices; volume 0), ffill, bfill, median, mean."""
    if how == "drop":
        return drop_null_rows(df, OHLCV)
    if how == "interpolate":
        return zero_fill(interpolate_linear(df, PRICES, axis), ["volume"])
    return {"ffill": ffill, "bfill": bfill, "median": median_fill, "mean": mean_fill}[how](df, OHLCV, axis)


def clean_steps(df: DataFrame, mode: str | Recipe = "standard", axis: Axis = BARS) -> list[tuple[str, DataFrame]]:
    """The table after each step of the recipe, in order. Two steps are written: before the quartiles, which read their
    rows several times, and behind the resampling; a derived input that is dear to compute should be staged before."""
    recipe = MODES[mode] if isinstance(mode, str) else mode
    steps = [("input", df)]

    def then(name: str, out: DataFrame, written: bool = True) -> None:
        steps.append((name, stage(out, "clean") if written else out))

    then("missing", fix_missing(steps[-1][1], recipe.missing, axis), written=False)
    if recipe.valid_ohlc:
        then("ohlc", filter_valid_ohlc(steps[-1][1]), written=False)
    then("volume", fix_negative_volume(steps[-1][1], recipe.negative_volume))
    then("outliers", fix_outliers_iqr(steps[-1][1], OHLCV, recipe.outliers, axis), written=recipe.seconds is None)
    if recipe.seconds:
        then("resample", resample_ohlcv(steps[-1][1], recipe.seconds, axis))
        if recipe.fill_gaps:
            then("gaps", fill_time_gaps(steps[-1][1], recipe.seconds, axis.with_(ties=())), written=False)
    return steps


def clean(df: DataFrame, mode: str | Recipe = "standard", axis: Axis = BARS) -> DataFrame:
    """Missing values, broken bars, negative volume, outliers, frequency, gaps - in this order."""
    return clean_steps(df.select(*axis.id, *OHLCV), mode, axis)[-1][1]


def cleaning_log(df: DataFrame, mode: str | Recipe = "standard", axis: Axis = BARS) -> DataFrame:
    """Rows of each series after every step of ``clean`` and how many the step added or took.

    A series that a step leaves without rows is told with 0 from there on; rows without a key are a series of their own here
    (bars without a stamp or a key go when bars are resampled and put on a grid, and only there).
    """
    steps = clean_steps(df.select(*axis.id, *OHLCV), mode, axis)
    keys = list(axis.keys)
    counts = None
    for place, (name, frame) in enumerate(steps):
        part = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumns(
            {"step_no": F.lit(place), "step": F.lit(name)}
        )
        counts = part if counts is None else counts.unionByName(part)
        if place == 0:
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step")) for i, (n, _) in enumerate(steps)]))
            none = part.select(*keys, F.lit(0).cast("bigint").alias("rows"), each.alias("_s")).select(*keys, "rows", "_s.*")
            counts = counts.unionByName(none)
    counts = counts.groupBy(*keys, "step_no", "step").agg(F.sum("rows").alias("rows"))
    before = F.lag("rows").over(Window.partitionBy(*keys).orderBy("step_no"))
    return counts.withColumn("affected", F.abs(F.col("rows") - before)).select(*keys, "rows", "step_no", "step", "affected")
