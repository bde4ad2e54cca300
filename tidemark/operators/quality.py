"""Quality tables: one row per finding, statistics per series, gates and summaries.

Checks never change their input; repairs are functions of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import sample_kurtosis, sample_skewness
from tidemark.operators.clean import ffill, high_ok, interpolate_linear, iqr_bounds, low_ok, with_stats
from tidemark.operators.keys import OHLCV, PRICES, dedupe_ts, missing_grid_points, steps
from tidemark.plans.parts import join_stats
from tidemark.plans.quantiles import exact_quantiles
from tidemark.plans.series import BARS, Axis, Halo
from tidemark.session import stage

# Severities in rising order.
SEVERITY = ("healthy", "warning", "critical", "failed")
ISSUE_COLUMNS = ("issue_type", "severity", "column", "value")


def severity_rank(column: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITY):
        rank = F.when(column == name, i).otherwise(rank)
    return rank


def _issue(kind: str, severity: Column | str, column: Column | str, value: Column, when: Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("issue_type"),
            as_column(severity).alias("severity"),
            as_column(column).alias("column"),
            value.cast("double").alias("value"),
        ),
    )


def _issues(stats: DataFrame, axis: Axis, found: Sequence[Column]) -> DataFrame:
    """Turn candidate issues of one statistics row per series into issue rows."""
    rows = stats.select(*axis.keys, F.explode(F.array_compact(F.array(*found))).alias("_issue"))
    return rows.select(*axis.keys, "_issue.*")


def check_missing(
    df: DataFrame, cols: Sequence[str] = OHLCV, threshold: float = 0.1, zero_threshold: float = 0.05, axis: Axis = BARS
) -> DataFrame:
    """Share of nulls per column: over ``threshold`` critical, over 0 a warning; many zeros are a warning."""
    return _issues(df.groupBy(*axis.keys).agg(*_missing_stats(cols)), axis, _missing_found(cols, threshold, zero_threshold))


def _missing_stats(cols: Sequence[str]) -> list[Column]:
    n = F.count(F.lit(1))
    nulls = [(F.count_if(F.col(c).isNull()) / n).alias(f"null_{c}") for c in cols]
    return [*nulls, *[(F.count_if(F.col(c) == 0) / n).alias(f"zero_{c}") for c in cols]]


def _missing_found(cols: Sequence[str], threshold: float = 0.1, zero_threshold: float = 0.05) -> list[Column]:
    found = []
    for c in cols:
        share, zeros = F.col(f"null_{c}"), F.col(f"zero_{c}")
        severity = F.when(share > threshold, "critical").otherwise("warning")
        found.append(_issue("missing_values", severity, c, share, share > 0))
        found.append(_issue("zero_values", "warning", c, zeros, zeros > zero_threshold))
    return found


def repair_missing(df: DataFrame, cols: Sequence[str] = OHLCV, threshold: float = 0.1, axis: Axis = BARS) -> DataFrame:
    """Per series: prices with many nulls are interpolated, with few carried forward; few null volumes
    become 0, few nulls elsewhere are interpolated; rows still incomplete go."""
    cols = list(cols)
    shares = df.groupBy(*axis.keys).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"_null_{c}") for c in cols])
    copies = df.withColumns({f"_line_{c}": F.col(c) for c in cols if c != "volume"} | {f"_carry_of_{c}": F.col(c) for c in cols if c in PRICES})
    filled = interpolate_linear(copies, [f"_line_{c}" for c in cols if c != "volume"], axis)
    filled = with_stats(ffill(filled, [f"_carry_of_{c}" for c in cols if c in PRICES], axis), shares, axis)
    fixed = {}
    for c in cols:
        few = F.col(f"_null_{c}") <= threshold
        if c in PRICES:
            instead = F.when(few, F.col(f"_carry_of_{c}")).otherwise(F.col(f"_line_{c}"))
        elif c == "volume":
            instead = F.when(few, F.lit(0))
        else:
            instead = F.when(few, F.col(f"_line_{c}"))
        fixed[c] = F.coalesce(F.col(c), instead)
    return filled.withColumns(fixed).select(*df.columns).na.drop(subset=cols)


def _moments(cols: Sequence[str]) -> list[Column]:
    return [*[F.avg(c).alias(f"avg_{c}") for c in cols], *[F.stddev_samp(c).alias(f"std_{c}") for c in cols]]


def outlier_stats(df: DataFrame, cols: Sequence[str] = OHLCV, z: float = 3.0, axis: Axis = BARS, moments: DataFrame | None = None) -> DataFrame:
    """Per series and column: values outside the IQR fences or with abs z-score over ``z``; fences; negatives.

    The rows are read twice: fences, means and deviations first, then the counts.
    """
    cols = list(cols)
    keys = list(axis.keys)
    if moments is None:
        moments = df.groupBy(*keys).agg(*_moments(cols))
    limits = iqr_bounds(df, cols, axis).join(moments, keys)
    rows = with_stats(df, limits, axis)
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_outlier(c, z)).alias(f"n_{c}") for c in cols],
        *[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in cols],
        *[F.first(f"{e}_{c}").alias(f"{e}_{c}") for c in cols for e in ("lo", "hi")],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n_{c}").alias("n_outliers"),
            (F.col(f"n_{c}") / F.col("rows")).alias("ratio"),
            F.col(f"lo_{c}").alias("lower"),
            F.col(f"hi_{c}").alias("upper"),
            F.col(f"neg_{c}").alias("n_negative"),
        )
        for c in cols
    ]
    return counts.select(*keys, F.inline(F.array(*entries)))


def is_outlier(c: str, z: float = 3.0) -> Column:
    """Needs lo_, hi_, avg_ and std_ columns of ``c`` on the row."""
    far = F.when(F.col(f"std_{c}") > 0, F.abs(F.col(c) - F.col(f"avg_{c}")) / F.col(f"std_{c}") > z)
    outside = (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
    return F.coalesce(outside, F.lit(False)) | F.coalesce(far, F.lit(False))


def check_outliers(df: DataFrame, cols: Sequence[str] = OHLCV, z: float = 3.0, axis: Axis = BARS, moments: DataFrame | None = None) -> DataFrame:
    """Share of outliers over 5% a warning, over 10% critical; negative volume critical."""
    stats = outlier_stats(df, cols, z, axis, moments)
    ratio, negative = F.col("ratio"), F.col("n_negative")
    severity = F.when(ratio > 0.1, "critical").otherwise("warning")
    return _issues(
        stats,
        axis,
        [
            _issue("outliers", severity, F.col("column"), ratio, ratio > 0.05),
            _issue("volume_anomaly", "critical", F.col("column"), negative, (F.col("column") == "volume") & (negative > 0)),
        ],
    )


def repair_outliers(df: DataFrame, z: float = 3.0, axis: Axis = BARS) -> DataFrame:
    """Outlying prices become the median of their series, negative volume becomes 0."""
    cols, keys = list(PRICES), list(axis.keys)
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols], *[F.stddev_samp(c).alias(f"std_{c}") for c in cols]
    )
    rows = with_stats(df, iqr_bounds(df, cols, axis).join(moments, keys), axis)
    fixed = {c: F.when(is_outlier(c, z), F.col(f"median_{c}")).otherwise(F.col(c)) for c in cols}
    fixed["volume"] = F.when(F.col("volume") < 0, F.lit(0)).otherwise(F.col("volume")).cast(df.schema["volume"].dataType)
    return rows.withColumns(fixed).select(*df.columns)


def step_stats(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Per series: steps, modal step, its share, gaps over twice the mode, doubled stamps."""
    lengths = steps(df.select(*axis.id), axis).filter("step is not null")
    counts = lengths.groupBy(*axis.keys, "step").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "steps")  # a row for each length of step, read twice
    best = counts.groupBy(*axis.keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "step"))["step"].alias("modal_step"))
    joined = join_stats(counts, best, axis.keys)
    return joined.groupBy(*axis.keys).agg(
        F.sum("n").alias("n_steps"),
        F.max("modal_step").alias("modal_step"),
        (F.sum(F.when(F.col("step") == F.col("modal_step"), F.col("n"))) / F.sum("n")).alias("consistency"),
        F.coalesce(F.sum(F.when(F.col("step") > 2 * F.col("modal_step"), F.col("n"))), F.lit(0)).alias("n_gaps"),
        F.coalesce(F.sum(F.when(F.col("step") == 0, F.col("n"))), F.lit(0)).alias("n_doubled"),
        F.max("step").alias("longest_step"),
    )


def _continuity_issues() -> list[Column]:
    gaps, doubled = F.col("n_gaps"), F.col("n_doubled")
    severity = F.when(gaps / (F.col("n_steps") + 1) > 0.05, "critical").otherwise("warning")
    return [
        _issue("time_continuity", severity, "index", gaps, gaps > 0),
        _issue("duplicate_timestamps", "warning", "index", doubled, doubled > 0),
    ]


def _frequency_issue() -> Column:
    return _issue("frequency_consistency", "warning", "index", F.col("consistency"), F.col("consistency") < 0.9)


def check_continuity(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Gaps over twice the modal step (over 5% of rows critical) and doubled stamps (a warning)."""
    return _issues(step_stats(df, axis), axis, _continuity_issues())


def check_frequency(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """The modal step makes up less than 90% of the steps."""
    return _issues(step_stats(df, axis), axis, [_frequency_issue()])


def range_stats(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Per series: broken highs and lows, and prices <= 0, where each price looks only at rows whose earlier
    prices were positive."""
    return df.groupBy(*axis.keys).agg(*_range_counts())


def _range_counts() -> list[Column]:
    counts = [F.count_if(~high_ok()).alias("bad_high"), F.count_if(~low_ok()).alias("bad_low")]
    so_far = F.lit(True)
    for c in PRICES:
        counts.append(F.count_if(so_far & (F.col(c) <= 0)).alias(f"nonpositive_{c}"))
        so_far = so_far & (F.col(c) > 0)
    return counts


def check_ranges(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    return _issues(range_stats(df, axis), axis, _range_found())


def _range_found() -> list[Column]:
    found = [
        _issue("price_anomaly", "critical", "high", F.col("bad_high"), F.col("bad_high") > 0),
        _issue("price_anomaly", "critical", "low", F.col("bad_low"), F.col("bad_low") > 0),
    ]
    for c in PRICES:
        n = F.col(f"nonpositive_{c}")
        found.append(_issue("price_anomaly", "critical", c, n, n > 0))
    return found


def describe_columns(df: DataFrame, cols: Sequence[str] = OHLCV, axis: Axis = BARS) -> DataFrame:
    """count, mean, std, min, quartiles, max per series and column."""
    cols, keys = list(cols), list(axis.keys)
    long = df.select(*keys, *[F.col(c).cast("double") for c in cols]).unpivot(keys, cols, "column", "x")
    moments = long.groupBy(*keys, "column").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75], keys).select(
        *keys, "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")
    )
    return moments.join(quartiles, [*keys, "column"], "left")


def with_return(df: DataFrame, axis: Axis = BARS, name: str = "ret", k: int = 1, column: str = "close") -> DataFrame:
    """Append the relative change over ``k`` rows; a change from 0 is null."""
    halo = Halo.spread(df, axis, back=k)
    change = F.col(column) / F.nullif(F.lag(column, k).over(halo.w), F.lit(0.0)) - 1
    return halo.settle(halo.frame.withColumn(name, change))


def series_stats(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Span and return statistics per series; skewness and kurtosis are the sample-corrected ones."""
    returns = with_return(df.select(*axis.id, "close"), axis)
    n = F.count("ret")
    return returns.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(axis.ts).alias("first_ts"),
        F.max(axis.ts).alias("last_ts"),
        F.avg("ret").alias("mean_return"),
        F.stddev_samp("ret").alias("volatility"),
        F.max("ret").alias("max_return"),
        F.min("ret").alias("min_return"),
        sample_skewness(F.skewness("ret"), n).alias("skewness"),
        sample_kurtosis(F.kurtosis("ret"), n).alias("kurtosis"),
    )


def basic_stats(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """One row per series with all that one pass can tell: rows, nulls, zeros, moments, ranges."""
    return df.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("rows"), *_missing_stats(OHLCV), *_moments(OHLCV), *_range_counts())


def all_issues(df: DataFrame, axis: Axis = BARS, stats: DataFrame | None = None) -> DataFrame:
    """Issue rows of every check. ``df`` is read once for the basic statistics (unless given), twice for quartiles, once for
    outliers and for the steps; so stage a derived table first."""
    stats = stage(basic_stats(df, axis), "stats") if stats is None else stats
    found = _issues(stats, axis, [*_missing_found(OHLCV), *_range_found()])
    gaps = _issues(step_stats(df, axis), axis, [*_continuity_issues(), _frequency_issue()])
    moments = stats.select(*axis.keys, *[f"{m}_{c}" for m in ("avg", "std") for c in OHLCV])
    return found.unionByName(check_outliers(df, axis=axis, moments=moments)).unionByName(gaps)


# Issue types of a report.
ISSUE_TYPES = (
    "missing_values",
    "zero_values",
    "outliers",
    "volume_anomaly",
    "time_continuity",
    "duplicate_timestamps",
    "frequency_consistency",
    "price_anomaly",
)


def summarize_issues(rows: DataFrame, issues: DataFrame, axis: Axis = BARS) -> DataFrame:
    """One row per series of ``rows`` (symbol, rows): status, counts by severity and by type."""
    severity = F.col("severity")
    counts = issues.groupBy(*axis.keys).agg(
        F.max(severity_rank(severity)).alias("_worst"),
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(severity == "critical").alias("critical_issues"),
        F.count_if(severity == "warning").alias("warning_issues"),
        *[F.count_if(F.col("issue_type") == t).alias(f"n_{t}") for t in ISSUE_TYPES],
    )
    joined = rows.join(counts, list(axis.keys), "left")
    numbers = ["total_issues", "critical_issues", "warning_issues", *[f"n_{t}" for t in ISSUE_TYPES]]
    status = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(F.col("_worst"), F.lit(0)) + 1)
    return joined.select(*rows.columns, status.alias("status"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])


def repair(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """The checks' repairs in their order: nulls, outliers, doubled stamps, prices <= 0."""
    filled = stage(repair_missing(df, axis=axis), "repair")
    single = dedupe_ts(repair_outliers(filled, axis=axis), axis)
    return single.filter((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))


def health_report(df: DataFrame, axis: Axis = BARS, repaired: DataFrame | None = None) -> DataFrame:
    """Status, issue counts and, when the repaired table is given, the rows it lost."""
    stats = stage(basic_stats(df, axis), "stats")
    report = summarize_issues(stats.select(*axis.keys, "rows"), all_issues(df, axis, stats), axis)
    if repaired is None:
        return report
    left = repaired.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("_left"))
    report = report.join(left, list(axis.keys), "left")
    removed = F.col("rows") - F.coalesce(F.col("_left"), F.lit(0))
    return report.withColumns({"rows_removed": removed, "removed_pct": removed / F.col("rows") * 100}).drop("_left")


def legacy_health(df: DataFrame, cols: Sequence[str] = OHLCV, axis: Axis = BARS) -> DataFrame:
    """The older check: worst null, zero and 5-sigma shares over the columns, flags and two statistics."""
    cols, keys = list(cols), list(axis.keys)
    halo = Halo.spread(df, axis, back=1)
    change = F.col("close") / F.nullif(F.lag("close").over(halo.w), F.lit(0.0)) - 1
    step = F.unix_micros(F.col(axis.ts).cast("timestamp")) - F.unix_micros(F.lag(axis.ts).over(halo.w).cast("timestamp"))
    rows = halo.settle(halo.frame.withColumns({"_ret": change, "_step": step}))
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols], *[F.stddev_samp(c).alias(f"std_{c}") for c in cols]
    )
    n = F.count(F.lit(1))
    far = [F.count_if(F.abs(F.col(c) - F.col(f"avg_{c}")) > 5 * F.col(f"std_{c}")) / n for c in cols]
    stats = with_stats(rows, moments, axis).groupBy(*keys).agg(
        F.greatest(*[F.count_if(F.col(c).isNull()) / n for c in cols]).alias("missing_ratio"),
        F.greatest(*[F.count_if(F.col(c) == 0) / n for c in cols]).alias("zero_ratio"),
        F.greatest(*far).alias("outlier_ratio"),
        (F.count_if(F.col("volume") < 0) > 0).alias("negative_volume"),
        (F.coalesce(F.max("_step"), F.lit(0)) > 129_600 * 1_000_000).alias("discontinuous"),
        F.stddev_samp("_ret").alias("volatility"),
        sample_skewness(F.skewness("volume"), F.count("volume")).alias("volume_skew"),
    )
    bad = [F.col("missing_ratio") > 0.1, F.col("zero_ratio") > 0.05, F.col("negative_volume"), F.col("discontinuous")]
    n_issues = sum((b.cast("int") for b in bad[1:]), bad[0].cast("int"))
    return stats.withColumns({"n_issues": n_issues, "is_clean": F.col("missing_ratio") == 0})


def quality_profile(df: DataFrame, seconds: int, cols: Sequence[str] = OHLCV, axis: Axis = BARS) -> DataFrame:
    """Missing share, close statistics, absent grid points and IQR outliers of close per series."""
    keys = list(axis.keys)
    limits = iqr_bounds(df, ["close"], axis)
    n = F.count(F.lit(1))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    outside = (F.col("close") < F.col("lo_close")) | (F.col("close") > F.col("hi_close"))
    profile = with_stats(df, limits, axis).groupBy(*keys).agg(
        n.alias("total_records"),
        nulls.alias("missing_count"),
        (nulls / (n * len(cols)) * 100).alias("missing_pct"),
        F.avg("close").alias("close_mean"),
        F.stddev_samp("close").alias("close_std"),
        F.min("close").alias("close_min"),
        F.max("close").alias("close_max"),
        F.count_if(outside).alias("outlier_count"),
        (F.count_if(outside) / n * 100).alias("outlier_pct"),
        F.first("lo_close").alias("outlier_lower"),
        F.first("hi_close").alias("outlier_upper"),
        F.count_distinct(axis.ts).alias("_stamps"),
    )
    gaps = missing_grid_points(df, seconds, axis).groupBy(*keys).agg(F.count(F.lit(1)).alias("_gaps"))
    joined = profile.join(gaps, keys, "left")
    missing = F.coalesce(F.col("_gaps"), F.lit(0))
    return joined.withColumns(
        {"grid_missing": missing, "grid_missing_pct": missing / (missing + F.col("_stamps")) * 100}
    ).drop("_gaps", "_stamps")


def stage_report(df: DataFrame, stage_name: str, cols: Sequence[str] = OHLCV, axis: Axis = BARS) -> DataFrame:
    """Rows, nulls, zeros and non-finite values per series and column, tagged with the stage."""
    cols, keys = list(cols), list(axis.keys)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"null_{c}").alias("n_null"),
            F.col(f"zero_{c}").alias("n_zero"),
            F.col(f"bad_{c}").alias("n_not_finite"),
        )
        for c in cols
    ]
    finite = {c: F.abs(F.col(c).cast("double")) < F.lit(float("inf")) for c in cols}
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in cols],
        *[F.count_if(~F.coalesce(finite[c], F.lit(False))).alias(f"bad_{c}") for c in cols],
    )
    return stats.select(*keys, F.lit(stage_name).alias("stage"), "sample_count", F.inline(F.array(*entries)))


def gate_status(report: DataFrame, threshold: str = "warning") -> DataFrame:
    """Append ``passed``: the status is no worse than ``threshold`` (ordered by severity, not by name)."""
    return report.withColumn("passed", severity_rank(F.col("status")) <= SEVERITY.index(threshold))


def quality_gate(df: DataFrame, report: DataFrame, threshold: str = "warning", axis: Axis = BARS) -> DataFrame:
    """Rows of the series that pass."""
    passing = gate_status(report, threshold).filter("passed").select(*axis.keys)
    return join_stats(df, passing, axis.keys, "left_semi")


def flow_report(raw: DataFrame, cleaned: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Per series: rows and issues before and after, whether quality improved, and the cleaned span."""
    keys = list(axis.keys)
    before = health_report(raw, axis).select(
        *keys, F.col("rows").alias("original_rows"), F.col("status").alias("original_status"), F.col("total_issues").alias("original_issues")
    )
    after = health_report(cleaned, axis).select(
        *keys, F.col("rows").alias("cleaned_rows"), F.col("status").alias("final_status"), F.col("total_issues").alias("final_issues")
    )
    span = cleaned.groupBy(*keys).agg(F.min(axis.ts).alias("first_ts"), F.max(axis.ts).alias("last_ts"))
    joined = before.join(after, keys, "full_outer").join(span, keys, "left")
    removed = F.coalesce(F.col("original_rows"), F.lit(0)) - F.coalesce(F.col("cleaned_rows"), F.lit(0))
    return joined.withColumns(
        {
            "rows_removed": removed,
            "removed_pct": removed / F.col("original_rows") * 100,
            "improved": F.coalesce(F.col("original_issues") > F.col("final_issues"), F.lit(False)),
        }
    )


def batch_summary(flow: DataFrame, threshold: str = "warning") -> DataFrame:
    """One row over all series: how many pass, rows in and out, retention."""
    passed = severity_rank(F.col("final_status")) <= SEVERITY.index(threshold)
    n = F.count(F.lit(1))
    return flow.agg(
        n.alias("symbols"),
        F.count_if(passed).alias("passing"),
        F.count_if(~F.coalesce(passed, F.lit(False))).alias("failing"),
        (F.count_if(passed) / n * 100).alias("success_pct"),
        F.sum("original_rows").alias("rows_in"),
        F.sum("cleaned_rows").alias("rows_out"),
        (F.sum("cleaned_rows") / F.sum("original_rows") * 100).alias("retention_pct"),
        F.count_if(F.col("improved")).alias("improved"),
    )


def failing_symbols(flow: DataFrame, threshold: str = "warning") -> DataFrame:
    """The series a batch summary counts as failing, as rows."""
    passed = severity_rank(F.col("final_status")) <= SEVERITY.index(threshold)
    return flow.filter(~F.coalesce(passed, F.lit(False)))
