"""Performance of equity curves and assessment against targets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_seconds, month
from tidemark.operators.ledger import trade_stats
from tidemark.plans.series import Axis, Halo, highest, running

CURVE = Axis()


def performance(equity: DataFrame, axis: Axis = CURVE, periods_per_year: float = 252.0) -> DataFrame:
    """First and last value, total and annual return (over calendar days), largest drawdown, Sharpe ratio.

    Zero where undefined.
    """
    keys, v = list(axis.keys), F.col("portfolio_value")
    peaks = running(equity, axis, _peak=highest(v))
    falls = peaks.groupBy(*keys).agg(F.abs(F.min((v - F.col("_peak")) / F.nullif(F.col("_peak"), F.lit(0.0)))).alias("max_drawdown"))
    h = Halo.spread(equity, axis, back=1)
    change = v / F.nullif(F.lag(v).over(h.w), F.lit(0.0)) - 1
    returns = h.settle(h.frame.withColumn("_ret", change))
    ends = returns.groupBy(*keys).agg(
        F.min_by("portfolio_value", axis.order_key()).alias("initial_value"),
        F.max_by("portfolio_value", axis.order_key()).alias("final_value"),
        F.floor((epoch_seconds(F.max(axis.ts)) - epoch_seconds(F.min(axis.ts))) / 86400).alias("total_days"),
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_std"),
    )
    growth = F.col("final_value") / F.nullif(F.col("initial_value"), F.lit(0.0))
    usable = (F.col("total_days") > 0) & (F.col("initial_value") > 0) & (F.col("final_value") >= 0)
    annual = F.when(usable, F.pow(growth, F.lit(252.0) / F.nullif(F.col("total_days"), F.lit(0))) - 1).otherwise(0.0)
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") / F.nullif(F.col("_std"), F.lit(0.0)) * F.sqrt(F.lit(periods_per_year))).otherwise(0.0)
    return ends.join(falls, keys).select(
        *keys,
        "initial_value",
        "final_value",
        "total_days",
        (growth - 1).alias("total_return"),
        annual.alias("annual_return"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        sharpe.alias("sharpe_ratio"),
    )


def monthly_returns(equity: DataFrame, axis: Axis = CURVE) -> DataFrame:
    """Change from the first to the last value of each month; months that start at 0 or less are left out."""
    order = axis.order_key()
    months = equity.groupBy(*axis.keys, month(F.col(axis.ts)).alias("month")).agg(
        F.min_by("portfolio_value", order).alias("start_value"), F.max_by("portfolio_value", order).alias("end_value")
    )
    kept = months.filter("start_value > 0")
    return kept.withColumn("monthly_return", (F.col("end_value") - F.col("start_value")) / F.col("start_value"))


def monthly_win_rate(equity: DataFrame, axis: Axis = CURVE) -> DataFrame:
    n, wins = F.count(F.lit(1)), F.count_if(F.col("monthly_return") > 0)
    return monthly_returns(equity, axis).groupBy(*axis.keys).agg(
        n.alias("total_months"), wins.alias("winning_months"), (wins / n).alias("monthly_win_rate")
    )


# Targets, and the factor within which each still counts as feasible.
TARGETS = {"annual_return": 0.30, "max_drawdown": 0.10, "monthly_win_rate": 0.65}
ADJUSTED_TARGETS = {"annual_return": 0.20, "max_drawdown": 0.12, "monthly_win_rate": 0.58}
TOLERANCE = {"annual_return": 0.8, "max_drawdown": 1.2, "monthly_win_rate": 0.9}


def target_assessment(metrics: DataFrame, targets: Mapping[str, float] = TARGETS, axis: Axis = CURVE) -> DataFrame:
    """Append gap and feasibility per target, how many are met and their share, the verdict (two of three) and the first target missed."""
    feasible, out = {}, {}
    for name, target in targets.items():
        value, limit = F.col(name), target * TOLERANCE[name]
        smaller = name == "max_drawdown"
        out[f"{name}_gap"] = (F.lit(target) - value) if smaller else (value - target)
        feasible[name] = (value <= limit) if smaller else (value >= limit)
        out[f"{name}_feasible"] = feasible[name]
    met = sum((f.cast("int") for f in list(feasible.values())[1:]), list(feasible.values())[0].cast("int"))
    missing = F.lit(None).cast("string")
    for name in reversed(list(feasible)):
        missing = F.when(~feasible[name], name).otherwise(missing)
    return metrics.withColumns(out | {"score": met / F.lit(3.0), "targets_met": met, "feasible": met >= 2, "missed": missing})


def target_ratios(metrics: DataFrame, targets: Mapping[str, float] = ADJUSTED_TARGETS) -> DataFrame:
    """Append the ratio of achieved to target (inverse for drawdown), their mean, and the risk tier."""
    ratios: dict[str, Column] = {}
    for name, target in targets.items():
        value = F.col(name)
        ratios[f"{name}_ratio"] = F.lit(target) / F.when(value > 0, value) if name == "max_drawdown" else value / F.lit(target)
    achieved = F.lit(True)
    for name, target in targets.items():
        achieved = achieved & ((F.col(name) <= target) if name == "max_drawdown" else (F.col(name) >= target))
    values = list(ratios.values())
    mean = sum(values[1:], values[0]) / len(values)
    tier = F.when(F.col("max_drawdown") > 0.15, "high").when(F.col("max_drawdown") > 0.10, "medium").otherwise("low")
    return metrics.withColumns(ratios | {"all_achieved": achieved, "mean_ratio": mean, "risk_tier": tier})


def performance_report(equity: DataFrame, pairs: DataFrame, costs: DataFrame, axis: Axis = CURVE, pair_axis: Axis | None = None) -> DataFrame:
    """One row per series: performance, trades, months and costs, 0 where undefined; the four headline
    rates are rounded to 4 places."""
    keys = list(axis.keys)
    joined = (
        performance(equity, axis)
        .join(trade_stats(pairs, pair_axis or axis), keys, "left")
        .join(monthly_win_rate(equity, axis), keys, "left")
        .join(costs, keys, "left")
    )
    rates = ["annual_return", "max_drawdown", "win_rate", "sharpe_ratio"]
    sums = ["total_return", "monthly_win_rate", "total_commission", "total_slippage", "initial_value", "final_value"]
    counts = ["total_trades", "winning_trades", "winning_months", "total_months"]
    return joined.select(
        *keys,
        "total_days",
        *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in rates],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )
