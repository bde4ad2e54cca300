"""Statistics and anomalies of log tables (timestamp, level, module, function, message, execution_time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import hour_start, seconds_between

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def log_metrics(df: DataFrame, slow: float = 1.0) -> DataFrame:
    """One row: entries, span, times, slow operations, error and warning shares."""
    n, t = F.count(F.lit(1)), F.col("execution_time")
    first, last = F.min("timestamp"), F.max("timestamp")
    return df.agg(
        n.alias("total_entries"),
        first.alias("start_ts"),
        last.alias("end_ts"),
        F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_execution_time"),
        F.coalesce(F.max(t), F.lit(0.0)).alias("max_execution_time"),
        F.count_if(t > slow).alias("slow_operations"),
        (F.count_if(F.col("level") == "ERROR") * 100 / F.nullif(n, F.lit(0))).alias("error_pct"),
        (F.count_if(F.col("level") == "WARNING") * 100 / F.nullif(n, F.lit(0))).alias("warning_pct"),
    ).withColumn("duration_hours", seconds_between(F.col("start_ts"), F.col("end_ts")) / 3600)


def level_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def module_activity(df: DataFrame, top: int = 10) -> DataFrame:
    """The most active modules; equal ones by name."""
    return df.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(top)


def slow_anomalies(df: DataFrame, order: Sequence[str] = ("timestamp",), deviations: float = 3.0, first: int = 5) -> DataFrame:
    """The first operations slower than mean + 3 population deviations, with the threshold and how many
    there are in all."""
    t = F.col("execution_time")
    # One row with one number.
    limit = df.agg((F.avg(t) + deviations * F.stddev_pop(t)).alias("threshold"))
    slow = df.crossJoin(F.broadcast(limit)).filter(t > F.col("threshold"))
    total = slow.agg(F.count(F.lit(1)).alias("n_slow"))
    shown = slow.orderBy(*order).limit(first).select(*order, "function", "execution_time", "threshold")
    return shown.crossJoin(F.broadcast(total))


def hourly_errors(df: DataFrame) -> DataFrame:
    return df.filter("level = 'ERROR'").groupBy(hour_start(F.col("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n_errors"))


def spike_hours(hours: DataFrame, factor: float = 2.0) -> DataFrame:
    """Hours (hour, n_errors) above ``factor`` times the mean of hours that have errors."""
    mean = hours.filter("n_errors > 0").agg(F.avg("n_errors").alias("mean_errors"))
    return hours.crossJoin(F.broadcast(mean)).filter(F.col("n_errors") > factor * F.col("mean_errors"))


def error_spikes(df: DataFrame, factor: float = 2.0) -> DataFrame:
    return spike_hours(hourly_errors(df), factor)


def hourly_level_pivot(df: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Hours by level, 0 where none; the levels are given, so no pass looks for them."""
    hour = hour_start(F.col("timestamp")).alias("hour")
    return df.groupBy(hour).pivot("level", list(levels)).agg(F.count(F.lit(1))).na.fill(0)


def time_histogram(df: DataFrame, bins: int = 50, below: float = 10.0) -> DataFrame:
    """Counts of execution times under ``below`` in equal bins from the smallest to the largest; empty bins
    are left out."""
    times = df.filter(F.col("execution_time") < below).select("execution_time")
    ends = times.agg(F.min("execution_time").alias("lo"), F.max("execution_time").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.floor((F.col("execution_time") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    bin = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = times.crossJoin(F.broadcast(ends)).groupBy(bin.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("from_time"), (F.col("lo") + (F.col("bin") + 1) * width).alias("to_time"), "n")


def recent_stats(df: DataFrame, n: int = 1000, key: str = "module", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Per logger over its last ``n`` records. The limit is applied before the shuffle too."""
    over = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    recent = df.withColumn("_nth", F.row_number().over(over)).filter(F.col("_nth") <= n)
    return recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.avg("execution_time").alias("avg_execution_time"),
        F.max("execution_time").alias("max_execution_time"),
        *[F.count_if(F.col("level") == v).alias(f"n_{v.lower()}") for v in LEVELS],
    )


def operations(df: DataFrame) -> DataFrame:
    """The records that start, complete or fail an operation, with its name and state."""
    state = F.regexp_extract("message", r"^(Starting|Completed|Failed) ", 1)
    name = F.regexp_extract("message", r"^(?:Starting|Completed|Failed) ([^:]+)", 1)
    return df.withColumns({"state": state, "operation": name}).filter("state <> ''")


def operation_stats(df: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Per operation: started, completed, failed, times of finished ones, and kinds of errors."""
    state = F.col("state")
    done = F.when(state != "Starting", F.col("execution_time"))
    return operations(df).groupBy("operation").agg(
        F.count_if(state == "Starting").alias("started"),
        F.count_if(state == "Completed").alias("completed"),
        F.count_if(state == "Failed").alias("failed"),
        F.avg(done).alias("avg_execution_time"),
        F.max(done).alias("max_execution_time"),
        F.count_distinct(F.when(state == "Failed", F.col(error_type))).alias("error_kinds"),
    )
