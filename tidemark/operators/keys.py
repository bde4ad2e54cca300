"""Time, keys, projection, order and limits on series tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import bucket, epoch_seconds, seconds_between
from tidemark.plans.series import BARS, Axis, Halo, latest, numbered, running

PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")


def localize(df: DataFrame, tz: str = "America/New_York", *, ts: str = "ts", aware: bool = False, name: str = "utc") -> DataFrame:
    """Append the UTC instant of each stamp.

    Naive stamps are wall clock in ``tz``: an hour that occurs twice gives null, an hour that does not
    exist moves to the first instant after the gap. ``aware`` stamps are UTC already and are shown in
    the wall clock of ``tz`` instead.
    """
    wall = F.col(ts).cast("timestamp_ntz")
    if aware:
        return df.withColumn(name, F.convert_timezone(F.lit("UTC"), F.lit(tz), wall))

    def to_utc(local: Column) -> Column:
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)

    def to_local(utc: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)

    hour = F.expr("INTERVAL '1' HOUR")
    utc = to_utc(wall)
    twice = (to_local(utc + hour) == wall) | (to_local(utc - hour) == wall)
    # In a skipped hour the conversion lands on the far side of the gap; the first valid instant is the
    # start of that wall-clock hour.
    skipped = to_local(utc) != wall
    start = to_utc(bucket(to_local(utc), 3600))
    return df.withColumn(name, F.when(twice, F.lit(None)).when(skipped, start).otherwise(utc))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text to double; text that is no number becomes null, and so do NaN and infinities."""
    parsed = {c: F.col(c).try_cast("double") for c in cols}
    return df.withColumns({c: F.when(F.abs(v) < F.lit(float("inf")), v) for c, v in parsed.items()})


def dedupe_ts(df: DataFrame, axis: Axis = BARS, *, arrival: Iterable[str | Column] = ()) -> DataFrame:
    """One row per key and stamp: the first by ``arrival``, else by the axis' ties, else the least by all columns in order.

    Rows without a stamp all stay. ``row_number() = 1`` keeps one row per group already before the shuffle, so doubled
    stamps are cheap.
    """
    each = F.when(F.col(axis.ts).isNull(), F.monotonically_increasing_id())
    over = Window.partitionBy(*axis.keys, axis.ts, "_each").orderBy(*(list(arrival) or axis.ties or df.columns))
    return df.withColumn("_each", each).withColumn("_nth", F.row_number().over(over)).filter("_nth = 1").drop("_nth", "_each")


def sort_by_time(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Global order for a sink; a range shuffle, so no task sees a whole key."""
    return df.orderBy(*axis.keys, *axis.order)


def latest_n(df: DataFrame, n: int, axis: Axis = BARS) -> DataFrame:
    """The last ``n`` rows of every series. The limit is applied before the shuffle as well."""
    over = Window.partitionBy(*axis.keys).orderBy(*[F.col(c).desc() for c in axis.order])
    return df.withColumn("_nth", F.row_number().over(over)).filter(F.col("_nth") <= n).drop("_nth")


def latest_row(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """The newest row of every series, as an aggregate."""
    rest = [c for c in df.columns if c not in axis.keys]
    newest = df.groupBy(*axis.keys).agg(F.max_by(F.struct(*rest), axis.order_key()).alias("_row"))
    return newest.select(*axis.keys, "_row.*")


def calendar_features(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Hour of day and day of week (Monday = 0)."""
    return df.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts)})


def resample_ohlcv(df: DataFrame, seconds: int, axis: Axis = BARS) -> DataFrame:
    """Bars of a coarser frequency; buckets that miss a price are dropped.

    Every aggregate combines on the map side, so the shuffle carries one row per bucket and task.
    """
    order = axis.order_key()

    def edge(pick, column: str) -> Column:
        return pick(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(column)

    bars = (
        df.withColumn("_bucket", F.window(axis.ts, f"{seconds} seconds")["start"])
        .groupBy(*axis.keys, "_bucket")
        .agg(
            edge(F.min_by, "open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            edge(F.max_by, "close"),
            F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        )
    )
    return bars.withColumnRenamed("_bucket", axis.ts).na.drop(subset=list(OHLCV))


def ticks_to_bars(df: DataFrame, seconds: int, axis: Axis, *, price: str, size: str) -> DataFrame:
    """Bars straight from single prices and sizes."""
    bars = df.select(
        *axis.id,
        *[F.col(price).alias(c) for c in PRICES],
        F.col(size).cast("bigint").alias("volume"),
    )
    return resample_ohlcv(bars, seconds, axis)


def time_grid(df: DataFrame, seconds: int, axis: Axis = BARS) -> DataFrame:
    """Every stamp from the first to the last of each series, ``seconds`` apart.

    The grid is made in two explodes with a shuffle between, first days, then steps inside a day, so
    one long series is spread over tasks.
    """
    span = df.groupBy(*axis.keys).agg(F.min(axis.ts).alias("_from"), F.max(axis.ts).alias("_to"))
    chunk = 1024
    steps = F.floor((epoch_seconds(F.col("_to")) - epoch_seconds(F.col("_from"))) / seconds)
    chunks = span.withColumn("_steps", steps).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_steps") / chunk))))
    chunks = chunks.repartition(*axis.keys, "_chunk")
    first = F.col("_chunk") * chunk
    last = F.least(first + (chunk - 1), F.col("_steps"))
    step = F.explode(F.sequence(first, last))
    points = chunks.select(*axis.keys, "_from", step.alias("_step"))
    stamp = F.col("_from") + F.make_dt_interval(secs=F.col("_step") * seconds)
    return points.select(*axis.keys, stamp.alias(axis.ts))


def fill_time_gaps(df: DataFrame, seconds: int, axis: Axis = BARS) -> DataFrame:
    """Full grid from first to last stamp with every column carried forward (volume too)."""
    grid = time_grid(df, seconds, axis)
    joined = grid.join(df, [*axis.keys, axis.ts], "left")
    values = [c for c in df.columns if c not in (*axis.keys, axis.ts)]
    return running(joined, axis, **{c: latest(c) for c in values}).select(*df.columns)


def missing_grid_points(df: DataFrame, seconds: int, axis: Axis = BARS) -> DataFrame:
    """Stamps of the expected grid that the table lacks."""
    return time_grid(df, seconds, axis).join(df.select(*axis.keys, axis.ts), [*axis.keys, axis.ts], "left_anti")


def steps(df: DataFrame, axis: Axis = BARS, name: str = "step") -> DataFrame:
    """Append the seconds since the previous row of the series (null on the first)."""
    halo = Halo.spread(df, axis, back=1)
    previous = F.lag(axis.ts).over(halo.w)
    return halo.settle(halo.frame.withColumn(name, seconds_between(previous, F.col(axis.ts))))


def interval_stats(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Per series: number of steps, modal step (ties: the smallest), its share, distinct and irregular steps."""
    lengths = steps(df.select(*axis.id), axis).filter("step is not null")
    counts = lengths.groupBy(*axis.keys, "step").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("step").alias("step")))
    stats = counts.groupBy(*axis.keys).agg(
        F.sum("n").alias("n_steps"), best.alias("_best"), F.count(F.lit(1)).alias("unique_steps")
    )
    modal = -F.col("_best.n")
    return stats.select(
        *axis.keys,
        "n_steps",
        F.col("_best.step").alias("modal_step"),
        (modal / F.col("n_steps")).alias("consistency"),
        "unique_steps",
        (F.col("n_steps") - modal).alias("irregular_steps"),
    )


# Opening and closing hour per exchange.
SESSION_HOURS = {"NYSE": (9, 16), "NASDAQ": (9, 16), "FOREX": (0, 24)}


def in_session(df: DataFrame, exchange: str | Column, hours: Mapping[str, tuple[int, int]] = SESSION_HOURS, *, ts: str = "ts") -> DataFrame:
    """Append ``in_session``; exchanges without hours are open all day."""
    name = exchange if isinstance(exchange, Column) else F.lit(exchange)
    opens, closes = F.lit(0), F.lit(24)
    for key, (start, end) in hours.items():
        opens = F.when(name == key, start).otherwise(opens)
        closes = F.when(name == key, end).otherwise(closes)
    return df.withColumn("in_session", (F.hour(ts) >= opens) & (F.hour(ts) < closes))


# Numeric log levels.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def session_log_filter(df: DataFrame, exchange: str | Column = "NYSE", *, ts: str = "ts", level: str = "level") -> DataFrame:
    """Keep warnings and worse during trading hours, everything outside them."""
    number = F.lit(0)
    for key, value in LEVELS.items():
        number = F.when(F.col(level) == key, value).otherwise(number)
    floor = F.when(F.col("in_session"), LEVELS["WARNING"]).otherwise(LEVELS["DEBUG"])
    return in_session(df, exchange, ts=ts).filter(number >= floor).drop("in_session")


def union_batches(frames: Iterable[DataFrame]) -> DataFrame:
    """Concatenate fetched batches by column name; columns a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coverage(df: DataFrame, start: str, end: str, axis: Axis = BARS) -> DataFrame:
    """Does the stored range of each series cover ``[start, end]``?"""
    spans = df.groupBy(*axis.keys).agg(F.min(axis.ts).alias("first_ts"), F.max(axis.ts).alias("last_ts"))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return spans.withColumn("covered", (F.col("first_ts") <= lo) & (F.col("last_ts") >= hi))


def _align(a: DataFrame, b: DataFrame, axis: Axis, tail: bool) -> DataFrame:
    left = numbered(a, axis, "_rn", size="_size")
    right = numbered(b.select(*axis.id, *[c for c in b.columns if c not in (*axis.id, *a.columns)]), axis, "_rn", size="_size")
    if tail:
        left = left.withColumn("_rn", F.col("_size") - F.col("_rn"))
        right = right.withColumn("_rn", F.col("_size") - F.col("_rn"))
    right = right.drop("_size", *axis.order)
    return left.drop("_size").join(right, [*axis.keys, "_rn"]).drop("_rn")


def align_tail(a: DataFrame, b: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Pair the rows of two tables counted from the end; rows the shorter one lacks are cut in front."""
    return _align(a, b, axis, tail=True)


def align_head(a: DataFrame, b: DataFrame, axis: Axis = BARS) -> DataFrame:
    """Pair the rows of two tables counted from the start; rows the shorter one lacks are cut at the end."""
    return _align(a, b, axis, tail=False)
