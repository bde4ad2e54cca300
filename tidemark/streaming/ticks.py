"""Structured Streaming on ticks, bars and logs.

Every stream writes to files with a checkpoint below the shared folder, so a restarted stream goes on where it
stopped. State is bounded: by the watermark, or by a fixed number of rows per symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.stats import above, merged_moments, moments
from tidemark.operators.indicators import REALTIME, realtime_features, realtime_window, with_realtime
from tidemark.plans.parts import join_stats
from tidemark.session import new_path, remove

EVENT = "event string, symbol string, price string, size string, event_id bigint, timestamp string"


def run(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into files at ``path``, then stop. Long-running jobs use their own trigger."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path)
    query = writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def collect_stream(df: DataFrame, name: str) -> DataFrame:
    """Run an append stream into files and return them as a table."""
    path = new_path(df.sparkSession, name)
    run(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Process what is there batch by batch with ``handle``."""
    checkpoint = new_path(df.sparkSession, f"{name}-checkpoint")
    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of landed JSON messages, one per line, as ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def read_ticks(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files with the given schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def parse_ticks(messages: DataFrame, column: str = "value") -> DataFrame:
    """Price events only, typed: symbol, ts (UTC), event_id, price, size."""
    m = F.from_json(column, EVENT)
    return messages.select(m.alias("_m")).filter("_m.event = 'price'").select(
        F.coalesce("_m.symbol", F.lit("")).alias("symbol"),
        F.try_to_timestamp("_m.timestamp").alias("ts"),
        F.col("_m.event_id").alias("event_id"),
        F.coalesce(F.col("_m.price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.col("_m.size").try_cast("bigint").alias("size"),
    )


def valid_tick(ticks: DataFrame) -> DataFrame:
    return ticks.filter("price > 0")


def latest_price(ticks: DataFrame) -> DataFrame:
    """Newest price per symbol; as a stream it runs in update mode with one row of state per symbol."""
    newest = F.max(F.struct("ts", "event_id", "price"))
    return ticks.groupBy("symbol").agg(newest.alias("_t")).select("symbol", "_t.ts", "_t.event_id", "_t.price")


def batch_folder(path: str, number: int) -> str:
    """Where a batch's rows go: a batch that is run again writes the same folder again."""
    return f"{path}/batch={number}"


def carry_on(spark: SparkSession, path: str, number: int, schema, join: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """What batch ``number`` hands on: ``join`` of what the batch before it left (None before the first), written and read back.

    Of older batches nothing is read, and only the last two stay: a batch that is run again finds the one before it.
    """
    before = spark.read.schema(schema).parquet(batch_folder(path, number - 1)) if number else None
    join(before).write.mode("overwrite").parquet(batch_folder(path, number))
    if number > 1:
        remove(spark, batch_folder(path, number - 2))
    return spark.read.schema(schema).parquet(batch_folder(path, number))


def _known_prices(batch: DataFrame, path: str, number: int) -> DataFrame:
    """The newest price of every symbol up to this batch, from the symbols it changed and what the batch before knew."""
    return carry_on(
        batch.sparkSession, path, number, batch.schema, lambda before: batch if before is None else latest_price(before.unionByName(batch))
    )


def latest_price_table(ticks: DataFrame) -> DataFrame:
    """Run ``latest_price`` as a stream: each batch writes the newest row of all symbols so far, from the symbols it
    changed and the table of the batch before; the last batch's table is returned."""
    spark = ticks.sparkSession
    path = new_path(spark, "latest")
    states = latest_price(ticks)
    known = [spark.createDataFrame([], states.schema)]

    def handle(batch: DataFrame, number: int) -> None:
        known[0] = _known_prices(batch, path, number)

    each_batch(states, handle, "latest", mode="update")
    return known[0]


def fresh_price(latest: DataFrame, closes: DataFrame, now: Column, max_age: float = 300.0) -> DataFrame:
    """Per symbol of either table: the latest price if younger than ``max_age`` seconds at ``now``, else the
    last one-minute close. ``closes``: (symbol, close)."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    live = latest.withColumn("_live", F.when(micros < max_age * 1e6, F.col("price"))).select("symbol", "_live")
    joined = live.join(closes, ["symbol"], "full_outer")
    return joined.select("symbol", F.coalesce("_live", "close").alias("price"), F.col("_live").isNotNull().alias("live"))


def stream_fresh_price(ticks: DataFrame, closes: DataFrame, path: str, now: Column | None = None, max_age: float = 300.0) -> None:
    """After each batch the ``fresh_price`` of all symbols seen so far, or in ``closes``, below ``path``; ``now`` is the
    newest stamp seen unless given. A batch reads its own symbols and the table the batch before left."""
    states = latest_price(ticks)

    def handle(batch: DataFrame, number: int) -> None:
        known = _known_prices(batch, f"{path}/latest", number)
        newest = known.agg(F.max("ts")).first()[0] if now is None else None
        if now is None and newest is None:
            return
        at = F.lit(newest) if now is None else now
        fresh_price(known, closes, at, max_age).write.mode("overwrite").parquet(batch_folder(f"{path}/prices", number))

    each_batch(states, handle, "fresh", mode="update")


def stream_bars(ticks: DataFrame, freq: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bars per closed window; ticks later than ``delay`` are dropped, open windows wait."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", freq).alias("_w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_dedupe(ticks: DataFrame, delay: str = "1 hour", keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


BUFFER = 80
CHUNK = 4096
#: Event time without a bar after which a symbol's state goes.
KEEP_MS = 400 * 86_400_000
_FIELDS = {"ts": "timestamp", "high": "double", "low": "double", "close": "double", "volume": "bigint"}
_ARRAYS = ", ".join(f"{n} array<{t}>" for n, t in _FIELDS.items())


def _buffer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the last 79 bars of a symbol; emit them with the arriving bars, one row per 4096 of these. Bars not newer than
    the newest one kept are late and dropped; the state of a symbol that is silent too long goes."""
    if state.hasTimedOut:
        state.remove()
        return
    seen, *tail = state.get if state.exists else (0, *([] for _ in _FIELDS))
    tail = [list(c) for c in tail]
    arrived = pd.concat(list(frames)).sort_values("ts", kind="stable").drop_duplicates("ts")
    if tail[0]:
        arrived = arrived[arrived["ts"] > tail[0][-1]]
    out = []
    for start in range(0, len(arrived), CHUNK):
        chunk = arrived.iloc[start : start + CHUNK]
        known = len(tail[0])
        columns = [old + chunk[name].tolist() for old, name in zip(tail, _FIELDS)]
        out.append((key[0], seen, known, *columns))
        seen += len(chunk)
        tail = [c[-(BUFFER - 1) :] for c in columns]
    state.update((seen, *tail))
    if tail[0]:
        state.setTimeoutTimestamp(max(int(tail[0][-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + KEEP_MS)
    yield pd.DataFrame(out, columns=["symbol", "seen", "known", *_FIELDS])


def stream_features(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Realtime features for every arriving bar from at most 79 bars of state per symbol.

    Python only keeps the buffer and hands it over once per batch and symbol (ticks are reduced to bars
    before); the features are the same expressions as in batch. A batch holds what its files hold of a symbol
    (``files_per_batch`` bounds it), in any order; bars behind the watermark or older than those seen are dropped.
    """
    rows = bars.select("symbol", *[F.col(n).cast(t) for n, t in _FIELDS.items()]).withWatermark("ts", delay)
    buffered = rows.groupBy("symbol").applyInPandasWithState(
        _buffer, f"symbol string, seen bigint, known int, {_ARRAYS}", f"seen bigint, {_ARRAYS}", "append", GroupStateTimeout.EventTimeTimeout
    )
    whole = buffered.select("symbol", "seen", "known", F.arrays_zip(*_FIELDS).alias("_whole"))

    def up_to(i: Column) -> Column:
        """The bars a feature row may use: those before and with bar ``i`` that the window rule allows."""
        nth = F.col("seen") + i - F.col("known")
        n = F.least(realtime_window(nth), i.cast("bigint")).cast("int")
        return F.struct(nth.alias("nth"), F.slice("_whole", i - n + 1, n).alias("bars"))

    places = F.sequence(F.col("known") + 1, F.size("_whole"))
    each = whole.select("symbol", F.explode(F.transform(places, up_to)).alias("_e"))
    each = each.select("symbol", F.col("_e.nth").alias("seen"), F.col("_e.bars").alias("_bars"))
    return with_realtime(each, "_bars").select("symbol", "seen", F.element_at("_bars", -1)["ts"].alias("ts"), *REALTIME)


def append_and_refresh(bars: DataFrame, history: str, features: str) -> None:
    """Per batch: add the new bars to ``history``, then write the features of the newest bar of each symbol
    that got any. Read are the batch and the last 80 bars of each symbol as the batch before left them, never the history.
    """
    tails = f"{history}-tails"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(batch_folder(history, number))
        new = spark.read.schema(batch.schema).parquet(batch_folder(history, number))

        def last_bars(before: DataFrame | None) -> DataFrame:
            known = new if before is None else new.unionByName(before)
            nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
            return known.withColumn("_nth", nth).filter(F.col("_nth") <= BUFFER).drop("_nth")

        def lengths(before: DataFrame | None) -> DataFrame:
            counts = new.groupBy("symbol").agg(F.count("*").alias("n"))
            return counts if before is None else counts.unionByName(before).groupBy("symbol").agg(F.sum("n").alias("n"))

        tail = carry_on(spark, tails, number, batch.schema, last_bars)
        # How many bars a symbol has had decides how many of the last ones count.
        counts = carry_on(spark, f"{tails}-counts", number, "symbol string, n long", lengths)
        fresh = realtime_features(tail.join(new.select("symbol").distinct(), ["symbol"], "left_semi"), length=counts)
        fresh.write.mode("overwrite").parquet(batch_folder(features, number))

    each_batch(bars, handle, "refresh")


def fan_out(ticks: DataFrame, handlers: Mapping[str, Callable[[DataFrame, int], None]], failed: str) -> None:
    """Give each batch to every handler; one that fails doesn't keep the others from running, and its batch is written
    below ``failed`` with the error, for ``replay``."""

    def handle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, call in handlers.items():
                try:
                    call(kept, number)
                except Exception as error:  # noqa: BLE001 - a handler's failure is its own
                    noted = kept.withColumns({"handler": F.lit(name), "error": F.lit(type(error).__name__)})
                    noted.write.mode("overwrite").parquet(f"{failed}/handler={name}/batch={number}")
        finally:
            kept.unpersist()

    each_batch(ticks, handle, "fan-out")


def failed_rows(spark: SparkSession, failed: str, schema: str) -> DataFrame:
    """Rows of failed batches with handler, error and batch; none if nothing has failed."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(failed)
    whole = f"{schema}, error string, handler string, batch int"
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", failed).parquet(failed)


def replay(spark: SparkSession, failed: str, schema: str, name: str, handler: Callable[[DataFrame, int], None]) -> None:
    """Give a handler its failed batches again, in order."""
    rows = failed_rows(spark, failed, schema).filter(F.col("handler") == name)
    for number in sorted(r["batch"] for r in rows.select("batch").distinct().collect()):
        handler(rows.filter(F.col("batch") == number).drop("handler", "error", "batch"), number)


def stream_log_hours(logs: DataFrame, delay: str = "1 hour", slow: float = 1.0) -> DataFrame:
    """Errors, slow operations and longest time per closed hour."""
    hours = logs.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 hour").alias("_w")).agg(
        F.count_if(F.col("level") == "ERROR").alias("n_errors"),
        F.count_if(F.col("execution_time") > slow).alias("n_slow"),
        F.max("execution_time").alias("max_execution_time"),
    )
    return hours.select(F.col("_w.start").alias("hour"), "n_errors", "n_slow", "max_execution_time")


def stream_slow_operations(logs: DataFrame, limit: float) -> DataFrame:
    """Operations slower than ``limit`` seconds, as they arrive."""
    return logs.filter(F.col("execution_time") > limit)


def stream_slow_anomalies(logs: DataFrame, path: str, deviations: float = 3.0, keys: Sequence[str] = (), least: int = 2) -> None:
    """Per batch the operations slower than mean + ``deviations`` population deviations of all times up to and with the batch,
    with this ``threshold``, below ``path``/alerts; with ``keys`` each group has its own threshold.

    A batch hands on number, mean and squared deviations of each group (one row without keys), merged with those of the
    batch before, so no earlier row is read again and the order within a batch doesn't matter. Groups of fewer than ``least``
    known times raise no alert; null and non-finite times count nowhere; null keys are a group.
    """
    keys = list(keys)
    time = F.col("execution_time").cast("double")
    finite = F.when(F.abs(time) < F.lit(float("inf")), time)

    def handle(batch: DataFrame, number: int) -> None:
        here = batch.groupBy(*keys).agg(moments(finite).alias("moments"))

        def joined(before: DataFrame | None) -> DataFrame:
            if before is None:
                return here
            # Groups of both sides side by side, at most one row of each: null keys meet as well.
            sides = before.withColumn("_late", F.lit(False)).unionByName(here.withColumn("_late", F.lit(True)))
            pair = [F.max(F.when(F.col("_late") == late, F.col("moments"))) for late in (False, True)]
            return sides.groupBy(*keys).agg(merged_moments(*pair).alias("moments"))

        known = carry_on(batch.sparkSession, f"{path}/moments", number, here.schema, joined)
        known = known.filter(F.col("moments.n") >= least).select(*[F.struct(k).alias(f"_key_{k}") for k in keys], above(F.col("moments"), deviations).alias("threshold"))
        rows = batch.withColumns({f"_key_{k}": F.struct(k) for k in keys}) if keys else batch
        slow = join_stats(rows, known, [f"_key_{k}" for k in keys], "inner").filter(finite > F.col("threshold"))
        slow.select(*batch.columns, "threshold").write.mode("overwrite").parquet(batch_folder(f"{path}/alerts", number))

    each_batch(logs, handle, "slow-anomalies")


def stream_spikes(hours: DataFrame, path: str, factor: float = 2.0) -> None:
    """As hours close (``stream_log_hours``): those with over ``factor`` times the mean of the hours with errors up to and with
    them, below ``path``/alerts. A batch carries sum and number of these hours on; hours must close in order."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "total long, n long"
        before = (0, 0) if number == 0 else tuple(spark.read.schema(schema).parquet(batch_folder(f"{path}/carry", number - 1)).first())
        # A batch closes a few hours: one row each.
        upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("n_errors").over(upto) + F.lit(before[0])
        n = F.sum((F.col("n_errors") > 0).cast("long")).over(upto) + F.lit(before[1])
        marked = batch.select("hour", "n_errors", (total / F.nullif(n, F.lit(0))).alias("mean_errors"))
        marked.filter(F.col("n_errors") > factor * F.col("mean_errors")).write.mode("overwrite").parquet(batch_folder(f"{path}/alerts", number))
        more = batch.agg(
            (F.coalesce(F.sum("n_errors"), F.lit(0)) + before[0]).cast("long").alias("total"), (F.count_if(F.col("n_errors") > 0) + before[1]).cast("long").alias("n")
        )
        carry_on(spark, f"{path}/carry", number, schema, lambda _: more)

    each_batch(hours, handle, "spikes")


def newest_per_symbol(df: DataFrame, order: str = "seen") -> DataFrame:
    """The last emitted row of each symbol."""
    over = Window.partitionBy("symbol").orderBy(F.col(order).desc())
    return df.withColumn("_nth", F.row_number().over(over)).filter("_nth = 1").drop("_nth")
