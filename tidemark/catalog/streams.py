"""Queries that run streams over landed files to their end and return the result as a table.

Stamps are written as timestamps in UTC, which watermarks need, and returned as wall clock.
"""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.indicators import REALTIME_SQL
from tidemark.fixtures import bars30, logs, ticks
from tidemark.operators import indicators as X
from tidemark.session import new_path, stage
from tidemark.streaming import silence
from tidemark.streaming import ticks as S

TICK = "symbol string, ts timestamp, event_id bigint, price double, size bigint"
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint"


def wall(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols or ("ts",)})


BATCHES = 5


def landed(spark, df, name, schema, order="ts", part=None):
    """Land a table as files one after the other, cut by time (or by ``part``, 0 to 4), and read them as a stream of a file each batch."""
    path = new_path(spark, name)
    ordered = df.repartitionByRange(BATCHES, order)
    cut = stage(ordered.withColumn("_part", F.spark_partition_id() if part is None else part), name)
    for part in range(BATCHES):
        cut.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return S.read_ticks(spark, path, schema, files_per_batch=1)


def tick_stream(spark, sf):
    rows = ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return landed(spark, rows.select("symbol", "ts", "event_id", "price", "size"), "ticks", TICK)


def bar_stream(spark, sf):
    rows = bars30(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return landed(spark, rows.select("symbol", "ts", "open", "high", "low", "close", "volume"), "bars", BAR)


@query(
    "parse_ticks",
    """SELECT event_type AS symbol, ts, event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size
       FROM events WHERE event_id % 9 <> 0""",
)
def _(spark, sf):
    rows = ticks(spark, sf)
    message = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 9 == 0, "heartbeat").otherwise("price").alias("event"),
            "symbol",
            F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
            F.col("size").cast("string").alias("size"),
            "event_id",
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        )
    )
    path = new_path(spark, "messages")
    rows.select(message.alias("value")).write.text(path)
    return wall(S.collect_stream(S.parse_ticks(S.read_messages(spark, path)), "parsed"))


@query("valid_tick", "SELECT event_type AS symbol, ts, event_id, value AS price FROM events WHERE value > 0 AND event_id % 50 <> 0")
def _(spark, sf):
    stream = tick_stream(spark, sf).withColumn("price", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("price")))
    return wall(S.collect_stream(S.valid_tick(stream), "valid").select("symbol", "ts", "event_id", "price"))


LATEST = "SELECT event_type AS symbol, max(ts) AS ts, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS price FROM events GROUP BY 1"


@query("latest_price", LATEST)
def _(spark, sf):
    return wall(S.latest_price_table(tick_stream(spark, sf)))


# Ticks that no other of their symbol follows within an hour, up to the watermark of the last batch.
SILENCES = """t AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ms, event_id, value AS price FROM events),
       n AS (SELECT *, lead(ms) OVER (PARTITION BY symbol ORDER BY ms, event_id) AS after FROM t),
       o AS (SELECT * FROM n WHERE (after IS NULL OR after - ms > 3600000) AND ms + 3600000 < (SELECT max(ms) - 7200000 FROM t))"""


@query("stream_silences", f"WITH {SILENCES} SELECT symbol, make_timestamp(ms * 1000) AS since, make_timestamp((ms + 3600000) * 1000) AS ts, price AS last_price FROM o")
def _(spark, sf):
    with silence.keyed_state(spark):
        return wall(S.collect_stream(silence.stream_silences(tick_stream(spark, sf), 3600.0, "2 hours"), "silences"), "since", "ts")


@query(
    "stream_fallbacks",
    f"""WITH {SILENCES}, c AS (SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1)
       SELECT symbol, make_timestamp(ms * 1000) AS since, make_timestamp((ms + 3600000) * 1000) AS ts, o.price AS last_price, c.close AS price FROM o JOIN c USING (symbol)""",
)
def _(spark, sf):
    closes = bars30(spark, sf, 60).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    with silence.keyed_state(spark):
        return wall(S.collect_stream(silence.stream_fallbacks(tick_stream(spark, sf), closes, 3600.0, "2 hours"), "fallbacks"), "since", "ts")


@query(
    "fresh_price",
    """WITH now AS (SELECT max(ts) AS t FROM events), m AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 minute', ts) AS b, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
       c AS (SELECT symbol, last(close ORDER BY b) AS close FROM m GROUP BY 1),
       l AS (SELECT event_type AS symbol, max(ts) AS ts, last(value ORDER BY ts, event_id) * 2 AS price FROM events GROUP BY 1)
       SELECT symbol, CASE WHEN epoch_us(t) - epoch_us(ts) < 300000000 THEN price ELSE close END AS price, epoch_us(t) - epoch_us(ts) < 300000000 AS live FROM l JOIN c USING (symbol), now""",
)
def _(spark, sf):
    rows = ticks(spark, sf)
    now = rows.agg(F.max("ts").alias("now")).first()["now"]
    closes = bars30(spark, sf, 60).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    doubled = S.latest_price(rows).withColumn("price", F.col("price") * 2)
    return S.fresh_price(doubled, closes, F.lit(now))


@query(
    "stream_fresh_price",
    """WITH m AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 minute', ts) AS b, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
       c AS (SELECT symbol, last(close ORDER BY b) * 2 AS close FROM m GROUP BY 1), now AS (SELECT max(ts) AS t FROM events),
       l AS (SELECT event_type AS symbol, max(ts) AS ts, last(value ORDER BY ts, event_id) AS price FROM events GROUP BY 1)
       SELECT symbol, CASE WHEN epoch_us(t) - epoch_us(ts) < 300000000 THEN price ELSE close END AS price, epoch_us(t) - epoch_us(ts) < 300000000 AS live FROM l JOIN c USING (symbol), now""",
)
def _(spark, sf):
    """What the last batch of the stream leaves: live prices, or the close (doubled, to tell them apart)."""
    path = new_path(spark, "fresh")
    closes = bars30(spark, sf, 60).groupBy("symbol").agg((F.max_by("close", "ts") * 2).alias("close"))
    S.stream_fresh_price(tick_stream(spark, sf), stage(closes, "closes"), path)
    prices = spark.read.option("basePath", f"{path}/prices").parquet(f"{path}/prices")
    last = prices.agg(F.max("batch")).first()[0]
    return prices.filter(F.col("batch") == last).drop("batch")


@query(
    "stream_bars",
    "SELECT * FROM bars30 WHERE ts + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
    ("bars30",),
)
def _(spark, sf):
    return wall(S.collect_stream(S.stream_bars(tick_stream(spark, sf)), "stream-bars"))


@query("stream_features", f"WITH {REALTIME_SQL}", ("bars30",))
def _(spark, sf):
    emitted = S.collect_stream(S.stream_features(bar_stream(spark, sf)), "stream-features")
    newest = S.newest_per_symbol(emitted).drop("seen")
    return rounded(wall(newest), *X.REALTIME[:-1])


@query("append_and_refresh", f"WITH {REALTIME_SQL}", ("bars30",))
def _(spark, sf):
    history, features = new_path(spark, "history"), new_path(spark, "refreshed")
    S.append_and_refresh(bar_stream(spark, sf), history, features)
    newest = S.newest_per_symbol(spark.read.option("basePath", features).parquet(features), "batch").drop("batch")
    return rounded(wall(newest), *X.REALTIME[:-1])


@query(
    "fan_out",
    """SELECT symbol, event_id, handler FROM (SELECT event_type AS symbol, event_id FROM events), (VALUES ('all'), ('replayed')) h(handler)
       UNION ALL SELECT event_type, event_id, 'clicks' FROM events WHERE event_type = 'click'""",
)
def _(spark, sf):
    """Rows each handler wrote; one that fails stops neither of the others and gets its batches again."""
    first, second, third, failed = (new_path(spark, name) for name in ("fan", "fan", "fan", "failed"))

    def broken(batch, number):
        raise RuntimeError("handler failed")

    def writes(path, keep="true"):
        return lambda batch, number: batch.filter(keep).write.mode("overwrite").parquet(S.batch_folder(path, number))

    handlers = {"all": writes(first), "broken": broken, "clicks": writes(second, "symbol = 'click'")}
    S.fan_out(tick_stream(spark, sf), handlers, failed)
    S.replay(spark, failed, TICK, "broken", writes(third))
    out = None
    for path, name in ((first, "all"), (second, "clicks"), (third, "replayed")):
        rows = spark.read.schema(TICK).parquet(path).select("symbol", "event_id", F.lit(name).alias("handler"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_dedupe", "SELECT event_type AS symbol, ts, event_id, value AS price FROM events")
def _(spark, sf):
    """Each tick comes again with another price, at once or up to days later: the first arrival counts."""
    first = ticks(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", "size", F.col("ts").alias("at"))
    again = first.withColumns({"price": F.col("price") + 1000, "at": F.col("at") + F.expr("make_dt_interval(event_id % 9, 0, 1, 0)")})
    path = new_path(spark, "doubled")
    cut = stage(first.unionByName(again).repartitionByRange(BATCHES, "at").withColumn("_part", F.spark_partition_id()), "doubled")
    for part in range(BATCHES):  # within a file the order of arrival is that of its rows
        cut.filter(F.col("_part") == part).coalesce(1).sortWithinPartitions("at").select("symbol", "ts", "event_id", "price", "size").write.mode("append").parquet(path)
    stream = S.read_ticks(spark, path, TICK, files_per_batch=1)
    single = S.collect_stream(S.stream_dedupe(stream, "60 days", ("symbol", "event_id")), "single")
    return wall(single.select("symbol", "ts", "event_id", "price"))


LOG = "timestamp timestamp, level string, execution_time double"
HOURS = """hrs AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) FILTER (WHERE level = 'ERROR') AS n_errors, count(*) FILTER (WHERE execution_time > 1) AS n_slow,
    max(execution_time) AS max_execution_time FROM logs GROUP BY 1),
  closed AS (SELECT * FROM hrs WHERE hour + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM logs))"""


def hours(spark, sf):
    rows = logs(spark, sf).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "execution_time")
    return wall(S.collect_stream(S.stream_log_hours(landed(spark, rows, "logs", LOG, "timestamp")), "hours"), "hour")


@query("stream_log_hours", f"WITH {HOURS} SELECT hour, n_errors, n_slow, R(max_execution_time) AS max_execution_time FROM closed", ("logs",))
def _(spark, sf):
    return rounded(hours(spark, sf), "max_execution_time")


@query(
    "stream_log_alerts",
    f"""WITH {HOURS}, c AS (SELECT *, sum(n_errors) OVER w / nullif(count(*) FILTER (WHERE n_errors > 0) OVER w, 0) AS m FROM closed WINDOW w AS (ORDER BY hour))
        SELECT hour, n_errors, R(m) AS mean_errors FROM c WHERE n_errors > 1.2 * m""",
    ("logs",),
)
def _(spark, sf):
    """Spikes found as their hours close, by the mean of the hours so far."""
    rows = logs(spark, sf).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "execution_time")
    path = new_path(spark, "spikes")
    S.stream_spikes(S.stream_log_hours(landed(spark, rows, "logs", LOG, "timestamp")), path, 1.2)
    alerts = spark.read.schema("hour timestamp, n_errors long, mean_errors double").parquet(f"{path}/alerts")
    return rounded(wall(alerts.select("hour", "n_errors", "mean_errors"), "hour"), "mean_errors")


@query("stream_slow_operations", "SELECT timestamp, level, R(execution_time) AS execution_time FROM logs WHERE execution_time > 1", ("logs",))
def _(spark, sf):
    rows = logs(spark, sf).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "execution_time")
    stream = landed(spark, rows, "logs", LOG, "timestamp")
    return rounded(wall(S.collect_stream(S.stream_slow_operations(stream, 1.0), "slow"), "timestamp"), "execution_time")


# Batches are fifths of the time span here, so that SQL can tell which rows a threshold has seen.
FIFTHS = """span AS (SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM logs),
  l AS (SELECT timestamp, level, function, execution_time, (epoch_us(timestamp) - lo) * 5 // (hi - lo + 1) AS batch FROM logs, span),
  batches AS (SELECT DISTINCT batch FROM l)"""


def fifths(spark, sf):
    rows = stage(logs(spark, sf).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "level", "function", "execution_time"), "logs")
    at = F.unix_micros("timestamp")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    part = F.expr(f"cast((unix_micros(timestamp) - {lo}) * {BATCHES} div {hi - lo + 1} as int)")
    return landed(spark, rows, "logs", "timestamp timestamp, level string, function string, execution_time double", "timestamp", part)


def slow_alerts(spark, path):
    whole = spark.read.schema("timestamp timestamp, level string, function string, execution_time double, threshold double").parquet(f"{path}/alerts")
    rows = wall(whole.select("timestamp", "level", "function", "execution_time", "threshold"), "timestamp")
    return rounded(rows, "execution_time", "threshold")


@query(
    "stream_slow_anomalies",
    f"""WITH {FIFTHS}, t AS (SELECT b.batch, avg(execution_time) + 3 * stddev_pop(execution_time) AS threshold FROM batches b JOIN l ON l.batch <= b.batch GROUP BY 1)
        SELECT timestamp, level, function, R(execution_time) AS execution_time, R(threshold) AS threshold FROM l JOIN t USING (batch) WHERE execution_time > threshold""",
    ("logs",),
)
def _(spark, sf):
    """Operations beyond mean + 3 deviations of all times so far, found batch by batch."""
    path = new_path(spark, "slow-anomalies")
    S.stream_slow_anomalies(fifths(spark, sf), path)
    return slow_alerts(spark, path)


@query(
    "stream_slow_by_function",
    f"""WITH {FIFTHS}, t AS (SELECT b.batch, l.function, avg(execution_time) + 3 * stddev_pop(execution_time) AS threshold FROM batches b JOIN l ON l.batch <= b.batch GROUP BY 1, 2)
        SELECT timestamp, level, function, R(execution_time) AS execution_time, R(threshold) AS threshold FROM l JOIN t USING (batch, function) WHERE execution_time > threshold""",
    ("logs",),
)
def _(spark, sf):
    """As ``stream_slow_anomalies`` with a threshold of its own for every function."""
    path = new_path(spark, "slow-functions")
    S.stream_slow_anomalies(fifths(spark, sf), path, keys=["function"])
    return slow_alerts(spark, path)
