"""Queries on logs and on reading and writing files."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.sampling import LABELED, SIZE, labeled
from tidemark.fixtures import bars30, bars_user, equity, ledger, logs, table
from tidemark.operators import loganalysis as A
from tidemark.operators import quality as Q
from tidemark.operators import sampling as P
from tidemark.operators.keys import OHLCV
from tidemark.session import new_path, stage
from tidemark.sources import bars as B
from tidemark.sources import logs as G

METRICS = """SELECT count(*) AS total_entries, min(timestamp) AS start_ts, max(timestamp) AS end_ts, R(avg(execution_time)) AS avg_execution_time,
   R(max(execution_time)) AS max_execution_time, count(*) FILTER (WHERE execution_time > 1) AS slow_operations,
   R(count(*) FILTER (WHERE level = 'ERROR') * 100 / count(*)) AS error_pct, R(count(*) FILTER (WHERE level = 'WARNING') * 100 / count(*)) AS warning_pct,
   R((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9) AS duration_hours FROM logs"""


@query("log_metrics", METRICS, ("logs",))
def _(spark, sf):
    return rounded(A.log_metrics(logs(spark, sf)), "avg_execution_time", "max_execution_time", "error_pct", "warning_pct", "duration_hours")


@query("level_distribution", "SELECT level, count(*) AS n FROM logs GROUP BY 1", ("logs",))
def _(spark, sf):
    return A.level_distribution(logs(spark, sf))


@query("module_activity", "SELECT module, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, module LIMIT 10", ("logs",))
def _(spark, sf):
    return A.module_activity(logs(spark, sf))


@query(
    "slow_anomalies",
    """WITH l AS (SELECT avg(execution_time) + 3 * stddev_pop(execution_time) AS threshold FROM logs), s AS (SELECT logs.*, threshold FROM logs, l WHERE execution_time > threshold)
       SELECT timestamp, event_id, function, execution_time, R(threshold) AS threshold, (SELECT count(*) FROM s) AS n_slow FROM s ORDER BY timestamp, event_id LIMIT 5""",
    ("logs",),
)
def _(spark, sf):
    return rounded(A.slow_anomalies(logs(spark, sf), ("timestamp", "event_id")), "threshold")


@query(
    "error_spikes",
    """WITH h AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) AS n_errors FROM logs WHERE level = 'ERROR' GROUP BY 1)
       SELECT hour, n_errors, R(m) AS mean_errors FROM h, (SELECT avg(n_errors) AS m FROM h) WHERE n_errors > 2 * m""",
    ("logs",),
)
def _(spark, sf):
    return rounded(A.error_spikes(logs(spark, sf)), "mean_errors")


@query(
    "hourly_level_pivot",
    "SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, "
    + ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS \"{v}\"" for v in A.LEVELS)
    + " FROM logs GROUP BY 1",
    ("logs",),
)
def _(spark, sf):
    return A.hourly_level_pivot(logs(spark, sf))


@query(
    "time_histogram",
    """WITH t AS (SELECT execution_time AS x FROM logs WHERE execution_time < 10), e AS (SELECT min(x) AS lo, max(x) AS hi FROM t),
       b AS (SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49)::INT AS bin, lo, hi FROM t, e)
       SELECT bin, R(lo + bin * ((hi - lo) / 50)) AS from_time, R(lo + (bin + 1) * ((hi - lo) / 50)) AS to_time, count(*) AS n FROM b GROUP BY bin, lo, hi""",
    ("logs",),
)
def _(spark, sf):
    return rounded(A.time_histogram(logs(spark, sf)), "from_time", "to_time")


@query(
    "recent_stats",
    """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY timestamp DESC, event_id DESC) AS nth FROM logs) WHERE nth <= 500)
       SELECT module, count(*) AS total_logs, R(avg(execution_time)) AS avg_execution_time, R(max(execution_time)) AS max_execution_time, """
    + ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS n_{v.lower()}" for v in A.LEVELS)
    + " FROM r GROUP BY 1",
    ("logs",),
)
def _(spark, sf):
    stats = A.recent_stats(logs(spark, sf), 500, order=("timestamp", "event_id"))
    return rounded(stats, "avg_execution_time", "max_execution_time")


def records(spark, sf):
    """Every event as a log record; some lack fields, some carry a context, some failed."""
    e = table(spark, sf, "events")
    id, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    trade = F.when(
        kind == "purchase",
        F.struct(F.lit("BUY").alias("action"), F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), k.cast("double").alias("quantity"), F.col("value").alias("price")),
    )
    strategy = F.when(kind == "view", F.struct(F.lit("trend").alias("strategy_name"), F.lit("UP").alias("signal"), (k / 100).alias("confidence")))
    market = F.when(kind == "click", F.struct(F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.col("value").alias("price"), k.alias("volume"), F.lit("quote").alias("data_type")))
    failure = F.when(kind == "error", F.struct(F.lit("ValueError").alias("type"), F.lit("bad { brace").alias("message"), F.array(F.lit("line 1"), F.lit("line 2")).alias("traceback")))
    return e.select(
        id.alias("event_id"),
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(id % 2 == 0, "Z").otherwise("+00:00")).alias("timestamp"),
            F.when(id % 11 != 0, F.when(kind == "error", "ERROR").otherwise("INFO")).alias("level"),
            F.concat(F.lit("mod_"), (F.col("user_id") % 12).cast("string")).alias("module"),
            kind.alias("function"),
            F.when(id % 5 != 0, id % 100).cast("int").alias("line"),
            F.concat(F.lit("event "), id.cast("string")).alias("message"),
            F.struct(F.when(kind == "click", F.col("value") / 100).alias("execution_time"), trade.alias("trade"), strategy.alias("strategy"), market.alias("market_data")).alias("custom"),
            failure.alias("exception"),
        ).alias("r"),
    )


PARSED = """SELECT ts AS timestamp, CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'UNKNOWN' AS logger,
   'mod_' || (user_id % 12) AS module, event_type AS function, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 100 END::INT AS line, 'event ' || event_id AS message,
   CASE WHEN event_type = 'click' THEN value / 100 END AS execution_time, CASE WHEN event_type = 'error' THEN 'bad { brace' END AS error_message FROM events"""


def _flat(df):
    return df.drop("custom", "exception").withColumn("error_message", F.lit(None)) if "exception" not in df.columns else df.withColumn(
        "error_message", F.col("exception.message")
    ).drop("custom", "exception")


def _written(spark, sf, layout):
    """Records as files: lines or indented text, next to an error log that must be left out."""
    path = new_path(spark, "logs")
    options = {"pretty": "true"} if layout == "pretty" else {}
    records(spark, sf).select(F.to_json("r", options).alias("value")).write.text(path)
    return path


@query("parse_json_logs", PARSED)
def _(spark, sf):
    return _flat(G.read_json_logs(spark, _written(spark, sf, "lines"), glob="*.txt"))


@query("parse_json_logs_pretty", PARSED)
def _(spark, sf):
    return _flat(G.read_json_logs(spark, _written(spark, sf, "pretty"), "pretty", glob="*.txt"))


@query(
    "parse_pipe_logs",
    """SELECT ts AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'UNKNOWN' AS logger,
         CASE WHEN event_id % 4 = 0 THEN 'plain' ELSE 'pkg.mod_' || (user_id % 12) END AS module, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE event_type END AS function,
         CASE WHEN event_id % 4 = 1 THEN event_id % 100 ELSE 0 END::INT AS line,
         CASE WHEN event_type = 'click' THEN 'done | execution_time=' || printf('%.2f', value) ELSE 'event | ' || event_id END AS message,
         CASE WHEN event_type = 'click' THEN round(value, 2) END AS execution_time FROM events WHERE event_id % 13 <> 0""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    id, kind = F.col("event_id"), F.col("event_type")
    place = F.when(id % 4 == 0, "plain").when(id % 4 == 1, F.concat(F.lit("pkg.mod_"), F.col("user_id") % 12, F.lit("."), kind, F.lit(":"), id % 100)).otherwise(
        F.concat(F.lit("pkg.mod_"), F.col("user_id") % 12, F.lit("."), kind)
    )
    message = F.when(kind == "click", F.concat(F.lit("done | execution_time="), F.format_string("%.2f", "value"))).otherwise(F.concat(F.lit("event | "), id))
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(kind == "error", "ERROR").otherwise("INFO"), place, message)
    return G.parse_pipe_logs(e.select(F.when(id % 13 == 0, F.lit("no bars here")).otherwise(line).alias("value")))


@query(
    "parse_latency_logs",
    """SELECT date_trunc('milliseconds', ts) AS timestamp, 'mod_' || (user_id % 12) AS module, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         value AS execution_time, 'a|b ' || event_id AS message FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat_ws(
        "|",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.concat(F.lit("mod_"), F.col("user_id") % 12),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"),
        F.concat(F.lit("latency="), F.col("value"), F.lit("s")),
        F.concat(F.lit("a|b "), F.col("event_id")),
    )
    return G.parse_latency_logs(e.select(line.alias("value")))


def _parsed(spark, sf):
    return G.parse_json_logs(records(spark, sf).select(F.to_json("r").alias("value")))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "extract_context_trade",
    f"SELECT 'event ' || event_id AS message, 'BUY' AS action, 'U' || user_id AS ticker, {_K}::DOUBLE AS quantity, value AS price, R({_K} * value) AS value, NULL::VARCHAR AS strategy, ts AS timestamp FROM events WHERE event_type = 'purchase'",
)
def _(spark, sf):
    return rounded(G.extract_context(_parsed(spark, sf), "trade"), "value")


@query(
    "extract_context_strategy",
    f"SELECT 'event ' || event_id AS message, 'trend' AS strategy_name, 'UP' AS signal, {_K} / 100 AS confidence, NULL::VARCHAR AS ticker, ts AS timestamp FROM events WHERE event_type = 'view'",
)
def _(spark, sf):
    return G.extract_context(_parsed(spark, sf), "strategy")


@query(
    "extract_context_market_data",
    f"SELECT 'event ' || event_id AS message, 'U' || user_id AS ticker, value AS price, {_K} AS volume, 'quote' AS data_type, ts AS timestamp FROM events WHERE event_type = 'click'",
)
def _(spark, sf):
    return G.extract_context(_parsed(spark, sf), "market_data")


@query(
    "operation_stats",
    f"""WITH o AS (SELECT 'load_' || (user_id % 9) AS operation, CASE WHEN event_type = 'signup' THEN 'Starting' WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS state,
          CASE WHEN event_type <> 'signup' THEN value END AS t, {_K} % 4 AS kind FROM events WHERE event_type <> 'view')
        SELECT operation, count(*) FILTER (WHERE state = 'Starting') AS started, count(*) FILTER (WHERE state = 'Completed') AS completed, count(*) FILTER (WHERE state = 'Failed') AS failed,
          R(avg(t)) AS avg_execution_time, R(max(t)) AS max_execution_time, count(DISTINCT kind) FILTER (WHERE state = 'Failed') AS error_kinds FROM o GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    word = F.when(kind == "signup", "Starting").when(kind == "error", "Failed").when(kind == "view", "Ignoring").otherwise("Completed")
    messages = e.select(
        F.concat(word, F.lit(" load_"), F.col("user_id") % 9, F.lit(": run")).alias("message"),
        F.col("value").alias("execution_time"),
        (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("error_type"),
    )
    return rounded(A.operation_stats(messages), "avg_execution_time", "max_execution_time")


# ---------------------------------------------------------------------------------------------------------
# Files.


@query(
    "bars_csv",
    "SELECT symbol, ts, open, high, low, close, volume FROM bars30 WHERE symbol IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'",
    ("bars30",),
)
def _(spark, sf):
    path = new_path(spark, "bars")
    B.write_bars_csv(bars30(spark, sf), path)
    return B.read_bars_csv(spark, path, ["click", "view"], "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("features_parquet", "SELECT symbol, ts, close FROM bars30", ("bars30",))
def _(spark, sf):
    path = new_path(spark, "features")
    B.write_features(bars30(spark, sf), path)
    return B.read_features(spark, path, ["symbol", "ts", "close"])


@query(
    "parse_vendor_json",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars30),
       p AS (SELECT symbol, ts + INTERVAL 40 DAY AS ts, open, high, low, CASE WHEN rn % 19 = 3 THEN NULL ELSE close END AS close, volume::DOUBLE AS volume
             FROM v WHERE day(ts) <> 7)
       SELECT symbol, ts, CASE WHEN up = ts OR down = ts THEN NULL WHEN wall <> ts THEN timezone('America/New_York', date_trunc('hour', wall)) AT TIME ZONE 'UTC' ELSE utc END AS utc,
              open, high, low, close, volume
       FROM (SELECT *, timezone('America/New_York', timezone('UTC', utc)) AS wall, timezone('America/New_York', timezone('UTC', utc + INTERVAL 1 HOUR)) AS up,
                    timezone('America/New_York', timezone('UTC', utc - INTERVAL 1 HOUR)) AS down
             FROM (SELECT *, timezone('America/New_York', ts) AT TIME ZONE 'UTC' AS utc FROM p WHERE close IS NOT NULL))""",
    ("bars30",),
)
def _(spark, sf):
    """One payload per symbol and day, sent twice with different volumes; the seventh day is refused."""
    from tidemark.plans.series import BARS, numbered

    rows = numbered(bars30(spark, sf), BARS)
    text = {c: F.col(c).cast("string") for c in OHLCV}
    text["close"] = F.when(F.col("rn") % 19 == 3, "n/a").otherwise(text["close"])
    shifted = F.col("ts") + F.expr("INTERVAL 40 DAYS")
    copies = rows.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    text["volume"] = F.when(F.col("attempt") == 1, "7").otherwise(text["volume"])
    value = F.struct(F.date_format(shifted, "yyyy-MM-dd HH:mm:ss").alias("datetime"), *[v.alias(c) for c, v in text.items()])
    # A day holds at most 48 bars.
    payloads = copies.groupBy("symbol", F.to_date("ts").alias("day"), "attempt").agg(F.sort_array(F.collect_list(value)).alias("values"))
    status = F.when(F.dayofmonth("day") == 7, "error").otherwise("ok")
    payloads = payloads.select("symbol", "attempt", F.to_json(F.struct(status.alias("status"), "values")).alias("payload"))
    return B.parse_vendor_json(payloads, arrival=["attempt"])


@query(
    "windows_parquet",
    f"""WITH {LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n AND (rn - 61) % 3 = 0),
        s AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r, count(*) OVER (PARTITION BY symbol) AS m, least(size, rn - 1) AS size FROM sized)
        SELECT CASE WHEN r > floor(m * 0.8::DOUBLE) THEN 'test' WHEN r > floor(floor(m * 0.8::DOUBLE) * 0.9::DOUBLE) THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(size)::BIGINT AS steps FROM s GROUP BY 1""",
    ("bars30",),
)
def _(spark, sf):
    return written_windows(spark, sf, 3)


def written_windows(spark, sf, stride):
    windows = P.time_split(stage(P.sequences(labeled(spark, sf), ["close", "volume"], stride=stride), "windows"))
    path = new_path(spark, "windows")
    B.write_windows(windows, path)
    back = B.read_windows(spark, path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("window")).alias("steps"))


@query(
    "all_windows_parquet",
    f"""WITH {LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n),
        s AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r, count(*) OVER (PARTITION BY symbol) AS m, least(size, rn - 1) AS size FROM sized)
        SELECT CASE WHEN r > floor(m * 0.8::DOUBLE) THEN 'test' WHEN r > floor(floor(m * 0.8::DOUBLE) * 0.9::DOUBLE) THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(size)::BIGINT AS steps FROM s GROUP BY 1""",
    ("bars30",),
)
def _(spark, sf):
    """Every row's window."""
    return written_windows(spark, sf, 1)


@query("results_csv", "SELECT (SELECT count(*) FROM equity) AS equity_rows, (SELECT count(*) FROM ledger) AS trades", ("equity", "ledger"))
def _(spark, sf):
    path = new_path(spark, "results")
    B.write_results(equity(spark, sf), ledger(spark, sf), path)
    rows = spark.read.option("header", "true").csv(f"{path}/equity").agg(F.count(F.lit(1)).alias("equity_rows"))
    return rows.crossJoin(spark.read.option("header", "true").csv(f"{path}/trades").agg(F.count(F.lit(1)).alias("trades")))


@query(
    "report_json",
    """SELECT symbol, count(*) AS sample_count, 'close' AS "column", 0::BIGINT AS n_null, count(*) FILTER (WHERE close = 0) AS n_zero FROM bars_user GROUP BY 1""",
    ("bars_user",),
)
def _(spark, sf):
    path = new_path(spark, "report")
    report = Q.stage_report(bars_user(spark, sf), "raw", ["close"])
    B.write_report_json(report, path)
    back = spark.read.schema("symbol string, sample_count bigint, column string, n_null bigint, n_zero bigint").json(path)
    return back
