"""Queries on time, keys, projection, order and limits."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.fixtures import TICKS, bars30, bars_user, dirty_bars, table, ticks
from tidemark.operators import keys as K
from tidemark.plans.quantiles import exact_quantiles
from tidemark.plans.series import highest, row_count, running, total

HALF_HOUR = 1800


@query("resample_ohlcv", "SELECT symbol, ts, open, high, low, close, volume FROM bars30", ("bars30",))
def _(spark, sf):
    return bars30(spark, sf)


@query(
    "resample_bars_1h",
    """SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts,
              first(open ORDER BY rn) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
              last(close ORDER BY rn) FILTER (WHERE close IS NOT NULL) AS close, coalesce(sum(volume), 0)::BIGINT AS volume
       FROM dirty GROUP BY 1, 2
       HAVING count(high) > 0 AND count(close) > 0""",
    ("dirty",),
)
def _(spark, sf):
    return K.resample_ohlcv(dirty_bars(spark, sf).filter("dup = 0"), 3600)


@query(
    "localize",
    """WITH shifted AS (
         SELECT event_id, t AS ts, timezone('America/New_York', t) AT TIME ZONE 'UTC' AS utc
         FROM (SELECT event_id, ts + INTERVAL 69 DAY AS t FROM events UNION ALL
               SELECT event_id, ts + INTERVAL 307 DAY FROM events)),
       back AS (SELECT *, timezone('America/New_York', timezone('UTC', utc)) AS wall,
                       timezone('America/New_York', timezone('UTC', utc + INTERVAL 1 HOUR)) AS wall_up,
                       timezone('America/New_York', timezone('UTC', utc - INTERVAL 1 HOUR)) AS wall_down FROM shifted)
       SELECT event_id, ts,
              CASE WHEN wall_up = ts OR wall_down = ts THEN NULL
                   WHEN wall <> ts THEN timezone('America/New_York', date_trunc('hour', wall)) AT TIME ZONE 'UTC' ELSE utc END AS utc
       FROM back""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    spring = events.select("event_id", (F.col("ts") + F.expr("INTERVAL 69 DAYS")).alias("ts"))
    autumn = events.select("event_id", (F.col("ts") + F.expr("INTERVAL 307 DAYS")).alias("ts"))
    return K.localize(spring.unionByName(autumn))


@query(
    "coerce_numeric",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS price, try_cast(props AS DOUBLE) AS bad FROM events""",
)
def _(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("price"),
        F.col("props").alias("bad"),
    )
    return K.coerce_numeric(text, ["price", "bad"])


@query("dedupe_ts", "SELECT symbol, ts, open, high, low, close, volume, rn, 0 AS dup FROM dirty", ("dirty",))
def _(spark, sf):
    return K.dedupe_ts(dirty_bars(spark, sf), arrival=["rn", "dup"])


@query("sort_by_time", "SELECT symbol, ts, close FROM bars30 ORDER BY symbol, ts", ("bars30",))
def _(spark, sf):
    return K.sort_by_time(bars30(spark, sf)).select("symbol", "ts", "close")


@query(
    "latest_n",
    """SELECT symbol, ts, event_id, price, size FROM (
         SELECT event_type AS symbol, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
                row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 100""",
)
def _(spark, sf):
    return K.latest_n(ticks(spark, sf), 100, TICKS)


@query(
    "latest_row",
    """SELECT event_type AS symbol, max(ts) AS ts, last(event_id ORDER BY ts, event_id) AS event_id,
              last(value ORDER BY ts, event_id) AS price FROM events GROUP BY 1""",
)
def _(spark, sf):
    return K.latest_row(ticks(spark, sf).drop("size"), TICKS)


@query(
    "calendar_features",
    "SELECT symbol, ts, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week FROM bars30",
    ("bars30",),
)
def _(spark, sf):
    return K.calendar_features(bars30(spark, sf).select("symbol", "ts"))


@query(
    "fill_time_gaps",
    """WITH grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM bars30 GROUP BY 1)
       SELECT symbol, g.ts, b.open, b.high, b.low, b.close, b.volume
       FROM (SELECT * FROM grid) g ASOF JOIN bars30 b USING (symbol, ts)""",
    ("bars30",),
)
def _(spark, sf):
    return K.fill_time_gaps(bars30(spark, sf), HALF_HOUR)


@query(
    "interval_stats",
    """WITH s AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS us FROM bars30),
       c AS (SELECT symbol, us, count(*) AS n FROM s WHERE us IS NOT NULL GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, us) AS place,
                    sum(n) OVER (PARTITION BY symbol) AS total, count(*) OVER (PARTITION BY symbol) AS kinds FROM c)
       SELECT symbol, total::BIGINT AS n_steps, us / 1e6 AS modal_step, R(n / total) AS consistency,
              kinds AS unique_steps, (total - n)::BIGINT AS irregular_steps
       FROM r WHERE place = 1""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(K.interval_stats(bars30(spark, sf)), "consistency")


@query(
    "missing_grid_points",
    """WITH grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM bars30 GROUP BY 1)
       SELECT symbol, ts FROM grid EXCEPT SELECT symbol, ts FROM bars30""",
    ("bars30",),
)
def _(spark, sf):
    return K.missing_grid_points(bars30(spark, sf), HALF_HOUR)


@query(
    "in_session",
    """SELECT symbol, ts, hour(ts) >= lo AND hour(ts) < hi AS in_session
       FROM (SELECT *, CASE symbol WHEN 'click' THEN 0 WHEN 'signup' THEN 0 ELSE 9 END AS lo,
                    CASE symbol WHEN 'click' THEN 24 WHEN 'signup' THEN 24 ELSE 16 END AS hi FROM bars30)""",
    ("bars30",),
)
def _(spark, sf):
    exchange = F.when(F.col("symbol") == "click", "FOREX").when(F.col("symbol") == "signup", "OTHER").otherwise("NYSE")
    return K.in_session(bars30(spark, sf).select("symbol", "ts"), exchange)


@query(
    "session_log_filter",
    """SELECT level, count(*) AS n FROM logs
       WHERE NOT (hour(timestamp) >= 9 AND hour(timestamp) < 16) OR level IN ('WARNING', 'ERROR') GROUP BY 1""",
    ("logs",),
)
def _(spark, sf):
    from tidemark.fixtures import logs

    return K.session_log_filter(logs(spark, sf), ts="timestamp").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_batches",
    """SELECT event_id, ts, value, NULL::BIGINT AS size FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, ts, NULL, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type <> 'click'""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "ts", "value")
    others = events.filter("event_type <> 'click'").select(
        "event_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("size")
    )
    return K.union_batches([clicks, others])


@query(
    "coverage",
    """SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts,
              min(ts) <= TIMESTAMP '2024-01-01 12:00:00' AND max(ts) >= TIMESTAMP '2024-01-30 00:00:00' AS covered
       FROM bars_user GROUP BY 1""",
    ("bars_user",),
)
def _(spark, sf):
    return K.coverage(bars_user(spark, sf), "2024-01-01 12:00:00", "2024-01-30 00:00:00")


_PREDICTIONS = """WITH p AS (SELECT symbol, ts, close > open AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS a,
                row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS z FROM bars30 WHERE volume > 60),
       b AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS a,
                row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS z FROM bars30)
       SELECT b.symbol, b.ts, b.close, p.up FROM b JOIN p ON b.symbol = p.symbol AND b.{end} = p.{end}"""


def _predictions(spark, sf):
    return bars30(spark, sf).filter("volume > 60").select("symbol", "ts", (F.col("close") > F.col("open")).alias("up"))


@query("align_tail", _PREDICTIONS.format(end="z"), ("bars30",))
def _(spark, sf):
    return K.align_tail(bars30(spark, sf).select("symbol", "ts", "close"), _predictions(spark, sf))


@query("align_head", _PREDICTIONS.format(end="a"), ("bars30",))
def _(spark, sf):
    return K.align_head(bars30(spark, sf).select("symbol", "ts", "close"), _predictions(spark, sf))


# Series beyond the row limits up to which they stay whole; the limits are parameters.


@query(
    "running_in_parts",
    """SELECT symbol, event_id, R(sum(price) OVER w) AS total, max(price) OVER w AS highest, count(*) OVER w AS rn
       FROM (SELECT event_type AS symbol, event_id, ts, value AS price FROM events) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)""",
)
def _(spark, sf):
    rows = ticks(spark, sf)
    parts = TICKS.with_(whole=100)
    out = running(rows, parts, total=total("price"), highest=highest("price"), rn=row_count())
    return rounded(out.select("symbol", "event_id", "total", "highest", "rn"), "total")


@query(
    "quantiles_in_brackets",
    """SELECT event_type AS symbol, R(quantile_cont(value, 0.1)) AS q10, R(quantile_cont(value, 0.5)) AS q50, R(quantile_cont(value, 0.99)) AS q99 FROM events GROUP BY 1""",
)
def _(spark, sf):
    found = exact_quantiles(ticks(spark, sf), ["price"], [0.1, 0.5, 0.99], accuracy=50)
    return rounded(found.select("symbol", *[F.col("q")[i].alias(f"q{n}") for i, n in enumerate((10, 50, 99))]), "q10", "q50", "q99")
