"""Registration of queries with their check SQL, and the SQL text of the derived tables.

The SQL is written from the definition of each table and operator, not generated from the Spark code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, using: tuple[str, ...] = ()):
    """Register a query; ``using`` names the derived tables its SQL reads."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle, using)
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round for comparison. A nudge far above rounding noise and far below the last digit settles values that
    lie exactly between two results, as amounts of money often do."""
    return df.withColumns({c: F.round(F.col(c) + nudge(digits), digits) for c in cols})


def nudge(digits: int) -> float:
    return 10.0 ** -(digits + 3)


def sql(text: str, using: tuple[str, ...] = ()) -> str:
    """Expand ``R(x)`` / ``R2(x)`` (rounding without a negative zero) and prepend the derived tables."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            need(other)
        if name not in needed:
            needed.append(name)

    for name in using:
        need(name)
    text = text.strip()
    recursive = text.upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", text, flags=re.I) if text.upper().startswith("WITH") else None
    parts = [TABLES[n] for n in needed]
    if body is not None:
        parts.append(body)
        full = ",\n".join(parts) if parts else body
    else:
        full = ",\n".join(parts) + "\n" + text if parts else text
    if parts:
        full = ("WITH RECURSIVE " if recursive else "WITH ") + full
    return expand_rounding(full)


def expand_rounding(text: str) -> str:
    out, i = [], 0
    pattern = re.compile(r"\bR(\d?)\(")
    while True:
        m = pattern.search(text, i)
        if not m:
            out.append(text[i:])
            return "".join(out)
        out.append(text[i : m.start()])
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        digits = int(m.group(1) or 6)
        inner = f"(({expand_rounding(text[m.end() : j - 1])})::DOUBLE + {nudge(digits):.12f}::DOUBLE)"
        half = f"{0.5 * 10 ** -digits:.12f}".rstrip("0")
        out.append(f"(CASE WHEN abs({inner}) < {half} THEN 0.0::DOUBLE ELSE round({inner}, {digits}) END)")
        i = j


TICK_BARS = """{name} AS (
  SELECT {symbol} AS symbol, time_bucket(INTERVAL {width}, ts) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS volume
  FROM events GROUP BY 1, 2)"""

TABLES = {
    "bars30": TICK_BARS.format(name="bars30", symbol="event_type", width="'30 minutes'"),
    "bars_user": TICK_BARS.format(name="bars_user", symbol="CAST(user_id AS VARCHAR)", width="'1 day'"),
    "dirty0": "dirty0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars30)",
    "dirty_bars": """dirty_bars AS (
  SELECT symbol, ts,
         CASE WHEN rn % 89 = 44 THEN 0.0 ELSE open END AS open,
         CASE WHEN rn % 17 = 5 THEN NULL WHEN rn % 71 = 20 THEN low - 10 ELSE high END AS high,
         CASE WHEN rn % 97 = 40 THEN low * 0.1 ELSE low END AS low,
         CASE WHEN rn % 23 = 7 THEN NULL WHEN rn % 101 = 50 THEN close * 20 ELSE close END AS close,
         CASE WHEN rn % 29 = 11 THEN NULL WHEN rn % 61 = 30 THEN -1000 ELSE volume END AS volume,
         rn, dup
  FROM dirty0, (SELECT 0 AS dup UNION ALL SELECT 1) d WHERE dup = 0 OR rn % 113 = 0)""",
    "dirty": """dirty AS (SELECT symbol, ts, open, high, low, close, volume, rn FROM dirty_bars WHERE dup = 0)""",
    "calm": "calm AS (SELECT symbol, ts, 100 + (open - 50) * s AS open, 100 + (high - 50) * s AS high, 100 + (low - 50) * s AS low, 100 + (close - 50) * s AS close, volume "
    "FROM bars30 JOIN (VALUES ('click', 0.05::DOUBLE), ('purchase', 0.02), ('view', 0.005), ('error', 0.03), ('signup', 0.0)) c(symbol, s) USING (symbol))",
    "ledger": """ledger AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id,
         CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'view' THEN 'SELL' WHEN 'click' THEN 'SHORT' ELSE 'COVER' END AS action,
         value AS price, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS shares
  FROM events WHERE value > 0.01 AND event_type IN ('purchase', 'view', 'click', 'error'))""",
    "equity": """equity AS (
  SELECT symbol, ts, 50000 + sum(change) OVER (PARTITION BY symbol ORDER BY ts) AS portfolio_value
  FROM (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
               sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * o_totalprice / 10000) AS change
        FROM orders GROUP BY 1, 2))""",
    "logs": """logs AS (
  SELECT ts AS timestamp,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
         'mod_' || (user_id % 12) AS module, event_type AS function, 'event ' || event_id AS message,
         CASE WHEN event_type IN ('click', 'purchase') THEN value / 100 END AS execution_time, event_id
  FROM events)""",
    "vectors": "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS features, label FROM embeddings)",
}
DEPENDS = {"calm": ("bars30",), "dirty0": ("bars30",), "dirty_bars": ("dirty0",), "dirty": ("dirty_bars",)}
