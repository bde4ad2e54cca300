"""Files of bars, features, windows and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keys import OHLCV, coerce_numeric, dedupe_ts, localize

BAR_SCHEMA = "ts timestamp_ntz, open double, high double, low double, close double, volume bigint, symbol string"
_CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def write_bars_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per symbol, so that readers of a symbol list no other files."""
    df.select("ts", *OHLCV, "symbol").write.mode(mode).options(**_CSV).partitionBy("symbol").csv(path)


def read_bars_csv(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored bars; the symbols prune folders, the range is filtered while reading."""
    df = spark.read.schema(BAR_SCHEMA).options(**_CSV).csv(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df


def write_features(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Columnar feature files."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Feature files; with ``columns`` only those are read from disk."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


VENDOR = (
    "status string, code string, message string, "
    "values array<struct<datetime: string, open: string, high: string, low: string, close: string, volume: string>>"
)


def parse_vendor_json(df: DataFrame, tz: str = "America/New_York", payload: str = "payload", arrival: Sequence[str | Column] = ()) -> DataFrame:
    """Vendor payloads (symbol, payload) to typed bars with the wall clock ``ts`` and its instant ``utc``.

    Payloads whose status is not ok give no rows; of doubled stamps the first stays; bars without close go.
    """
    parsed = df.withColumn("_p", F.from_json(payload, VENDOR)).filter("_p.status = 'ok'")
    rows = parsed.select("symbol", *arrival, F.posexplode("_p.values").alias("_pos", "_v"))
    typed = rows.select("symbol", *arrival, "_pos", F.col("_v.datetime").try_cast("timestamp_ntz").alias("ts"), *[F.col(f"_v.{c}").alias(c) for c in OHLCV])
    numeric = coerce_numeric(typed, OHLCV).filter("ts is not null")
    single = dedupe_ts(numeric, arrival=[*arrival, "_pos"]).na.drop(subset=["close"])
    return localize(single, tz).select("symbol", "ts", "utc", *OHLCV)


def write_windows(df: DataFrame, path: str, fitted: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Windows in one folder per split, as float arrays with int labels; the scaler's row beside them."""
    narrow = df.withColumns({"window": F.col("window").cast("array<array<float>>"), "label": F.col("label").cast("int")})
    narrow.write.mode(mode).partitionBy("split").parquet(f"{path}/windows")
    if fitted is not None:
        fitted.write.mode(mode).parquet(f"{path}/scaler")


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/windows")
    return df.filter(F.col("split") == split) if split else df


def write_results(equity: DataFrame, trades: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Equity curve and trades as CSV."""
    equity.write.mode(mode).options(**_CSV).csv(f"{path}/equity")
    trades.write.mode(mode).options(**_CSV).csv(f"{path}/trades")


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per report row."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
