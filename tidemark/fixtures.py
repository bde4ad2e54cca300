"""Series tables derived from the raw tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import day
from tidemark.operators.keys import ticks_to_bars
from tidemark.plans.series import BARS, Axis, numbered, running, total

TICKS = Axis(ts="ts", ties=("event_id",), cell=None)
FILLS = TICKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col(symbol).cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), _k().alias("size"))


def bars30(spark: SparkSession, sf_dir: str, seconds: int = 1800) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), seconds, TICKS, price="price", size="size")


def calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars30 around 100, each series with its own share of the moves: from wild to flat."""
    share = F.create_map(*[F.lit(x) for kv in (("click", 0.05), ("purchase", 0.02), ("view", 0.005), ("error", 0.03), ("signup", 0.0)) for x in kv])
    rows = bars30(spark, sf_dir).withColumn("_s", share[F.col("symbol")])
    return rows.withColumns({c: 100 + (F.col(c) - 50) * F.col("_s") for c in ("open", "high", "low", "close")}).drop("_s")


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir, "user_id"), 86400, TICKS, price="price", size="size")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars30 with faults put in at fixed positions of every series."""
    rn = F.col("rn")
    low = F.when(rn % 97 == 40, F.col("low") * 0.1).otherwise(F.col("low"))
    faulty = numbered(bars30(spark, sf_dir), BARS).select(
        "symbol",
        "ts",
        F.when(rn % 89 == 44, 0.0).otherwise(F.col("open")).alias("open"),
        F.when(rn % 17 == 5, None).when(rn % 71 == 20, F.col("low") - 10).otherwise(F.col("high")).alias("high"),
        low.alias("low"),
        F.when(rn % 23 == 7, None).when(rn % 101 == 50, F.col("close") * 20).otherwise(F.col("close")).alias("close"),
        F.when(rn % 29 == 11, None).when(rn % 61 == 30, -1000).otherwise(F.col("volume")).cast("bigint").alias("volume"),
        "rn",
    )
    copies = F.when(rn % 113 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return faulty.withColumn("dup", F.explode(copies))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: four event types as trade actions, one account per user."""
    actions = F.create_map(*[F.lit(x) for x in ("purchase", "BUY", "view", "SELL", "click", "SHORT", "error", "COVER")])
    return (
        table(spark, sf_dir, "events")
        .filter((F.col("value") > 0.01) & F.col("event_type").isin("purchase", "view", "click", "error"))
        .select(
            F.col("user_id").cast("string").alias("symbol"),
            "ts",
            "event_id",
            actions[F.col("event_type")].alias("action"),
            F.col("value").alias("price"),
            (1 + _k() % 50).alias("shares"),
        )
    )


EQUITY = Axis(cell=86400 * 256)


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account value per order priority and day."""
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), day(F.col("o_orderdate")).alias("ts"))
        .agg(F.sum(sign * F.col("o_totalprice") / 10000).alias("change"))
    )
    return running(daily, EQUITY, sum=total("change")).select("symbol", "ts", (F.col("sum") + 50000).alias("portfolio_value"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO").alias("level"),
        F.concat(F.lit("mod_"), (F.col("user_id") % 12).cast("string")).alias("module"),
        kind.alias("function"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.when(kind.isin("click", "purchase"), F.col("value") / 100).alias("execution_time"),
        "event_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
