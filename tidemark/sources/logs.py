"""Structured and text logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCEPTION = "struct<type: string, message: string, traceback: array<string>>"
RECORD = (
    "timestamp string, level string, logger string, module string, function string, line int, thread string, process string, "
    f"message string, exception {EXCEPTION}, custom map<string,string>"
)
BLANKS = " \t\r\n"
COLUMNS = ("timestamp", "level", "logger", "module", "function", "line", "message", "execution_time", "custom", "exception")


def iso_timestamp(text: Column) -> Column:
    """ISO text, with or without offset, as UTC wall clock; null if it is none."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def read_json_logs(spark: SparkSession, path: str, layout: str = "lines", glob: str = "*.log") -> DataFrame:
    """JSON records of all matching files but ``*_error.log``.

    ``lines``: one record per line. ``pretty``: indented records one after another; the closing brace in the
    first column ends a record, so large files are still read in splits.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    text = reader.text(path, lineSep="\n}") if layout == "pretty" else reader.text(path)
    kept = text.filter(~F.col("_metadata.file_name").endswith("_error.log"))
    if layout == "pretty":
        kept = kept.filter(F.col("value").contains("{")).withColumn("value", F.concat("value", F.lit("\n}")))
    return parse_json_logs(kept)


def parse_json_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per record of JSON text; absent fields get UNKNOWN, 0 or an empty message; text that is no
    JSON object goes."""
    text = F.btrim(F.col(column), F.lit(BLANKS))
    parsed = df.filter(text.startswith("{")).select(F.from_json(text, RECORD).alias("_r"))
    r = F.col("_r")
    whole = parsed.filter(F.coalesce(*[r[c].cast("string") for c in ("timestamp", "level", "logger", "module", "function", "message")]).isNotNull())

    def known(name: str) -> Column:
        return F.coalesce(r[name], F.lit("UNKNOWN")).alias(name)

    return whole.select(
        iso_timestamp(r["timestamp"]).alias("timestamp"),
        known("level"),
        known("logger"),
        known("module"),
        known("function"),
        F.coalesce(r["line"], F.lit(0)).alias("line"),
        F.coalesce(r["message"], F.lit("")).alias("message"),
        r["custom"]["execution_time"].try_cast("double").alias("execution_time"),
        r["custom"].alias("custom"),
        r["exception"].alias("exception"),
    )


def parse_pipe_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """``time | LEVEL | module.function:line | message``; the message may hold more bars."""
    parts = F.split(F.col(column), r"\|", 4)
    rows = df.filter(~F.ltrim(F.col(column)).startswith("{")).select(parts.alias("_p")).filter(F.size("_p") >= 4)
    place = F.trim(F.col("_p")[2])
    dotted = place.contains(".")
    tail = F.regexp_extract(place, r"^.*\.([^.]*)$", 1)
    message = F.trim(F.col("_p")[3])
    line = F.regexp_extract(tail, r":(\d+)$", 1)
    seconds = F.regexp_extract(message, r"execution_time[=:]\s*([\d.]+)", 1)
    return rows.select(
        iso_timestamp(F.trim(F.col("_p")[0])).alias("timestamp"),
        F.trim(F.col("_p")[1]).alias("level"),
        F.lit("UNKNOWN").alias("logger"),
        F.when(dotted, F.regexp_extract(place, r"^(.*)\.[^.]*$", 1)).otherwise(place).alias("module"),
        F.when(dotted, F.substring_index(tail, ":", 1)).otherwise("UNKNOWN").alias("function"),
        F.coalesce(F.when(dotted, line.try_cast("int")), F.lit(0)).alias("line"),
        message.alias("message"),
        seconds.try_cast("double").alias("execution_time"),
    )


def parse_latency_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """The older ``time|module|LEVEL|latency=..s|message``."""
    parts = F.split(F.col(column), r"\|", 5)
    rows = df.select(parts.alias("_p")).filter((F.size("_p") >= 5) & F.col("_p")[3].startswith("latency="))
    return rows.select(
        F.try_to_timestamp(F.trim(F.col("_p")[0]), F.lit("yyyy-MM-dd HH:mm:ss[,SSS]")).cast("timestamp_ntz").alias("timestamp"),
        F.col("_p")[1].alias("module"),
        F.col("_p")[2].alias("level"),
        F.regexp_extract(F.col("_p")[3], r"latency=([\d.]+)s", 1).try_cast("double").alias("execution_time"),
        F.col("_p")[4].alias("message"),
    )


# Typed fields of the contexts loggers attach.
CONTEXTS = {
    "trade": "action string, ticker string, quantity double, price double, value double, strategy string, timestamp string",
    "strategy": "strategy_name string, signal string, confidence double, ticker string, timestamp string",
    "market_data": "ticker string, price double, volume bigint, data_type string, timestamp string",
}


def extract_context(df: DataFrame, kind: str) -> DataFrame:
    """The records that carry the context ``kind`` in ``custom``, with its fields as columns; the value of a
    trade is quantity x price where it is not given."""
    parsed = df.withColumn("_c", F.from_json(F.col("custom")[kind], CONTEXTS[kind])).filter("_c is not null")
    names = [f.split()[0] for f in CONTEXTS[kind].split(", ")]
    fields = {n: F.col("_c")[n] for n in names}
    if kind == "trade":
        fields["value"] = F.coalesce(fields["value"], fields["quantity"] * fields["price"])
    fields["timestamp"] = F.coalesce(iso_timestamp(fields["timestamp"]), F.col("timestamp"))
    return parsed.select(F.col("message"), *[c.alias(n) for n, c in fields.items()])
