"""Prices that turn old while nothing arrives, told once, when event time has passed them.

A symbol's ticks are kept as the first and last of each span of ``max_age`` seconds (two ticks of one span are never too far
apart), so state is bounded by the delay, not by the ticks. A timer a symbol waits for its earliest span to turn old; it fires
only behind the watermark, so ticks that come out of order, but in time, are all there.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.parts import join_stats

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Silence(StatefulProcessor):
    """Emits (symbol, since, at, price): the last tick before a silence, and when it turned old, in milliseconds."""

    def __init__(self, age: int):
        self.age = age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span bigint", "first bigint, last bigint, event_id bigint, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.sort_values(["ms", "event_id"])
            found = frame.groupby(frame.ms // self.age).agg(first=("ms", "first"), last=("ms", "last"), event_id=("event_id", "last"), price=("price", "last"))
            for span, first, last, event_id, price in found.itertuples():
                span = (int(span),)
                if self.spans.containsKey(span):
                    known = self.spans.getValue(span)
                    first = min(first, known[0])
                    if (known[1], known[2]) > (last, event_id):
                        last, event_id, price = known[1], known[2], known[3]
                self.spans.updateValue(span, (int(first), int(last), int(event_id), float(price)))
        self._wait()
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        out = []
        for (span, (_, last, _, price)), after in zip(known, [*known[1:], None]):
            if last + self.age >= now:
                break
            if after is None or after[1][0] - last > self.age:
                out.append((key[0], last, last + self.age, price))
            self.spans.removeKey((span,))
        self._wait()
        yield pd.DataFrame(out, columns=["symbol", "since", "at", "price"])

    def _known(self) -> list[tuple]:
        return sorted((span[0], tuple(value)) for span, value in self.spans.iterator())

    def _wait(self) -> None:
        """One timer a symbol, for its earliest span."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        known = self._known()
        if known:
            self.handle.registerTimer(known[0][1][1] + self.age)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and maps need; the setting before comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_silences(ticks: DataFrame, max_age: float = 300.0, delay: str = "1 hour") -> DataFrame:
    """(symbol, since, ts, last_price) for every tick that no other of its symbol follows within ``max_age`` seconds.

    ``ts`` is when the price turned old, and the row comes out once the watermark has passed it; a symbol that stays silent
    gives one row. Stamps count in whole milliseconds, rounded down, as watermarks do. Of ticks of one millisecond the largest event_id counts. Ticks without
    symbol or stamp are left out; a null price stays null. Start it within ``keyed_state``.
    """
    known = ticks.filter("symbol is not null and ts is not null").withWatermark("ts", delay)
    rows = known.select("symbol", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.col("price").cast("double").alias("price"))
    out = rows.groupBy("symbol").transformWithStateInPandas(
        _Silence(int(max_age * 1000)), "symbol string, since bigint, at bigint, price double", "Append", "EventTime"
    )
    return out.select("symbol", F.timestamp_millis("since").alias("since"), F.timestamp_millis("at").alias("ts"), F.when(~F.isnan("price"), F.col("price")).alias("last_price"))


def stream_fallbacks(ticks: DataFrame, closes: DataFrame, max_age: float = 300.0, delay: str = "1 hour") -> DataFrame:
    """``stream_silences`` with ``price``, the close a symbol falls back to then; null without one. ``closes``: (symbol, close)."""
    return join_stats(stream_silences(ticks, max_age, delay), closes.select("symbol", F.col("close").alias("price")), ["symbol"])
