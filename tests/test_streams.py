"""Streams over several batches against the same work in batch."""

import datetime as dt
import json
import pathlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.indicators import REALTIME, realtime_features
from tidemark.session import new_path
from tidemark.streaming import ticks as S

START = dt.datetime(2024, 1, 1)
TICK = "symbol string, ts timestamp, event_id bigint, price double, size bigint"
BAR = "symbol string, ts timestamp, high double, low double, close double, volume bigint"


def land(spark, batches, schema, name="landed"):
    """Each batch as one file, in order of time; streams take one file per batch."""
    path = new_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return S.read_ticks(spark, path, schema, files_per_batch=1)


def bars(n=260):
    out = []
    for i in range(n):
        for symbol in ("a", "b"):
            close = 100 + (i * 7 + (3 if symbol == "b" else 0)) % 23 - 11 * (i % 2)
            out.append((symbol, START + dt.timedelta(minutes=30 * i), close + 2.0, close - 1.5, float(close), 1000 + i % 37))
    return out


def test_features_of_every_bar_equal_batch(spark):
    rows = bars()
    stream = land(spark, [rows[:60], rows[60:62], rows[62:300], rows[300:]], BAR)
    got = S.collect_stream(S.stream_features(stream), "features").toPandas()
    assert len(got) == len(rows)
    for n in (1, 2, 6, 30, 50, 51, 120, 200, 201, 260):
        upto = spark.createDataFrame([r for r in rows if r[1] < START + dt.timedelta(minutes=30 * n)], BAR)
        want = realtime_features(upto).toPandas().sort_values("symbol").reset_index(drop=True)
        part = got[got.seen == n].sort_values("symbol").reset_index(drop=True)
        pd.testing.assert_frame_equal(part[list(REALTIME)], want[list(REALTIME)], check_dtype=False)


def test_refresh_reads_stored_history(spark):
    rows = bars(90)
    stream = land(spark, [rows[:100], rows[100:150], rows[150:]], BAR)
    history, features = new_path(spark, "history"), new_path(spark, "features")
    S.append_and_refresh(stream, history, features)
    got = S.newest_per_symbol(spark.read.option("basePath", features).parquet(features), "batch").toPandas().sort_values("symbol").reset_index(drop=True)
    want = realtime_features(spark.createDataFrame(rows, BAR)).toPandas().sort_values("symbol").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(REALTIME)], want[list(REALTIME)], check_dtype=False)
    assert spark.read.parquet(history).count() == 180


def tick(i, minutes, symbol="a", price=10.0):
    return (symbol, START + dt.timedelta(minutes=minutes), i, price, 1)


def test_late_ticks_are_dropped_and_open_windows_wait(spark):
    # Lateness is judged by the watermark of the batch before, hence two batches between.
    first, late = [tick(1, 1, price=5.0), tick(2, 29, price=7.0)], [tick(4, 2, price=99.0), tick(5, 201)]
    batches = [first, [tick(3, 200)], [tick(7, 199)], late, [tick(6, 400)]]
    got = S.collect_stream(S.stream_bars(land(spark, batches, TICK)), "bars").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(5.0, 7.0, 5.0, 7.0, 2), (10.0, 10.0, 10.0, 10.0, 3)]


def test_latest_price_over_batches(spark):
    batches = [[tick(1, 1, price=1.0), tick(2, 2, "b", 2.0)], [tick(3, 5, price=3.0)], [tick(4, 4, price=4.0)]]
    got = {r.symbol: r.price for r in S.latest_price_table(land(spark, batches, TICK)).collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_fresh_price_falls_back_to_the_close(spark):
    latest = spark.createDataFrame([("a", START, 1.0), ("b", START + dt.timedelta(minutes=9), 2.0)], "symbol string, ts timestamp_ntz, price double")
    closes = spark.createDataFrame([("a", 10.0), ("c", 30.0)], "symbol string, close double")
    now = F.lit(START + dt.timedelta(minutes=10)).cast("timestamp_ntz")
    got = {r.symbol: (r.price, r.live) for r in S.fresh_price(latest, closes, now).collect()}
    assert got == {"a": (10.0, False), "b": (2.0, True), "c": (30.0, False)}


def test_doubled_ticks_across_batches(spark):
    batches = [[tick(1, 1), tick(2, 1)], [tick(3, 1), tick(4, 3)]]
    got = S.collect_stream(S.stream_dedupe(land(spark, batches, TICK)), "single")
    assert got.count() == 2


def test_messages_are_typed(spark, tmp_path):
    lines = [
        {"event": "price", "symbol": "A", "price": "10.5", "timestamp": "2024-01-01T00:00:00Z", "event_id": 1},
        {"event": "heartbeat"},
        {"event": "price", "price": "x", "timestamp": "bad"},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    rows = S.collect_stream(S.parse_ticks(S.read_messages(spark, str(tmp_path))), "parsed").orderBy("symbol").collect()
    assert [(r.symbol, r.price, r.ts) for r in rows] == [("", 0.0, None), ("A", 10.5, START)]
    assert S.valid_tick(spark.createDataFrame([("A", 0.0), ("A", 1.0)], "symbol string, price double")).count() == 1


def test_handlers_fail_alone_and_get_their_batches_again(spark):
    seen, again, failed = [], [], new_path(spark, "failed")

    def broken(batch, number):
        raise KeyError("x")

    S.fan_out(land(spark, [[tick(1, 1)], [tick(2, 2)]], TICK), {"bad": broken, "good": lambda b, n: seen.append(b.count())}, failed)
    noted = S.failed_rows(spark, failed, TICK).orderBy("batch").collect()
    assert seen == [1, 1] and [(r.handler, r.error, r.batch, r.event_id) for r in noted] == [("bad", "KeyError", 0, 1), ("bad", "KeyError", 1, 2)]
    S.replay(spark, failed, TICK, "bad", lambda b, n: again.append((n, b.first().event_id)))
    assert again == [(0, 1), (1, 2)] and S.failed_rows(spark, new_path(spark, "none"), TICK).count() == 0


def test_a_batch_that_is_run_twice_counts_once(spark, monkeypatch):
    """Each batch's handler runs twice, as after a lost driver."""
    monkeypatch.setattr(S, "each_batch", lambda df, handle, name, mode="append", run=S.each_batch: run(df, lambda b, n: (handle(b, n), handle(b, n)), name, mode))
    rows = bars(90)
    history, features = new_path(spark, "history"), new_path(spark, "features")
    S.append_and_refresh(land(spark, [rows[:100], rows[100:150], rows[150:]], BAR), history, features)
    assert spark.read.parquet(history).count() == 180
    got = S.newest_per_symbol(spark.read.option("basePath", features).parquet(features), "batch").toPandas().sort_values("symbol").reset_index(drop=True)
    want = realtime_features(spark.createDataFrame(rows, BAR)).toPandas().sort_values("symbol").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(REALTIME)], want[list(REALTIME)], check_dtype=False)
    batches = [[tick(1, 1, price=1.0), tick(2, 2, "b", 2.0)], [tick(3, 5, price=3.0)], [tick(4, 4, price=4.0)]]
    assert {r.symbol: r.price for r in S.latest_price_table(land(spark, batches, TICK)).collect()} == {"a": 3.0, "b": 2.0}


def test_late_bars_do_not_change_features(spark):
    rows = bars(40)
    late = [("a", START, 1.0, 1.0, 1.0, 1), rows[20]]
    stream = land(spark, [rows[:60], late + rows[60:]], BAR)
    got = S.collect_stream(S.stream_features(stream), "features")
    assert got.count() == len(rows)


def test_spikes_by_the_hours_so_far(spark):
    hours = [(START + dt.timedelta(hours=h), n) for h, n in enumerate([2, 0, 2, 9, 3, 40, 1])]
    logs = [[(t + dt.timedelta(minutes=i), "ERROR", 0.1) for i in range(n)] + [(t, "INFO", 0.1)] for t, n in hours]
    path = new_path(spark, "spikes")
    logs.append([(START + dt.timedelta(hours=30), "INFO", 0.1)])
    S.stream_spikes(S.stream_log_hours(land(spark, logs, "timestamp timestamp, level string, execution_time double")), path)
    got = sorted((r.n_errors, round(r.mean_errors, 6)) for r in spark.read.parquet(f"{path}/alerts").collect())
    assert got == [(9, round(13 / 3, 6)), (40, round(56 / 5, 6))]


def slow_logs(spark, name="slow"):
    """Three batches; 9.0 stands out in the second, 9.5 no longer in the third; null and infinite times count nowhere."""
    at = [START + dt.timedelta(minutes=m) for m in range(80)]
    first = [(at[m], "f", 1.0 + m % 3 / 10) for m in range(30)] + [(at[30], "g", None), (at[31], None, 5.0)]
    second = [(at[32], "f", 9.0), (at[33], "f", float("inf")), (at[34], "g", 2.0), (at[35], None, 5.0)]
    third = [(at[m], "f", 9.5) for m in range(40, 60)] + [(at[61], None, 5.5)]
    return [first, second, third], "timestamp timestamp, function string, execution_time double"


@pytest.mark.parametrize("keys", [[], ["function"]])
@pytest.mark.parametrize("twice", [False, True])
def test_slow_operations_by_the_moments_so_far(spark, monkeypatch, keys, twice):
    if twice:  # each batch's handler runs again, as after a lost driver
        monkeypatch.setattr(S, "each_batch", lambda df, handle, name, mode="append", run=S.each_batch: run(df, lambda b, n: (handle(b, n), handle(b, n)), name, mode))
    batches, schema = slow_logs(spark)
    path = new_path(spark, "slow-anomalies")
    S.stream_slow_anomalies(land(spark, batches, schema), path, keys=keys, deviations=2.0)
    got = sorted((r.timestamp, r.execution_time, round(r.threshold, 9)) for r in spark.read.parquet(f"{path}/alerts").collect())
    want, seen = [], []
    for rows in batches:
        seen += rows
        for stamp, function, value in rows:
            times = np.array([t for _, f, t in seen if t is not None and np.isfinite(t) and (not keys or f == function)], float)
            limit = times.mean() + 2 * times.std() if len(times) >= 2 else np.inf
            if value is not None and np.isfinite(value) and value > limit:
                want.append((stamp, value, round(limit, 9)))
    assert got == sorted(want) and 0 < len(got) < 10


def test_moments_far_from_zero(spark):
    """Merged deviations keep their digits (means keep nine here) where sums of squares would lose them all."""
    values = [[1e9 + i % 7 for i in range(100)], [1e9 + 100.0] * 3 + [1e9 + i % 5 for i in range(50)], [1e9 + 60]]
    batches = [[(START + dt.timedelta(seconds=100 * n + i), "f", v) for i, v in enumerate(part)] for n, part in enumerate(values)]
    path = new_path(spark, "far")
    S.stream_slow_anomalies(land(spark, batches, "timestamp timestamp, function string, execution_time double"), path)
    last = spark.read.parquet(S.batch_folder(f"{path}/moments", 2)).first().moments
    whole = np.concatenate(values)
    assert last.n == len(whole) and abs(last.m2 / (whole.var() * len(whole)) - 1) < 1e-7 and abs(last.mean - whole.mean()) < 1e-5


def test_batches_read_only_the_one_before(spark):
    """Of what batches hand on, the last two stay, however many there were."""
    batches = [[tick(n, n, price=float(n), symbol="ab"[n % 2])] for n in range(1, 7)]
    closes = spark.createDataFrame([("a", 1.5), ("c", 2.5)], "symbol string, close double")
    path = new_path(spark, "fresh")
    S.stream_fresh_price(land(spark, batches, TICK), closes, path)
    folders = sorted(f.name for f in pathlib.Path(f"{path}/latest").iterdir() if f.is_dir())
    assert folders == ["batch=4", "batch=5"]
    last = {r.symbol: (r.price, r.live) for r in spark.read.parquet(S.batch_folder(f"{path}/prices", 5)).collect()}
    assert last == {"a": (6.0, True), "b": (5.0, True), "c": (2.5, False)}


@pytest.mark.parametrize("layout", ["lines", "pretty"])
def test_log_files_of_both_layouts(spark, tmp_path, layout):
    from tidemark.sources.logs import read_json_logs

    records = [
        {"timestamp": "2024-01-01T00:00:00+02:00", "level": "ERROR", "message": "a } b {", "exception": {"type": "E", "message": "m", "traceback": ["x", "}"]}},
        {"message": "bare", "custom": {"execution_time": 0.25, "trade": {"action": "BUY", "quantity": 2, "price": 3.5}}},
    ]
    text = "\n".join(json.dumps(r, indent=2 if layout == "pretty" else None) for r in records) + "\n"
    (tmp_path / "app.log").write_text(text)
    (tmp_path / "app_error.log").write_text(text)
    (tmp_path / "notes.txt").write_text(text)
    df = read_json_logs(spark, str(tmp_path), layout).orderBy("message")
    a, b = df.collect()
    assert (a.level, a.timestamp, a.exception.traceback) == ("ERROR", dt.datetime(2023, 12, 31, 22), ["x", "}"])
    assert (b.level, b.logger, b.line, b.execution_time, b.timestamp) == ("UNKNOWN", "UNKNOWN", 0, 0.25, None)
    from tidemark.sources.logs import extract_context

    assert [r.value for r in extract_context(df, "trade").collect()] == [7.0]
