"""Silences over batches against a loop over all ticks."""

import datetime as dt
import random

from tests.test_streams import START, TICK, land, tick
from tidemark.streaming import ticks as S
from tidemark.streaming.silence import keyed_state, stream_fallbacks, stream_silences


def brute(rows, age, delay):
    """(symbol, since, ts, price) of all ticks followed by none within ``age``, up to the last watermark."""
    end = max(r[1] for r in rows) - dt.timedelta(seconds=delay)
    out = []
    for symbol in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == symbol)
        for a, b in zip(own, [*own[1:], None]):
            old = a[0] + dt.timedelta(seconds=age)
            if old < end and (b is None or b[0] > old):
                out.append((symbol, a[0], old, a[2]))
    return sorted(out)


def test_silences_of_unordered_batches_equal_a_loop(spark):
    r = random.Random(4)
    rows = [tick(i, at, r.choice("ab"), float(i)) for i, at in enumerate(sorted(r.choices(range(0, 2000, 3), k=160)))]
    rows += [tick(900, 40, "quiet", 1.0), tick(901, 40, "quiet", 2.0), tick(902, 2100, "late", 3.0)]
    # Batches overlap by less than the delay; some stamps repeat within and between batches.
    batches = [[] for _ in range(5)]
    for row in rows:
        minutes = (row[1] - START).total_seconds() / 60
        batches[min(4, int((minutes + r.uniform(0, 25)) // 420))].append(row)
    with keyed_state(spark):
        got = S.collect_stream(stream_silences(land(spark, batches, TICK), 600.0, "30 minutes"), "silences").collect()
    want = brute(rows, 600, 1800)
    assert sorted(tuple(x) for x in got) == want
    assert [x[3] for x in want if x[0] == "quiet"] == [2.0] and not [x for x in want if x[0] == "late"]


def test_fallbacks_take_the_close_or_null(spark):
    rows = [[tick(1, 1, price=5.0), tick(2, 2, "b", 6.0), (None, START, 3, 1.0, 1), ("a", None, 4, 1.0, 1)], [tick(6, 5, "c", None), tick(5, 300)]]
    closes = spark.createDataFrame([("a", 4.5), ("c", 1.0)], "symbol string, close double")
    with keyed_state(spark):
        got = S.collect_stream(stream_fallbacks(land(spark, rows, TICK), closes, 300.0, "1 hour"), "fallbacks").collect()
    assert sorted((x.symbol, x.last_price, x.price) for x in got) == [("a", 5.0, 4.5), ("b", 6.0, None), ("c", None, 1.0)]
    assert {x.ts for x in got} == {START + dt.timedelta(minutes=m) for m in (6, 7, 10)}
