"""Windows cut from block arrays against windows cut by hand, wherever blocks end."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import sampling as P
from tidemark.plans.series import BARS

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def closes(spark):
    """Two series over several blocks, one with null features, and one too short for any window."""
    rows = [("a", i, 100.0 + (i * i) % 17, None if i % 11 == 0 else i) for i in range(700)]
    rows += [("b", i, 50.0 + i % 2 / 1000, i) for i in range(260)] + [("c", i, 1.0, i) for i in range(20)]
    rows = [(s, START + timedelta(minutes=30 * i), c, v, i % 3) for s, i, c, v in rows]
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume bigint, market_state int")


def by_key(df):
    return {(r.symbol, r.ts): (r.label, r.size, [tuple(v) for v in r.window]) for r in df.collect()}


@pytest.mark.parametrize("block", [130, 2048])
@pytest.mark.parametrize("stride", [1, 7])
def test_sequences_hold_the_rows_before(closes, block, stride):
    rows, df = closes
    got = by_key(P.sequences(df, ["close", "volume"], stride=stride, axis=BARS.with_(block=block)))
    series = {s: [r for r in rows if r[0] == s] for s in "abc"}
    wanted = {(s, part[i][1]) for s, part in series.items() for i in range(60, len(part) - 1) if (i - 60) % stride == 0}
    assert set(got) == wanted
    for (s, ts), (label, size, window) in got.items():
        part = series[s]
        i = int((ts - START).total_seconds() // 1800)
        assert label == part[i][4] and 30 <= size <= min(120, i)
        assert window == [(r[2], None if r[3] is None else float(r[3])) for r in part[i - size : i]]
    assert len({size for _, size, _ in got.values()}) > 1


@pytest.mark.parametrize("block", [130, 2048])
def test_next_sequences_skip_a_row(closes, block):
    rows, df = closes
    got = by_key(P.sequences_next(df, ["close"], axis=BARS.with_(block=block)))
    series = {s: [r for r in rows if r[0] == s] for s in "abc"}
    assert set(got) == {(s, part[i][1]) for s, part in series.items() for i in range(61, len(part))}
    for (s, ts), (label, size, window) in got.items():
        i = int((ts - START).total_seconds() // 1800)
        assert label == series[s][i][4] and 30 <= size <= 60
        assert window == [(r[2],) for r in series[s][i - 1 - size : i - 1]]
