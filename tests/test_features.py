"""Feature selection, splits, scaling and evaluation on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import features as S
from tidemark.operators import indicators as X
from tidemark.operators import quality as Q
from tidemark.operators import sampling as P
from tidemark.operators import training as T

START = dt.datetime(2024, 1, 1)


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    close = 50 + rng.normal(0, 0.4, n).cumsum()
    signal = np.r_[np.diff(close), 0.0]
    rows = [
        ("a", START + dt.timedelta(minutes=30 * i), float(close[i]), float(signal[i]), float(rng.normal()), int(signal[i] > 0) + int(signal[i] > 0.3))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, good double, noise double, label int")


def test_protected_columns():
    assert S.protect(["close", "closeness", "poly_close", "market_state", "rsi"]) == ["close", "market_state"]


def test_interactions_of_eight_columns():
    names = S.interaction_names(X.BASE_FEATURES)
    assert len(names) == len(set(names)) == 36 and "poly_rsi_atr" in names


def test_lasso_keeps_what_explains_the_next_change(spark):
    chosen = S.lasso_select(table(spark), ["good", "noise"], penalty=0.02)
    assert chosen[0] == "good" and "noise" not in chosen


def test_selectors_prefer_the_informative_column(spark):
    df = table(spark)
    for pick in (T.select_anova, T.select_mutual_info):
        assert pick(df, ["noise", "good"], "label", 1) == ["good"]
    assert T.select_importance(df, ["noise", "good"], "label", 1, trees=5) == ["good"]
    assert T.select_auto(df, ["noise", "good"], "label", 2, trees=5)[0] == "good"


def test_forward_folds_and_split(spark):
    rows = P.walk_forward_folds(table(spark, 23), 3).orderBy("ts").toPandas()
    assert rows.fold.tolist() == [0] * 8 + [1] * 5 + [2] * 5 + [3] * 5
    split = P.time_split(table(spark, 23)).orderBy("ts").toPandas().split.tolist()
    assert split == ["train"] * 16 + ["val"] * 2 + ["test"] * 5
    assert P.walk_forward_folds(table(spark, 2), 3).toPandas().fold.tolist() == [0, 0]


@pytest.mark.parametrize("method", ["robust", "standard", "minmax"])
def test_scaling_a_constant_column(spark, method):
    df = table(spark, 20).withColumn("flat", F.lit(3.0))
    out = P.apply_scaler(df, P.fit_scaler(df, ["flat"], method), ["flat"]).toPandas()
    assert (out.flat == 0).all()


def test_window_sizes(spark):
    df = spark.createDataFrame([(0.04, 0.5), (0.02, 0.5), (0.01, 0.5), (0.0, 0.5), (0.01, 5.0), (0.9, 0.0)], "v double, t double")
    got = [r[0] for r in df.select(P.dynamic_window_size(F.col("v"), F.col("t"))).collect()]
    assert got == [42, 51, 72, 60, 120, 33]


def test_sequences_look_back_only(spark):
    df = table(spark, 200).withColumn("market_state", F.lit(1))
    rows = P.sequences(df, ["close"], stride=7).toPandas()
    closes = table(spark, 200).toPandas().sort_values("ts").close.tolist()
    for row in rows.itertuples():
        i = int((row.ts - START).total_seconds() // 1800)
        assert (i - 60) % 7 == 0 and [s[0] for s in row.window] == closes[i - row.size : i]


def test_scores(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.4), (1, 1, 0.4), (1, 1, 0.1)], "y_true int, y_pred int, p0 double")
    row = V.evaluate(df).first()
    assert row.accuracy == 0.75 and row.precision == pytest.approx((1 + 2 / 3) / 2)
    assert V.neutral_f1(df).first()[0] == pytest.approx(0.8)
    area = {r.label: r.auc for r in V.auc_by_class(df, ["p0"]).collect()}
    assert area[0] == pytest.approx(0.875)


def test_model_learns_and_scores_add_up(spark):
    df = table(spark, 600)
    model = T.train(df, ["good", "noise"], "label", trees=10)
    out = T.score(df, model).toPandas()
    assert (out.y_pred == out.label).mean() > 0.9
    np.testing.assert_allclose([sum(p) for p in out.probs], 1.0, atol=1e-9)
    mean = T.ensemble_mean(df, [model, model]).toPandas()
    pd.testing.assert_series_equal(mean.sort_values("ts").confidence, out.sort_values("ts").confidence, check_index=False)


def test_gate_orders_severities(spark):
    report = spark.createDataFrame([("a", "healthy"), ("b", "warning"), ("c", "critical"), ("d", "failed")], "symbol string, status string")
    assert [r.symbol for r in Q.gate_status(report).filter("passed").orderBy("symbol").collect()] == ["a", "b"]
    flow = report.withColumnRenamed("status", "final_status")
    assert sorted(r.symbol for r in Q.failing_symbols(flow, "critical").collect()) == ["d"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lasso_fulfils_its_conditions(seed):
    """Slopes equal the penalty where a coefficient is, and stay below it elsewhere; near-copies of columns included."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 12)) * 10.0 ** rng.integers(-3, 4, 12)
    x[:, 5] = x[:, 4] * 2 + rng.normal(size=300) * x[:, 4].std() * 1e-3
    x[:, 6] = 0
    y = x[:, 0] / x[:, 0].std() - x[:, 4] / x[:, 4].std() + rng.normal(size=300)
    g = np.cov(np.column_stack([x, y]).T, bias=True)
    for share in (0.001, 0.1, 0.5):
        penalty = share * np.abs(g[:-1, -1]).max()
        b = S.lasso(g[:-1, :-1], g[:-1, -1], penalty)
        slope = (g[:-1, -1] - g[:-1, :-1] @ b)
        off = np.where(b != 0, np.abs(slope - penalty * np.sign(b)), np.maximum(np.abs(slope) - penalty, 0))
        assert (off / np.maximum(x.std(axis=0), 1e-9) < 1e-7).all() and b[6] == 0


def test_covariances(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) + 1e6
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    n, means, matrix = S.covariances(spark.createDataFrame(rows, "a double, b double, c double").repartition(3), ["a", "b", "c"])
    assert n == 200 and np.allclose(means, x.mean(axis=0)) and np.allclose(matrix, np.cov(x.T, bias=True), atol=1e-9)
    assert S.covariances(spark.createDataFrame([], "a double"), ["a"])[0] == 0


def test_exponent_beyond_the_grid(spark):
    """The most likely exponent lies at six, outside the first grid; the likelihood falls on both sides of what is found."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=3000) * 60 + 600
    df = spark.createDataFrame([(float(v),) for v in (6 * z + 1) ** (1 / 6) - 1], "x double").cache()
    found = P.fit_power_closely(df, "x").first()["lam"]
    assert 4.5 < found < 7.5
    fits = [r["fit"] for r in P._power_points(df, "x", [found - 1e-4, found, found + 1e-4]).orderBy("lam").collect()]
    assert fits[1] >= max(fits)
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert P.power_transform(one, "x", "s", P.fit_power_closely(one, "x")).filter("s is not null").count() in (0, 2)
    df.unpersist()


def brute_information(x, y, k=3):
    """The estimate by all distances."""
    digamma = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    kept = [i for i in range(len(x)) if x[i] is not None and not np.isnan(x[i]) and y[i] is not None]
    size = {c: sum(y[i] == c for i in kept) for c in {y[i] for i in kept}}
    kept = [i for i in kept if size[y[i]] > 1]
    parts = []
    for i in kept:
        n = min(k, size[y[i]] - 1)
        r = sorted(abs(x[i] - x[j]) for j in kept if j != i and y[j] == y[i])[n - 1]
        m = sum(x[i] - r < x[j] < x[i] + r or (r == 0 and x[j] == x[i]) for j in kept)
        parts.append(digamma(n) - digamma(size[y[i]]) - digamma(m))
    return max(digamma(len(kept)) + float(np.mean(parts)), 0.0)


def test_information_from_neighbours(spark):
    """Ties, small classes, a class of one, nulls; what tells the class more has more."""
    rng = np.random.default_rng(6)
    y = [int(c) for c in rng.integers(0, 3, 150)] + [7, 8, 8, None]
    good = [float(v) if v is not None else None for v in [*(np.array(y[:150]) + rng.normal(size=150) * 0.3), 1.0, 2.0, 2.0, 0.5]]
    ties = [float(v) for v in rng.integers(0, 4, 154)]
    holes = [None if i % 9 == 0 else float("nan") if i % 10 == 0 else float(v) for i, v in enumerate(rng.normal(size=154))]
    df = spark.createDataFrame(list(zip(good, ties, holes, y)), "good double, ties double, holes double, y int").repartition(3)
    got = {r["feature"]: r["mutual_info"] for r in T.mutual_info_neighbours(df, ["good", "ties", "holes"], "y").collect()}
    assert got == {n: pytest.approx(brute_information(v, y), abs=1e-8) for n, v in (("good", good), ("ties", ties), ("holes", holes))}
    assert T.select_mutual_info(df, ["ties", "holes", "good"], "y", 1, bins=None) == ["good"]
