import numpy as np
import pandas as pd
import pytest

from tidemark.plans.quantiles import exact_quantiles, quantile_columns, value_ranks

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_exact_for_any_sketch_accuracy(spark, accuracy):
    rng = np.random.default_rng(3)
    heavy = np.where(rng.random(4000) < 0.4, 7.0, np.round(rng.lognormal(3, 2, 4000), 3))
    data = pd.DataFrame({"symbol": np.where(rng.random(4000) < 0.7, "hot", "cold"), "x": heavy, "y": rng.normal(size=4000)})
    data.loc[::17, "y"] = None
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "symbol string, x double, y double")
    got = exact_quantiles(df, ["x", "y"], PROBS, accuracy=accuracy).toPandas()
    want = data.groupby("symbol")[["x", "y"]].quantile(PROBS)
    assert len(got) == 4
    for row in got.itertuples():
        np.testing.assert_allclose(row.q, want.loc[row.symbol][row.column].to_numpy(float), rtol=1e-12)
        assert row.n == data[data.symbol == row.symbol][row.column].notna().sum()


def test_named_columns_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "symbol string, x double")
    got = {r.symbol: (r.m, r.q) for r in quantile_columns(df, {"m": ("x", 0.5), "q": ("x", 0.25)}).collect()}
    assert got == {"a": (1.0, 1.0), "b": (2.0, 1.5)}


def test_a_rank_outside_its_bracket_ends_the_job(spark):
    df = spark.range(4000).selectExpr("'a' AS symbol", "double(id) AS x")
    whole = exact_quantiles(df, ["x"], [0.3, 0.61], accuracy=20).first()
    np.testing.assert_allclose(whole.q, [0.3 * 3999, 0.61 * 3999], rtol=1e-12)
    with pytest.raises(Exception, match="outside its bracket"):
        exact_quantiles(df, ["x"], [0.3, 0.61], accuracy=20, margin=0.0).collect()


def test_value_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0, None]], "x double")
    got = sorted((r.x, r.c, r.below, r.n) for r in value_ranks(df, "x").collect())
    assert got == [(1.0, 1, 0, 5), (2.0, 1, 1, 5), (3.0, 3, 2, 5)]
