"""Sketches whose merges give another answer each time they are computed: results must not depend on it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators import training as T
from tidemark.plans import parts, quantiles
from tidemark.plans.series import Axis, Halo, row_count, running

N = 6000


def shaken(sketch, by):
    """The sketch's values, moved by up to ``by`` whenever they are computed."""
    anew = F.reflect(F.lit("java.lang.Math"), F.lit("random")).cast("double")
    return F.array_sort(F.transform(sketch, lambda v: v + (anew - 0.5) * 2 * by))


@pytest.fixture
def quantiles_shaken(monkeypatch):
    """Sketches of 1,000 ranks' accuracy over the values 0 to N; they may err by a rank in 1,000."""
    by, _, margin = quantiles.exact_quantiles.__defaults__
    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (by, 1000, margin))
    sketch = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, ps, accuracy: shaken(sketch(c, ps, accuracy), N / 1000))


@pytest.fixture
def parts_shaken(spark, monkeypatch):
    """Joins by shuffles, as cuts of many series need; a broadcast would be shared by all that read the parts."""
    plain, limit = F.expr, "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(parts.F, "expr", lambda text: shaken(plain(text), N / 500) if text.startswith("percentile_approx") else plain(text))
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    yield
    spark.conf.set(limit, before)


def values(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.permutation(N).astype(float)
    data = pd.DataFrame({"x": x, "z": rng.permutation(N).astype(float), "y": (x > N / 3).astype(int) + (rng.random(N) < 0.2)})
    return data, spark.createDataFrame(data, "x double, z double, y int").repartition(4)


def test_cuts_of_boosting(spark, quantiles_shaken):
    data, df = values(spark, 1)
    cuts = boosting.column_cuts(df, ["x", "z"], 8)
    assert cuts == [pytest.approx([(N - 1) * i / 8 for i in range(1, 8)])] * 2
    model = boosting.fit(df, ["x", "z"], "y", rounds=1, depth=1, bins=8)
    assert model.cuts == cuts and len(model.trees) == 1


def test_information_from_bins(spark, quantiles_shaken):
    data, df = values(spark, 2)
    want = {}
    for c in ("x", "z"):
        n = pd.crosstab(np.searchsorted(data[c].quantile([i / 10 for i in range(1, 10)]), data[c]), data.y).to_numpy() / N
        with np.errstate(divide="ignore", invalid="ignore"):
            want[c] = np.nansum(n * np.log(n / n.sum(0) / n.sum(1, keepdims=True)))
    got = {r["feature"]: r["mutual_info"] for r in T.mutual_info_scores(df, ["x", "z"], "y").collect()}
    assert got == {c: pytest.approx(v, abs=1e-9) for c, v in want.items()}


def test_quantiles_in_any_order_of_shares(spark):
    df = spark.range(3000).selectExpr("'a' AS symbol", "double(id) AS x")
    got = quantiles.exact_quantiles(df, ["x"], [0.9, 0.1, 0.1, 0.11], accuracy=100).first()
    np.testing.assert_allclose(got.q, [0.9 * 2999, 0.1 * 2999, 0.1 * 2999, 0.11 * 2999])


def test_positions_and_frames(spark, parts_shaken):
    data, df = values(spark, 3)
    axis = Axis(keys=("y",), ts="x", cell=None, whole=100)
    want = data.assign(rn=data.groupby("y").x.rank().astype(int), before=data.sort_values("x").groupby("y").x.shift(1)).sort_values(["x"])
    placed = running(df, axis, rn=row_count()).toPandas().sort_values("x")
    assert placed.x.tolist() == want.x.tolist() and placed.rn.tolist() == want.rn.tolist()
    h = Halo.spread(df, axis, back=1, block=64)
    frame = h.settle(h.frame.withColumn("before", F.lag("x").over(h.w))).toPandas().sort_values("x")
    assert frame.x.tolist() == want.x.tolist()
    np.testing.assert_array_equal(frame.before.to_numpy(float), want.before.to_numpy(float))


def test_information_from_neighbours(spark, parts_shaken, monkeypatch):
    """Radii and counts of series that are cut."""
    _, df = values(spark, 4)
    whole = T.mutual_info_neighbours(df, ["x", "z"], "y").collect()
    monkeypatch.setattr(T, "Axis", lambda **kw: Axis(**kw, whole=100))
    cut = T.mutual_info_neighbours(df, ["x", "z"], "y").collect()
    assert sorted(cut) == [(c, pytest.approx(v, abs=1e-9)) for c, v in sorted(whole)] and len(cut) == 2


def test_sketches_stay_with_their_task(spark, monkeypatch):
    """Merged sketches keep nearly all their samples, so memory and time of a merge would grow with the number of tasks."""
    sketch = F.percentile_approx

    def of_one_task(c, ps, accuracy):
        near = F.max(c) - F.min(c) < 1000
        return F.when(near, sketch(c, ps, accuracy)).otherwise(F.raise_error("a sketch of several tasks"))

    monkeypatch.setattr(quantiles.F, "percentile_approx", of_one_task)
    df = spark.range(0, 12_000, 1, 12).selectExpr("'a' AS symbol", "double(id) AS x", "double(id div 5) AS z")
    got = {r["column"]: r.q for r in quantiles.exact_quantiles(df, ["x", "z"], [0.0, 0.25, 0.5, 1.0], accuracy=100).collect()}
    np.testing.assert_allclose(got["x"], [0, 0.25 * 11_999, 0.5 * 11_999, 11_999])
    np.testing.assert_allclose(got["z"], np.quantile(np.arange(12_000) // 5, [0.0, 0.25, 0.5, 1.0]))
