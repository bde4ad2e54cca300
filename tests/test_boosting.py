"""Softmax boosting against a row loop, and what stops it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, training


def table(seed, n=400, columns=4, classes=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, columns)), 2)
    y = ((x[:, 0] > 0).astype(int) + ((x[:, 1] * x[:, 0] > 0.2) | (rng.random(n) < 0.1)).astype(int)) % classes
    w = rng.choice([0.5, 1.0, 2.0], n)
    return x, y, w


def frame(spark, x, y, w, held):
    rows = [(*map(float, r), int(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, held)]
    return spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", y int, w double, held boolean")


def brute(x, y, w, cuts, rounds, depth, step, l1, l2, least_rows):
    """Margins of trees grown row by row."""
    k = len(set(y))
    margin = np.zeros((len(x), k))

    def share(g, h):
        return max(abs(g) - l1, 0) ** 2 / (h + l2)

    def grow(rows, g, h, level, out):
        best = None
        if level < depth:
            for j, qs in enumerate(cuts):
                for q in qs:
                    left = rows[x[rows, j] <= q]
                    right = rows[x[rows, j] > q]
                    if min(len(left), len(right)) < least_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = round((share(g[left].sum(), h[left].sum()) + share(g[right].sum(), h[right].sum()) - share(g[rows].sum(), h[rows].sum())) / 2, 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, left, right)
        if best is None:
            total = g[rows].sum()
            out[rows] = -np.sign(total) * max(abs(total) - l1, 0) / (h[rows].sum() + l2)
            return
        grow(best[1], g, h, level + 1, out)
        grow(best[2], g, h, level + 1, out)

    for _ in range(rounds):
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        new = np.zeros_like(margin)
        for c in range(k):
            grow(np.arange(len(x)), w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c]), 0, new[:, c])
        margin += step * new
    return margin


@pytest.mark.parametrize(("seed", "depth", "l1", "least_rows", "renew"), [(1, 3, 0.0, 1, 8), (2, 2, 0.7, 20, 2)])
def test_margins(spark, monkeypatch, seed, depth, l1, least_rows, renew):
    monkeypatch.setattr(boosting, "RENEW", renew)
    x, y, w = table(seed)
    df = frame(spark, x, y, w, np.zeros(len(x), bool)).repartition(3)
    cols = [f"x{j}" for j in range(x.shape[1])]
    model = boosting.fit(df, cols, "y", "w", rounds=5, depth=depth, step=0.3, bins=16, l1=l1, l2=0.5, least_rows=least_rows)
    want = brute(x, y, w, model.cuts, 5, depth, 0.3, l1, 0.5, least_rows)
    assert np.allclose(model.margins(model.bins(x)), want, atol=1e-9)
    losses = [v["learned"] for v in model.losses]
    assert len(losses) == 6 and all(a > b for a, b in zip(losses, losses[1:]))
    p = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
    assert losses[-1] == pytest.approx(-(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum())


def test_stops_by_the_held_rows(spark, tmp_path):
    """Labels that are noise: the loss on held rows soon rises, and the model keeps the rounds before."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 3, 300)
    df = frame(spark, x, y, np.ones(300), np.arange(300) % 3 == 0)
    cols = ["x0", "x1", "x2"]
    model = boosting.fit(df, cols, "y", "w", F.col("held"), rounds=30, depth=3, step=0.5, patience=3)
    held = [v["held"] for v in model.losses]
    assert len(model.trees) == int(np.argmin(held)) and len(held) <= len(model.trees) + 4 < 30
    training.save_model(model, str(tmp_path / "m"))
    again = training.load_model(str(tmp_path / "m"), "boosted")
    assert np.array_equal(again.margins(again.bins(x)), model.margins(model.bins(x)))


def test_nulls_one_class_and_names(spark):
    df = spark.createDataFrame([(1.0, 7, 1), (2.0, 7, 2), (None, 7, 3), (float("nan"), 7, 4), (3.0, None, 5)], "x double, y int, probs int")
    model = training.train(df, ["x"], "y", "boosted", rounds=2)
    got = training.score(df.drop("probs"), model).collect()
    assert [(r.y_pred, r.confidence) for r in got] == [(7, 1.0), (7, 1.0), (None, None), (None, None), (7, 1.0)]
    assert boosting.fit(df.limit(0), ["x"], "y").trees == []


def test_learns(spark):
    x, y, w = table(5, 1500)
    df = frame(spark, x, y, w, np.arange(1500) % 5 == 0)
    cols = [f"x{j}" for j in range(4)]
    model = training.train(df, cols, "y", "boosted", validation=F.col("held"), rounds=25, step=0.3)
    scored = training.score(df.filter("held"), model)
    assert scored.filter("y = y_pred").count() / scored.count() > 0.8
