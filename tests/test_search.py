"""Guided search: what is drawn, what is given up, and that scores are those of the written predictions."""

import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import training as T


def test_sampler_goes_where_scores_are_good():
    """A peak in two numbers and a choice: later draws lie nearer to it than the first ones."""
    space = {"a": (0.0, 1.0), "n": (1, 50), "kind": ["x", "y", "z"]}
    value = lambda p: -((p["a"] - 0.3) ** 2) - ((p["n"] - 40) / 50) ** 2 + 0.2 * (p["kind"] == "y")
    gains = []
    for seed in range(10):
        sampler, trials = T.ParzenSampler(space, seed, startup=10), []
        for i in range(60):
            point = sampler.suggest(trials)
            assert 0 <= point["a"] <= 1 and 1 <= point["n"] <= 50 and isinstance(point["n"], int) and point["kind"] in space["kind"]
            trials.append(T.Trial(i, point, [value(point)]))
        gains.append(statistics.mean(t.mean for t in trials[-20:]) - statistics.mean(t.mean for t in trials[:10]))
        again = T.ParzenSampler(space, seed, startup=10)
        assert [again.suggest(trials[:i]) for i in range(60)] == [t.params for t in trials]
    assert min(gains) > 0 and statistics.mean(gains) > 0.15


def test_scores_are_those_of_written_predictions(spark, tmp_path):
    r = random.Random(1)
    rows = [(s, t, float(x := r.gauss(0, 1)), float(r.gauss(0, 1)), int(x + r.gauss(0, 0.5) > 0)) for s in "ab" for t in range(120)]
    df = spark.createDataFrame(rows, "symbol string, t int, x double, z double, label int")
    df = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, t, 0, 0)"))
    path = str(tmp_path / "trials")
    space = {"trees": (1, 5), "depth": (1, 3), "maxBins": [4, 16]}
    found = T.guided_search(df, ["x", "z"], "label", "random_forest", space, trials=6, folds=2, parallel=3, startup=3, path=path)
    assert len(found) == 6 and {t.number for t in found} == set(range(6))
    assert [t.mean for t in found if not t.pruned] == sorted((t.mean for t in found if not t.pruned), reverse=True)
    sql = f"""WITH p AS (SELECT trial, part, label, y_pred FROM read_parquet('{path}/*/*/*.parquet', hive_partitioning = true)),
      c AS (SELECT trial, part, k, count(*) FILTER (label = k) AS support, 2 * count(*) FILTER (label = k AND y_pred = k)
              / nullif(count(*) FILTER (label = k) + count(*) FILTER (y_pred = k), 0) AS f1 FROM p, (SELECT DISTINCT label AS k FROM p) GROUP BY 1, 2, 3)
      SELECT trial, part, sum(coalesce(f1, 0) * support) / sum(support) FROM c GROUP BY 1, 2 ORDER BY 1, 2"""
    want = {}
    for trial, _, f1 in duckdb.connect().execute(sql).fetchall():
        want.setdefault(trial, []).append(f1)
    assert {t.number: pytest.approx(t.scores) for t in found} == want
    # A trial of a later batch is given up exactly if it is below the median of the earlier batches.
    for t in found:
        earlier = [o for o in found if o.number // 3 < t.number // 3]
        before = [o.scores[0] for o in earlier]
        assert t.pruned == bool(before and t.scores[0] < statistics.median(before)) and len(t.scores) == (1 if t.pruned else 2)


def test_grid_search_runs_side_by_side(spark):
    rows = [("a", i, float(i % 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, t int, x double, label int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, t, 0, 0)"))
    one = T.search(df, ["x"], "label", "random_forest", {"trees": [1, 3], "depth": [1, 2]}, trials=4, folds=2, parallel=1)
    assert one == T.search(df, ["x"], "label", "random_forest", {"trees": [1, 3], "depth": [1, 2]}, trials=4, folds=2, parallel=4)
