import numpy as np
import pandas as pd

from tidemark.operators.sampling import knn_impute, smote
from tidemark.plans.neighbours import _cells, nearest


def points(n=300, seed=5):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(np.round(rng.normal(size=(n, 3)), 3), columns=list("xyz"))
    data["symbol"] = np.where(rng.random(n) < 0.8, "hot", "cold")
    data["id"] = np.arange(n)
    return data


def distance(q, b):
    known = ~np.isnan(q)
    return np.sqrt(((q[known] - b[:, known]) ** 2).sum(axis=1) * len(q) / known.sum())


def test_nearest_equals_brute_force(spark):
    data = points()
    data.loc[::7, "x"] = np.nan
    data.loc[::21, "y"] = np.nan
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "x double, y double, z double, symbol string, id bigint")
    got = nearest(df, df, ["x", "y", "z"], 4, ["symbol"], "id").toPandas()
    assert len(got) == 4 * len(data)
    for (symbol, q), part in got.groupby(["symbol", "q_id"]):
        base = data[(data.symbol == symbol) & (data.id != q)].dropna()
        d = distance(data.loc[q, ["x", "y", "z"]].to_numpy(float), base[["x", "y", "z"]].to_numpy(float))
        order = np.lexsort((base.id, d))[:4]
        assert part.sort_values("place").b_id.tolist() == base.id.to_numpy()[order].tolist()


def test_knn_impute_small_groups_and_empty_rows(spark):
    rows = [("a", 1, 1.0, 10.0), ("a", 2, 2.0, 20.0), ("a", 3, 1.1, None), ("a", 4, None, None), ("b", 5, None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, id bigint, x double, y double")
    got = {r.id: (r.x, r.y) for r in knn_impute(df, ["x", "y"], "id", k=2).collect()}
    assert got[3] == (1.1, 15.0) and got[4] == (None, None) and got[5] == (None, 1.0)


def test_smote_balances_within_the_class(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i < 120 else (1 if i < 150 else 2), float(rng.normal(i >= 120)), float(rng.normal())) for i in range(157)]
    df = spark.createDataFrame(rows, "id bigint, label int, x double, y double")
    got = smote(df, ["x", "y"], "id", k=3).toPandas()
    assert got.groupby("label").size().to_dict() == {1: 90, 2: 113}
    data = pd.DataFrame(rows, columns=["id", "label", "x", "y"])
    for label, part in got.groupby("label"):
        cls = data[data.label == label]
        assert part.x.between(cls.x.min(), cls.x.max()).all() and part.y.between(cls.y.min(), cls.y.max()).all()
        assert set(part.id) <= set(cls.id)
    again = smote(df, ["x", "y"], "id", k=3).toPandas()
    key = ["label", "id", "copy"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def shapes(n, seed=9):
    """Spread, clustered, flat (few values a coordinate) and lopsided points; a far one alone in each."""
    rng = np.random.default_rng(seed)
    far = np.array([[1e6, -1e6, 0.0]])
    centres = rng.normal(scale=100, size=(5, 3))
    return {
        "spread": np.vstack([rng.normal(size=(n - 1, 3)), far]),
        "clustered": np.vstack([centres[rng.integers(0, 5, n - 1)] + rng.normal(scale=0.01, size=(n - 1, 3)), far]),
        "flat": np.vstack([np.column_stack([rng.integers(0, 2, n - 1), rng.integers(0, 3, n - 1), rng.normal(size=n - 1)]), far]),
        "lopsided": np.vstack([np.where(rng.random((n - 1, 3)) < 0.9, 0.0, rng.normal(size=(n - 1, 3))), far]),
        "doubled": np.vstack([np.repeat(rng.normal(size=(2, 3)), (n - 1) // 2 + 1, axis=0)[: n - 1], far]),
    }


def test_nearest_in_many_small_cells_equals_brute_force(spark):
    frames = [pd.DataFrame(x, columns=list("xyz")).assign(symbol=name) for name, x in shapes(220).items()]
    data = pd.concat(frames, ignore_index=True)
    data["id"] = np.arange(len(data))[::-1]
    df = spark.createDataFrame(data)
    got = nearest(df, df, ["x", "y", "z"], 3, ["symbol"], "id", leaf=8).toPandas()
    assert len(got) == 3 * len(data)
    for symbol, part in got.groupby("symbol"):
        base = data[data.symbol == symbol]
        points, ids = base[["x", "y", "z"]].to_numpy(float), base.id.to_numpy()
        found = part.sort_values("place").groupby("q_id").b_id.apply(list)
        for point, own in zip(points, ids):
            d = distance(point, points)
            d[ids == own] = np.inf
            order = np.lexsort((ids, d))[:3]
            assert found[own] == ids[order].tolist(), (symbol, own)


def test_cells_part_what_agrees_in_most_rows(spark):
    """No cell stays above ``leaf`` rows while its rows differ, however the values lie."""
    for name, x in shapes(500).items():
        df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz"))).dropDuplicates()
        rows, levels = _cells(df, ["x", "y", "z"], [], 16)
        assert rows.count() == df.count(), name
        sizes = rows.groupBy("_node").count()
        assert sizes.agg({"count": "max"}).first()[0] <= 16, name
        assert len(levels) <= 12, name


def test_nearest_of_small_and_empty_groups(spark):
    schema = "symbol string, id bigint, x double, y double"
    one = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 2, 1.0, 1.0), ("b", 3, 4.0, 5.0), (None, 4, 1.0, 1.0)], schema)
    got = [(r.symbol, r.q_id, r.b_id, r.distance, r.place) for r in nearest(one, one, ["x", "y"], 3, ["symbol"], "id").collect()]
    assert sorted(got) == [("b", 2, 3, 5.0, 1), ("b", 3, 2, 5.0, 1)]
    none = spark.createDataFrame([], schema)
    assert nearest(none, none, ["x", "y"], 3, ["symbol"], "id").count() == 0
    assert nearest(one, none, ["x", "y"], 3, ["symbol"], "id").count() == 0
