import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import codes
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ids int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p), []).append(cut(v, p))
            new.append([[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, y in kept:
        code = [near(v, p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))
        total[y] = total.get(y, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in code), error, y))
    return sorted([(i, c, e, total[y], digest) for i, c, e, y in out], key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, spread):
    """Clusters, copies, vectors on a coarse grid (ties), and rows that are left out."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            v = rng.choice([None, [None] * 16, [float("nan")] + [0.0] * 15, [float("-inf")] * 16])
        elif kind < 0.4:
            v = [0.5] * 16
        elif kind < 0.6:
            v = [rng.randint(-1, 1) / 4 for _ in range(16)]
        else:
            v = [x + rng.gauss(0, spread) for x in rng.choice(centres)]
        rows.append((rng.choice([i, i, i, None]), v, rng.choice([None, 0, 1, 2]), "", 0))
    return rows


@pytest.mark.parametrize("seed,n,spread,chunk,leaf", [(1, 0, 1, 2048, 8), (2, 5, 1, 2048, 8), (3, 300, 0.01, 2048, 8), (4, 300, 0.3, 64, 1), (5, 200, 2.0, 7, 2)])
def test_against_brute_force(spark, monkeypatch, seed, n, spread, chunk, leaf):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    rows = vectors(seed, n, spread) + vectors(seed, n, spread)[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(codes.compressed(df)) == brute(rows)


def test_tree():
    """Children cover their node's points, lie apart, and the first has its centre."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-4000, 4000, (300, 8)), np.zeros((50, 8), np.int64), rng.integers(-3, 3, (100, 8)) + 1000])
    tree = codes.cover_tree(points, 4)
    assert sorted(tree["order"].tolist()) == list(range(len(points)))
    assert (tree["points"] == points[tree["order"]]).all()
    centre = lambda k: tree["points"][tree["begin"][k]].astype(float)
    for k in range(len(tree["begin"])):
        a, b = tree["begin"][k], tree["end"][k]
        assert np.linalg.norm(tree["points"][a:b] - centre(k), axis=1).max() <= tree["radius"][k] + 1e-9
        below = range(tree["child"][k], tree["child"][k] + tree["children"][k])
        if not len(below):
            assert b - a <= 4 or tree["radius"][k] == 0
            continue
        assert [tree["begin"][j] for j in below][0] == a and tree["end"][below[-1]] == b
        assert all(tree["end"][i] == tree["begin"][i + 1] and tree["radius"][i] <= tree["radius"][k] / 2 for i in below[:-1])
        centres = [centre(j) for j in below]
        assert all(np.linalg.norm(x - y) > tree["radius"][k] / 2 for i, x in enumerate(centres) for y in centres[:i])


def test_whole_subtrees(monkeypatch):
    """Close groups go to their entries without a comparison of their points."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-10_000, 10_000, (16, 8))
    points = np.repeat(entries, 64, axis=0) + rng.integers(-5, 5, (1024, 8))
    compared, plain = [], codes._squares
    monkeypatch.setattr(codes, "_squares", lambda a, b: compared.append(max(a.size, b.size)) or plain(a, b))
    tree = codes.cover_tree(points)
    compared.clear()
    count, total = codes.assign(tree, entries)
    assert sum(compared) < points.size * 16 / 4
    nearest = plain(points[:, None], entries[None]).argmin(axis=1)
    assert (count == np.bincount(nearest, minlength=16)).all()
    assert all((total[e] == points[nearest == e].sum(axis=0)).all() for e in range(16))


def test_limits(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for rows in ([(1, [0.0] * 9, "")], [(1, [0.0] * 8, ""), (2, [0.0] * 16, "")], [(1, [4e4] * 8, "")]):
        with pytest.raises(Exception, match="component"):
            codes.compressed(df(rows)).collect()


def test_query(spark, sf):
    rows = [(*r, "", 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op12_cover_tree_codes"](spark, sf)) == brute(rows)
