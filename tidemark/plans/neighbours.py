"""Exact nearest neighbours without comparing all pairs.

The rows are cut into cells of like row counts, level by level: a cell of more than ``leaf`` rows is cut in four at the
sketched quartiles of the coordinate that spreads most in it (at its mean where half of the rows agree in every coordinate). A cell
knows its row count and its bounding box. A query first goes down to the cells with the least distance to it that hold k + 1
rows, and the k-th distance there is its bound. It then goes down once more into every cell no further than the bound, and only rows
of such cells are compared with it. Clustered, flat and few-valued coordinates are cut where their rows are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.parts import join_stats
from tidemark.session import stage

#: Rows up to which a cell is not cut.
LEAF = 128
#: Levels up to which cell numbers, four times larger a level, fit in 64 bits; cells below are left as large as they are.
DEPTH = 30


def _distance(cols: Sequence[str]) -> Column:
    """Euclidean distance over the coordinates the query has, scaled up for those it lacks."""
    squares = [F.coalesce((F.col(f"q_{c}") - F.col(f"b_{c}")) ** 2, F.lit(0.0)) for c in cols]
    return F.sqrt(sum(squares[1:], squares[0]) * _scale(cols))


def _scale(cols: Sequence[str]) -> Column:
    known = [F.col(f"q_{c}").isNotNull().cast("int") for c in cols]
    return F.lit(float(len(cols))) / sum(known[1:], known[0])


def _boxes(rows: DataFrame, cols: list[str], by: list[str], leaf: int) -> DataFrame:
    """One row per cell: ``_n`` rows, least and largest coordinates, and the coordinate and values to cut it at (none: a leaf)."""
    n = len(cols)
    sums = [F.count(F.lit(1)).alias("_n")]
    for kind, fn in (("_lo", F.min), ("_hi", F.max), ("_mean", F.avg), ("_q", lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 200))):
        sums.append(F.array(*[fn(c) for c in cols]).alias(kind))
    axes = f"sequence(0, {n - 1})"
    # The widest middle half; where all are zero, the widest range.
    found = rows.groupBy(*by, "_node").agg(*sums)
    found = found.withColumn("_widest", F.expr(f"array_max(transform({axes}, i -> struct(_q[i][2] - _q[i][0] AS w, _hi[i] - _lo[i] AS r, -i AS i)))"))
    found = found.withColumn("_axis", F.expr("-_widest.i"))
    middle = "if(_mean[_axis] > _lo[_axis], _mean[_axis], _hi[_axis])"
    cuts = f"CASE WHEN _n <= {leaf} OR _widest.r = 0 THEN array() WHEN _widest.w > 0 THEN array_distinct(_q[_axis]) ELSE array({middle}) END"
    return found.select(*by, "_node", "_n", "_lo", "_hi", "_axis", F.expr(f"cast({cuts} AS array<double>)").alias("_cuts"))


def _cells(base: DataFrame, cols: list[str], by: list[str], leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with ``_node``, their cell at the lowest level, and for each level below the first its cells by parent."""
    rows = stage(base.withColumn("_node", F.lit(0).cast("bigint")), "points")
    levels: list[DataFrame] = []
    while True:
        boxes = stage(_boxes(rows, cols, by, leaf), "boxes")
        levels.append(boxes)
        if len(levels) > DEPTH or boxes.filter(F.size("_cuts") > 0).isEmpty():
            break
        placed = join_stats(rows, boxes.select(*by, "_node", "_axis", "_cuts"), [*by, "_node"], "inner")
        value = F.get(F.array(*cols), F.col("_axis"))
        child = F.col("_node") * 4 + F.size(F.filter("_cuts", lambda c: c <= value))
        rows = stage(placed.withColumn("_node", child).select(*rows.columns), "points")
    cell = F.struct(F.col("_node").alias("node"), F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    parent = F.shiftright("_node", 2).alias("_node")
    # Four cells a parent at most.
    return rows, [b.groupBy(*by, parent).agg(F.collect_list(cell).alias("_below")) for b in levels[1:]]


def _gap(cols: Sequence[str], cell: str) -> str:
    """SQL: distance from the query to a cell's box; a coordinate the query lacks counts as inside."""
    parts = [f"power(greatest({cell}.lo[{i}] - `q_{c}`, `q_{c}` - {cell}.hi[{i}], 0D), 2)" for i, c in enumerate(cols)]
    return f"sqrt(({' + '.join(parts)}) * _scale)"


def nearest(queries: DataFrame, base: DataFrame, cols: Sequence[str], k: int, by: Sequence[str], id: str, leaf: int = LEAF) -> DataFrame:
    """Rows (by..., q_<id>, q_<cols>, b_<id>, b_<cols>, distance, place) with place 1..k by distance, then id.

    ``base`` must have all ``cols``; a query needs at least one. A row is not its own neighbour. ``id`` is unique in a group.
    """
    by, cols = list(by), list(cols)
    base = base.select(*by, id, *[F.col(c).cast("double") for c in cols]).na.drop(subset=cols)
    # Of base rows at the same point only the first k + 1 by id can be among the k nearest of any query.
    same = Window.partitionBy(*by, *cols).orderBy(id)
    base = base.withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= k + 1).drop("_nth")
    base = base.select(*by, F.col(id).alias(f"b_{id}"), *[F.col(c).alias(f"b_{c}") for c in cols])
    rows, levels = _cells(base, [f"b_{c}" for c in cols], by, leaf)

    q = queries.select(*by, F.col(id).alias(f"q_{id}"), *[F.col(c).cast("double").alias(f"q_{c}") for c in cols])
    q = q.na.drop("all", subset=[f"q_{c}" for c in cols]).withColumn("_scale", _scale(cols))
    same_group = [*by, f"q_{id}"]

    # Down to the nearest cells that hold k + 1 rows: each cell on the way passes on how many rows it has to give.
    at = q.withColumns({"_node": F.lit(0).cast("bigint"), "_need": F.lit(k + 1).cast("bigint")})
    for below in levels:
        at = join_stats(at, below, [*by, "_node"], "inner")
        at = at.withColumn("_near", F.expr(f"array_sort(transform(_below, c -> struct({_gap(cols, 'c')} AS gap, c.node AS node, c.n AS n)))"))
        left = "_need - aggregate(slice(_near, 1, i), 0L, (a, x) -> a + x.n)"
        at = at.withColumn("_near", F.expr(f"filter(transform(_near, (c, i) -> struct(c.node AS node, least(c.n, {left}) AS need)), c -> c.need > 0)"))
        at = at.withColumn("_c", F.explode("_near")).withColumns({"_node": F.col("_c.node"), "_need": F.col("_c.need")})
        at = at.drop("_below", "_near", "_c")

    def pairs(found: DataFrame) -> DataFrame:
        both = found.join(rows, [*by, "_node"]).filter(F.col(f"q_{id}") != F.col(f"b_{id}"))
        return both.withColumn("distance", _distance(cols))

    # The k least distances of each query go on, limited before the shuffle.
    over = Window.partitionBy(*same_group).orderBy("distance", f"b_{id}")
    first = pairs(at.drop("_need")).select(*same_group, f"b_{id}", "distance")
    first = first.withColumn("_place", F.row_number().over(over)).filter(F.col("_place") <= k)
    bounds = first.groupBy(*same_group).agg((F.max("distance") * (1 + 1e-12)).alias("_bound"))

    # Down again, into every cell that the bound reaches.
    wide = stage(q.join(bounds, same_group), "bounds").withColumn("_node", F.lit(0).cast("bigint"))
    for below in levels:
        wide = join_stats(wide, below, [*by, "_node"], "inner")
        reached = F.expr(f"transform(filter(_below, c -> {_gap(cols, 'c')} <= _bound), c -> c.node)")
        wide = wide.withColumn("_node", F.explode(reached)).drop("_below")
    best = pairs(wide).filter(F.col("distance") <= F.col("_bound"))
    best = best.withColumn("place", F.row_number().over(over)).filter(F.col("place") <= k)
    return best.select(
        *by, f"q_{id}", *[f"q_{c}" for c in cols], f"b_{id}", *[f"b_{c}" for c in cols], "distance", "place"
    )
