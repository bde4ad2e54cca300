"""Exact quantiles per group, for groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here sketches of the group's share in each task
give points, and these, weighed and sorted, for each wanted probability a bracket of values that is certain to
hold the two ranks the quantile lies between; a second pass counts the rows below and inside the brackets, and only values inside a bracket are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.parts import join_stats
from tidemark.plans.series import Axis, running, total
from tidemark.session import stage

#: Points taken from the sketch of a chunk.
POINTS = 2000


def unpivot(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form (by..., column, x) with nulls, NaN and infinities left out."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "x")
    return long.filter(F.abs("x") < F.lit(float("inf")))


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = ("symbol",),
    accuracy: int = 10000,
    margin: float = 3.0,
) -> DataFrame:
    """Rows (by..., column, n, q): ``q`` is the array of linearly interpolated quantiles in order of ``probs``.

    Brackets reach ``margin`` times a sketch's error of n / ``accuracy`` ranks and two points to both sides. A rank outside its
    bracket (a sketch broke its bound) ends the job; it never becomes a null. Rows dealt to tasks otherwise give other brackets,
    so these are staged before tasks share them, and so are the counts, which the ranks read twice.
    """
    by = list(by)
    group = [*by, "column"]
    long = unpivot(df, by, cols)
    # A chunk is what one task reads, so no sketches are merged: merged ones keep nearly all their samples, and each merge copies them.
    shares = ",".join(str(i / POINTS) for i in range(1, POINTS + 1))
    points = F.expr(f"cast(split('{shares}', ',') as array<double>)")
    chunks = long.withColumn("_chunk", F.spark_partition_id()).groupBy(*group, "_chunk")
    chunks = chunks.agg(F.count(F.lit(1)).alias("_c"), F.percentile_approx("x", points, accuracy).alias("_s")).drop("_chunk")
    # Point i is the value at rank ceil(share * rows) of its chunk and stands for the ranks since the point before.
    rank = "bigint(ceil(double(_i + {}) / {} * _c))"
    weight = f"if(n <= {accuracy}, _c, {rank.format(1, POINTS)} - {rank.format(0, POINTS)})"
    sizes = chunks.withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    # Up to `accuracy` values the whole group is the bracket.
    placed = sizes.select(*group, "n", "_c", F.expr(f"posexplode(if(n <= {accuracy}, array(double(null)), _s)) AS (_i, _v)"))
    placed = placed.select(*group, "n", "_v", F.expr(weight).alias("_w")).filter("_w > 0")
    placed = placed.withColumn("_upto", F.sum("_w").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    # A point's rank is off by n / accuracy at most, one between points by the ranks a point stands for and one for rounding.
    reach = margin / accuracy + 2 / POINTS
    low, high = [], []
    for p in probs:
        below, above = (F.lit(p > 0.0) & (F.col("_upto") <= F.lit(p - reach) * F.col("n")), F.lit(p < 1.0) & (F.col("_upto") >= F.lit(p + reach) * F.col("n")))
        low.append(F.coalesce(F.max(F.when(below, F.col("_v"))), F.lit(float("-inf"))))
        high.append(F.coalesce(F.min(F.when(above, F.col("_v"))), F.lit(float("inf"))))
    brackets = placed.groupBy(*group, "n").agg(F.sort_array(F.array(*low)).alias("_lo"), F.sort_array(F.array(*high)).alias("_hi"))
    brackets = stage(brackets, "brackets")
    # Inside a bracket more lower ends than upper ones lie behind a value; the first upper end ahead is then that of a bracket around it.
    ends = join_stats(long, brackets, group).selectExpr(
        *group, "n", "x", "_lo", "_hi", "size(filter(_lo, v -> v <= x)) AS _in", "size(filter(_hi, v -> v < x)) AS _out"
    )
    width = "(get(_hi, _out) - get(_lo, _out))"
    share = f"if(_in > _out AND {width} > 0 AND {width} < double('Infinity'), (x - get(_lo, _out)) / {width}, 0D)"
    # Rows outside all brackets collapse to one row per gap; rows inside to one per distinct value.
    placed = ends.selectExpr(
        *group,
        "n",
        "CASE WHEN _in > _out THEN x END AS _value",
        "_in + _out AS _passed",
        f"bigint(floor((_in + _out + {share} / 2) * 256)) AS _slot",
    )
    counted = placed.groupBy(*group, "n", "_passed", "_value").agg(F.count(F.lit(1)).alias("c"), F.min("_slot").alias("_slot"))
    counted = stage(counted, "counted")
    axis = Axis(keys=(*group,), ts="_slot", ties=("_passed", "_value"))
    ranked = running(counted, axis, cell=F.col("_slot"), _upto=total("c"))
    # The values at the ranks around each probability, ranks counted from 0.
    picks = []
    for i, p in enumerate(probs):
        for name, whole in ((f"_a{i}", "floor"), (f"_b{i}", "ceil")):
            rank = f"{whole}((n - 1) * {float(p)!r}D)"
            picks.append(F.expr(f"max(CASE WHEN _upto > {rank} AND _upto - c <= {rank} THEN _value END)").alias(name))
    values = ranked.groupBy(*group, "n").agg(*picks)
    parts = []
    missed = f"raise_error('a quantile lies outside its bracket: raise accuracy above {accuracy}')"
    for i, p in enumerate(probs):
        rank = f"(n - 1) * {float(p)!r}D"
        a, b = (f"coalesce({end}{i}, {missed})" for end in ("_a", "_b"))
        parts.append(f"{a} + ({b} - {a}) * ({rank} - floor({rank}))")
    return values.selectExpr(*group, "n", f"array({', '.join(parts)}) AS q")


def quantile_columns(
    df: DataFrame,
    names: dict[str, tuple[str, float]],
    by: Sequence[str] = ("symbol",),
    accuracy: int = 10000,
) -> DataFrame:
    """One row per group with named quantiles, e.g. ``{"close_q1": ("close", 0.25)}``."""
    cols = list(dict.fromkeys(c for c, _ in names.values()))
    probs = sorted({p for _, p in names.values()})
    long = exact_quantiles(df, cols, probs, by, accuracy)
    picks = [F.expr(f"max(CASE WHEN column = '{c}' THEN q[{probs.index(p)}] END)").alias(name) for name, (c, p) in names.items()]
    return long.groupBy(*by).agg(*picks)


def value_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count ``c``, the rows ``below`` and the rows ``n`` of the group."""
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(counts, Axis(keys=tuple(by), ts=column, cell=None), _upto=total("c"))
    sizes = df.groupBy(*by).agg(F.count(column).alias("n"))
    ranked = join_stats(ranked, sizes, by)
    return ranked.select(*by, column, "c", (F.col("_upto") - F.col("c")).alias("below"), "n")


__all__ = ["exact_quantiles", "quantile_columns", "unpivot", "value_ranks"]
