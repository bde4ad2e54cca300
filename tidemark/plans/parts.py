"""Joins and cuts that spread one large group over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

FAN = 16
#: Rows up to which a series stays in one part.
WHOLE = 200_000


def join_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Bring one row per key to all rows of the key.

    Small statistics are sent to all tasks, by their size at run time. Else both sides are shuffled by key, and Spark splits
    the rows of a key that is hot among many tasks and copies its one statistics row to these (``prepare`` sees to that).
    """
    if not keys:
        # Without keys the statistics are one row at most.
        return rows.join(F.broadcast(stats), F.lit(True), how)
    return rows.join(stats, list(keys), how)


def sketch_parts(df: DataFrame, value: Column, by: Sequence[str], name: str = "_part", whole: int = WHOLE) -> DataFrame:
    """Append ``name`` 0..4095, growing with ``value``: cuts of equal row counts, whatever the distribution.

    Groups up to ``whole`` rows stay whole. Others are cut at quantiles from a mergeable sketch; a row finds
    its part by halving, in plain expressions, as lambdas would copy the cuts to every row. The cuts are staged: sketches
    merged in another order give other ones, and callers read the parts more than once.
    """
    by = list(by)
    n = FAN * FAN * FAN
    valued = df.withColumn("_v", value)
    keyed = valued.select(*by, "_v")
    large = keyed.groupBy(*by).agg(F.count("_v").alias("_n")).filter(F.col("_n") > whole).drop("_n")
    if large.isEmpty():  # one pass over the keys, and none of those below
        return df.withColumn(name, F.lit(0).cast("bigint"))
    # One constant instead of thousands of literals keeps planning short.
    shares = ",".join(str(i / n) for i in range(1, n))
    cuts = F.expr(f"percentile_approx(_v, cast(split('{shares}', ',') as array<double>), {4 * n})")
    wanted = join_stats(keyed, large, by, "left_semi") if by else keyed
    sketch = wanted.groupBy(*by).agg(F.count("_v").alias("_n"), cuts.alias("_cuts")).filter(F.col("_n") > whole).drop("_n")
    joined = join_stats(valued, stage(sketch, "cuts"), by)
    joined = joined.withColumn("_cut", F.lit(0))
    for step in (2**i for i in reversed(range((n - 1).bit_length()))):
        joined = joined.withColumn("_cut", F.expr(f"if(get(_cuts, _cut + {step - 1}) <= _v, _cut + {step}, _cut)"))
    return joined.withColumn(name, F.expr("coalesce(bigint(_cut), 0L)")).drop("_v", "_cuts", "_cut")
