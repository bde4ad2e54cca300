"""Exponentially decayed means as running sums, without a row loop.

With keep = 1 - alpha, the decayed sum of x up to row k of a block is keep^k * sum(x_j * keep^-j): one running
window sum. The block must be short enough for the powers to stay finite, and it starts ``reach`` copied rows
early, after which what came before weighs less than double precision can hold. ``pow`` is exact to the last
digit for any exponent, which exp of a product is not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import BARS, Axis, Halo

_FORGOTTEN = 39.2  # exp(-39.2) < 1e-17
_LARGEST = 640.0  # powers stay below exp(640) < 1e278


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _lam(alpha: float) -> float:
    return -math.log1p(-alpha)


@dataclass(frozen=True)
class Rate:
    """A weight and its complement as columns that are constant along a series."""

    alpha: Column
    keep: Column

    @staticmethod
    def of(alpha: "float | Rate") -> "Rate":
        return alpha if isinstance(alpha, Rate) else Rate(F.lit(alpha), F.lit(1.0 - alpha))

    def grow(self, rows: Column) -> Column:
        return F.pow(self.keep, -rows)

    def shrink(self, rows: Column) -> Column:
        return F.pow(self.keep, rows)


def rate_columns(name: str, alphas: Mapping[str, float], choose: Callable[[Mapping[str, float]], Column]) -> dict[str, Column]:
    """Columns for ``rate(name)``: per series the weight that ``choose`` picks, with its complement."""
    return {f"{name}_alpha": choose(alphas), f"{name}_keep": choose({k: 1.0 - a for k, a in alphas.items()})}


def rate(name: str) -> Rate:
    return Rate(F.col(f"{name}_alpha"), F.col(f"{name}_keep"))


def reach(alpha: float) -> int:
    """Rows after which the past weighs nothing."""
    return math.ceil(_FORGOTTEN / _lam(alpha))


def decayed_halo(df: DataFrame, alphas: Iterable[float], back: int, axis: Axis = BARS) -> Halo:
    """Exact blocks as long as the largest ``alpha`` allows (at most 8192 rows) behind ``back`` rows."""
    longest = int(_LARGEST / max(_lam(a) for a in alphas))
    return Halo.exact(df, axis, back, block=max(1, min(8192, longest - back)))


def ewm_mean(h: Halo, x: Column, alpha: float | Rate, adjust: bool = True) -> Column:
    """``adjust``: weights normalised over the known rows. Otherwise y = alpha * x + (1 - alpha) * y_before
    from the first row, for which ``x`` must not be null."""
    if not adjust:
        return ewm_from(h, x, alpha, F.col("_k") == 1)
    grow = Rate.of(alpha).grow(F.col("_k"))
    return F.sum(x * grow).over(h.so_far) / F.sum(F.when(x.isNotNull(), grow)).over(h.so_far)


def ewm_from(h: Halo, x: Column, alpha: float | Rate, start: Column) -> Column:
    """y = alpha * x + (1 - alpha) * y_before, and y = x on the row where ``start`` holds; rows before it
    must have x = 0."""
    r, k = Rate.of(alpha), F.col("_k")
    weight = F.when(start, 1.0).otherwise(r.alpha)
    return F.sum(x * weight * r.grow(k)).over(h.so_far) * r.shrink(k)


def ewm_plain(h: Halo, x: Column, alpha: float) -> Column:
    """The decayed sum alpha * (x + (1 - alpha) * x_before + ...) without a start value."""
    r, k = Rate.of(alpha), F.col("_k")
    return F.sum(x * alpha * r.grow(k)).over(h.so_far) * r.shrink(k)


def forget(alpha: float, rows: Column) -> Column:
    """What is left of a value after ``rows`` rows."""
    return Rate.of(alpha).shrink(rows)


def ema(df: DataFrame, column: str = "close", *, span: float | None = None, alpha: float | None = None, adjust: bool = False, name: str = "ema", axis: Axis = BARS) -> DataFrame:
    """Append the exponential mean of ``column``."""
    a = alpha if alpha is not None else span_alpha(span)
    h = decayed_halo(df, [a], reach(a), axis)
    return h.settle(h.frame.withColumn(name, ewm_mean(h, F.col(column).cast("double"), a, adjust)))
