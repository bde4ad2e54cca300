"""Sample corrections and small statistical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three values."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null below four values."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def moments(x: Column) -> Column:
    """Number, mean and sum of squared deviations of the known values as an aggregate; two of them merge."""
    n = F.count(x)
    return F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"))


def merged_moments(a: Column, b: Column) -> Column:
    """The moments of two sets of values from those of each (pairwise update, stable far from zero); null is an empty set."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = b["n"] / F.nullif(n, F.lit(0))
    both = F.struct(
        n.alias("n"),
        (a["mean"] + F.coalesce(apart * share, F.lit(0.0))).alias("mean"),
        (a["m2"] + b["m2"] + F.coalesce(apart * apart * a["n"] * share, F.lit(0.0))).alias("m2"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def above(m: Column, deviations: float) -> Column:
    """Mean plus so many population deviations; null of no values."""
    return F.when(m["n"] > 0, m["mean"] + deviations * F.sqrt(m["m2"] / m["n"]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (Acklam's rational approximation,
    relative error below 1.2e-9), for 0 < p < 1."""
    # The published coefficients.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def poly(coefficients, x: Column) -> Column:
        value = F.lit(coefficients[0])
        for k in coefficients[1:]:
            value = value * x + k
        return value

    def tail(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return poly(c, t) / (poly(d, t) * t + 1)

    q = p - 0.5
    r = q * q
    middle = poly(a, r) * q / (poly(b, r) * r + 1)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)
