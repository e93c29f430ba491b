"""Share ratios, intervals, trend fits and scores as Column expressions.  Null where undefined; nothing is rounded here
unless the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of the intervals, and the bounds of the labels.
Z95, RISING, DECLINING = 1.96, 1.10, 0.90


def share_ratio(t: Column, p: Column, scope_t: Column, scope_p: Column) -> Column:
    """(t / scope_t) / (p / scope_p), null if a count or scope is 0."""
    ok = (t > 0) & (p > 0) & (scope_t > 0) & (scope_p > 0)
    return F.when(ok, (t / scope_t) / (p / scope_p))


def raw_growth(t: Column, p: Column) -> Column:
    return F.try_divide(t, p) - 1


def poisson_bounds(t: Column, p: Column, scope_t: Column, scope_p: Column, z: float = Z95) -> tuple[Column, Column]:
    """exp(log R -+ z sqrt(1/t + 1/p + 1/scope_t + 1/scope_p))."""
    r = share_ratio(t, p, scope_t, scope_p)
    inverse = [F.try_divide(F.lit(1.0), c) for c in (t, p, scope_t, scope_p)]
    spread = F.lit(z) * F.sqrt(inverse[0] + inverse[1] + inverse[2] + inverse[3])
    return F.exp(F.log(r) - spread), F.exp(F.log(r) + spread)


def trend_label(r: Column, low: Column, high: Column) -> Column:
    return F.when((r >= RISING) & (low > 1), "rising").when((r <= DECLINING) & (high < 1), "declining").otherwise("flat")


def wilson_bounds(s: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1], three decimals; null without trials."""
    p, per = F.try_divide(s, n), F.try_divide(F.lit(z * z), n)
    mid = (p + per / 2) / (1 + per)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(per, 4 * n)) / (1 + per)
    return (F.when(n > 0, F.round(F.greatest(F.lit(0.0), mid - half), 3)), F.when(n > 0, F.round(F.least(F.lit(1.0), mid + half), 3)))


def unique_estimate(n: Column, dup: Column, rate: Column) -> Column:
    return F.round(n * (1 - dup) * rate, 1)


def safe_share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 4)


def ols(y: Column, x: Column) -> dict[str, Column]:
    """Aggregates of y on x: n, slope, its standard error and t (t is 0 where the error is 0; null below 3 points)."""
    n, slope = F.count(y), F.regr_slope(y, x)
    rss = F.greatest(F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0))
    se = F.when(n > 2, F.sqrt(F.try_divide(F.try_divide(rss, n - 2), F.regr_sxx(y, x))))
    return {"n": n, "slope": slope, "se": se, "t": F.when(se > 0, F.try_divide(slope, se)).when(se == 0, F.lit(0.0))}


def slope_sign(slope: Column) -> Column:
    return F.signum(slope).cast("int")


def contradicts(label: Column, sign: Column) -> Column:
    """A rising label with a falling fit, or the reverse."""
    return ((label == "rising") & (sign < 0)) | ((label == "declining") & (sign > 0))


def pooled_z(x: Column, n: Column, pooled: Column) -> Column:
    """(x - n p) / sqrt(n p (1 - p))."""
    var = n * pooled * (1 - pooled)
    return F.try_divide(x - n * pooled, F.sqrt(var))


def lift(both: Column, a: Column, b: Column, total: Column) -> Column:
    return F.try_divide(both * total, a * b)


def over_representation(c_n: Column, n: Column, c_d: Column, d: Column) -> Column:
    """Ratio of add-one shares."""
    return ((c_n + 1) / (n + 1)) / ((c_d + 1) / (d + 1))


def prefix_length(n: Column, threshold: float) -> Column:
    return (n - F.ceil(F.lit(threshold) * n) + 1).cast("int")


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)
