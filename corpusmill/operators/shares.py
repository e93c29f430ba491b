"""Two-window share ratios, variants of them, and what differs between variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def assign_window(date: Column, trailing: tuple[str, str], preceding: tuple[str, str]) -> Column:
    """Closed intervals of days; null outside both and for a null date."""
    day = date.cast("date")
    return F.when(day.between(F.lit(trailing[0]).cast("date"), F.lit(trailing[1]).cast("date")), "trailing").when(day.between(F.lit(preceding[0]).cast("date"), F.lit(preceding[1]).cast("date")), "preceding")


def share_table(rows: DataFrame, keys: list[str], scope: list[str] | None = None, window: str = "window") -> DataFrame:
    """T, P, their scopes, shares, R, growth, interval and label for each key.

    One aggregation over the rows; scopes are sums over its few result rows (one label a row), so the totals need no
    second pass and no join to the input."""
    from pyspark.sql import Window

    counted = rows.groupBy(*keys).agg(F.count_if(F.col(window) == "trailing").alias("t"), F.count_if(F.col(window) == "preceding").alias("p"))
    over = Window.partitionBy(*(scope or [F.lit(1)]))
    return with_ratios(counted.withColumn("scope_t", F.sum("t").over(over)).withColumn("scope_p", F.sum("p").over(over)))


def with_ratios(counted: DataFrame) -> DataFrame:
    t, p, st, sp = (F.col(c) for c in ("t", "p", "scope_t", "scope_p"))
    r, (low, high) = stats.share_ratio(t, p, st, sp), stats.poisson_bounds(t, p, st, sp)
    low, high = F.when(r.isNotNull(), low), F.when(r.isNotNull(), high)
    return counted.select(
        "*",
        F.round(F.try_divide(t, st), 6).alias("share_t"),
        F.round(F.try_divide(p, sp), 6).alias("share_p"),
        F.round(r, 6).alias("ratio"),
        F.round(stats.raw_growth(t, p), 6).alias("growth"),
        F.round(low, 6).alias("ci_low"),
        F.round(high, 6).alias("ci_high"),
        stats.trend_label(r, low, high).alias("label"),
    )


def label_flips(table: DataFrame, key: str, variant: str) -> DataFrame:
    """Keys whose label is not the same in all variants, with the labels in variant order."""
    out = table.groupBy(key).agg(F.count_distinct("label").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(variant, "label"))), lambda x: F.concat_ws("=", x[variant], x["label"])), ",").alias("labels"))
    return out.where("n > 1").select(key, "labels")


def two_sided_diff(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Keys missing on either side, or whose values differ by more than the tolerance."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("right_value").isNull(), "missing").when(F.col("left_value").isNull(), "extra").when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "value")
    return both.withColumn("mismatch", kind).where("mismatch IS NOT NULL")
