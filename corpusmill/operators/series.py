"""Zero-filled periodic series, trend fits, pooled z-scores and leave-one-out recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .shares import with_ratios


def zero_filled_counts(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """A row for every key and every bucket that occurs: both lists come from the aggregated counts, not the input."""
    counts = rows.groupBy(key, bucket).agg(F.count("*").alias("n"))
    span = counts.select(bucket).distinct().crossJoin(counts.select(key).distinct())  # distinct labels x periods
    return span.join(counts, [key, bucket], "left").select(key, bucket, F.coalesce("n", F.lit(0)).alias("n"))


def share_series(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """Counts and shares of each key in each bucket, with the bucket's place in time (from 0)."""
    filled = zero_filled_counts(rows, key, bucket)
    total = F.sum("n").over(Window.partitionBy(bucket))
    place = (F.row_number().over(Window.partitionBy(key).orderBy(bucket)) - 1).alias("place")
    return filled.withColumn("total", total).select(key, bucket, "n", "total", (F.col("n") / F.col("total")).alias("share"), place)


def fit(series: DataFrame, key: str) -> DataFrame:
    """Least squares of share on place for each key."""
    return series.groupBy(key).agg(*[c.alias(n) for n, c in stats.ols(F.col("share"), F.col("place").cast("double")).items()])


def without_ends(series: DataFrame, key: str) -> DataFrame:
    """The first and last (partial) buckets dropped, places counted anew."""
    last = F.max("place").over(Window.partitionBy(key))
    kept = series.withColumn("last", last).where((F.col("place") > 0) & (F.col("place") < F.col("last")))
    return kept.drop("last").withColumn("place", F.col("place") - 1)


def pooled_z_scores(series: DataFrame, key: str) -> DataFrame:
    """Each bucket against the pooled share of all but the first and last, which are scored all the same."""
    w = Window.partitionBy(key)
    inner = (F.col("place") > 0) & (F.col("place") < F.max("place").over(w))
    marked = series.withColumn("inner", inner)
    pooled = F.sum(F.when(F.col("inner"), F.col("n"))).over(w) / F.sum(F.when(F.col("inner"), F.col("total"))).over(w)
    return marked.withColumn("pooled", pooled).withColumn("z", stats.pooled_z(F.col("n"), F.col("total"), F.col("pooled"))).drop("inner")


def leave_one_out(rows: DataFrame, key: str, bucket: str, window: str) -> DataFrame:
    """The share table without each bucket in turn: whole sums less the bucket's own, so no bucket is read twice."""
    counts = rows.groupBy(key, bucket).agg(F.count_if(F.col(window) == "trailing").alias("bt"), F.count_if(F.col(window) == "preceding").alias("bp"))
    buckets = counts.select(bucket).distinct()
    keys = counts.groupBy(key).agg(F.sum("bt").alias("kt"), F.sum("bp").alias("kp"))
    grid = keys.crossJoin(buckets).join(counts, [key, bucket], "left").fillna(0, ["bt", "bp"])  # labels x periods
    grid = grid.select(key, F.col(bucket).alias("left_out"), (F.col("kt") - F.col("bt")).alias("t"), (F.col("kp") - F.col("bp")).alias("p"))
    w = Window.partitionBy("left_out")
    return with_ratios(grid.withColumn("scope_t", F.sum("t").over(w)).withColumn("scope_p", F.sum("p").over(w)))
