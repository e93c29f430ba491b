"""Rule scores with evidence, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(name: str, points: Column, evidence: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), points.cast("int").alias("points"), F.coalesce(evidence, F.lit("")).alias("evidence"))


def scored(rows: DataFrame, features: list[Column], noisy: int = 3, watch: str | None = None) -> DataFrame:
    """``features``, their sum, and a verdict: noisy from ``noisy`` points, watch if the named feature has any, else ok."""
    out = rows.withColumn("features", F.array(*features))
    out = out.withColumn("score", F.aggregate("features", F.lit(0), lambda acc, f: acc + f["points"]))
    watched = F.exists("features", lambda f: (f["name"] == watch) & (f["points"] > 0)) if watch else F.lit(False)
    return out.withColumn("verdict", F.when(F.col("score") >= noisy, "noisy").when(watched, "watch").otherwise("ok"))


def evidence_text(features: Column) -> Column:
    """Evidence of the features that scored, in order."""
    told = F.filter(features, lambda f: f["points"] != 0)
    return F.array_join(F.transform(told, lambda f: F.concat(f["name"], F.lit(":"), f["points"].cast("string"), F.lit(":"), f["evidence"])), "; ")


def verdicts(rows: DataFrame, checks: list[tuple[str, Column, float]]) -> DataFrame:
    """check, value, threshold, pass for each (name, aggregate, least value): one aggregation, then one row a check."""
    one = rows.agg(*[c.cast("double").alias(n) for n, c, _ in checks])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(float(t)).alias("threshold")) for n, _, t in checks])).alias("c")
    return one.select(stacked).select("c.*", (F.col("c.value") >= F.col("c.threshold")).alias("pass"))
