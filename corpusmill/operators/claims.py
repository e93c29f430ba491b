"""Claims and the records that speak for or against them: tallies, and seven features with points and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STANCES = ("supportive", "critical", "neutral")
NOISY, OLD_DAYS, TOLD = 3, 365, 6


def tally(rows: DataFrame) -> DataFrame:
    """claim, stance, n, experiments, trailing, preceding, distinct_groups, independent_experiments (supportive ones
    only) of the rows in a window, zeros included; rows of the original group are one group.

    rows: claim, id, stance, kind, same_group, author, window."""
    per = rows.where("window IN ('trailing', 'preceding')").groupBy("claim", "stance").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "exp").alias("experiments"),
        *[F.count_if(F.col("window") == w).alias(w) for w in ("trailing", "preceding")],
        F.count_distinct(F.when(F.col("same_group"), F.lit("ORIGINAL")).otherwise(F.col("author"))).alias("distinct_groups"),
        F.count_if((F.col("kind") == "exp") & ~F.col("same_group")).alias("independent_experiments"),
    )
    every = rows.select("claim").distinct().select("claim", F.explode(F.array(*map(F.lit, STANCES))).alias("stance"))
    out = every.join(per, ["claim", "stance"], "left").fillna(0)
    return out.withColumn("independent_experiments", F.when(F.col("stance") == "supportive", F.col("independent_experiments")))


def _marks(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """claim, mark, n and the first ids of the rows that have the mark, at most TOLD of them: no list grows with a claim."""
    named = lambda marks: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in marks.items()]))).alias("mark")
    inside, positive, exp = F.col("window").isin("trailing", "preceding"), F.col("stance") == "supportive", F.col("kind") == "exp"
    of_rows = {
        "independent": positive & exp & ~F.col("same_group"),
        "null": inside & ((F.col("kind") == "comment") | ((F.col("stance") == "critical") & exp)),
        "withdrawn": positive & F.col("withdrawn"),
        "positive": positive,
        "own": positive & F.col("same_group"),
        "supportive_in": inside & positive,
        "critical_in": inside & (F.col("stance") == "critical"),
    }
    of_originals = {"original": F.lit(True), "withdrawn": F.col("withdrawn"), "reviewed": F.col("reviewed")}
    marks = rows.select("claim", F.lit(1).alias("lane"), "id", named(of_rows)).unionByName(originals.select("claim", F.lit(0).alias("lane"), "id", named(of_originals)))
    n = marks.groupBy("claim", "mark").agg(F.count("*").alias("n"))
    first = marks.withColumn("rank", F.row_number().over(Window.partitionBy("claim", "mark").orderBy("lane", "id"))).where(F.col("rank") <= TOLD)
    ids = first.groupBy("claim", "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return n.join(ids, ["claim", "mark"])


def noise_features(claims: DataFrame, originals: DataFrame, rows: DataFrame, run_date: str, weak_snippet: Column) -> DataFrame:
    """claims (claim, originals_independent, known_venue) with features, score, noisy and watch.

    originals: claim, id, date, text, withdrawn, reviewed.  rows: claim, id, stance, kind, same_group, window, withdrawn.
    weak_snippet: of an original's text, null where it has no weak-evidence phrase."""
    age = F.datediff(F.lit(run_date).cast("date"), F.col("date").cast("date"))
    per = _marks(rows, originals).groupBy("claim").agg(F.map_from_entries(F.collect_list(F.struct("mark", F.struct("n", "ids")))).alias("marks"))
    of = originals.select("claim", "id", age.alias("age"), F.when(weak_snippet.isNotNull(), F.struct("id", weak_snippet.alias("text"))).alias("weak"))
    of = of.groupBy("claim").agg(F.min("weak").alias("weak"), F.max_by(F.struct("id", "age"), F.struct("age", -F.col("id"))).alias("oldest"))
    x = claims.join(per, "claim", "left").join(of, "claim", "left").withColumn("marks", F.coalesce("marks", F.create_map().cast("map<string,struct<n:bigint,ids:array<bigint>>>")))
    n = lambda m: F.coalesce(F.try_element_at("marks", F.lit(m))["n"], F.lit(0))
    ids = lambda m, k=TOLD: F.array_join(F.slice(F.try_element_at("marks", F.lit(m))["ids"], 1, k), ", ")
    say, none = F.concat, F.lit("")
    pair = F.coalesce("originals_independent", F.lit(False)) & (n("original") >= 2)
    old = F.col("oldest.age") > OLD_DAYS
    rules = [
        ("F1_no_independent_replication", F.when((n("independent") > 0) | pair, 0).otherwise(2), F.when(n("independent") > 0, say(F.lit("independent: "), ids("independent"))).when(pair, say(F.lit("independent originals: "), ids("original"))).otherwise("none from outside the original group")),
        ("F2_comment_reply_null", F.least(F.lit(2), n("null")), F.when(n("null") > 0, say(n("null").cast("string"), F.lit(" records, e.g. "), ids("null", 5)))),
        ("F3_withdrawn_retracted", F.when(n("withdrawn") > 0, 3).otherwise(0), F.when(n("withdrawn") > 0, ids("withdrawn"))),
        ("F4_weak_evidence_language", F.when(F.col("weak").isNotNull(), 1).otherwise(0), F.when(F.col("weak").isNotNull(), say(F.col("weak.id").cast("string"), F.lit(": "), F.col("weak.text")))),
        ("F5_publication_linkage", F.when((n("reviewed") > 0) | F.col("known_venue").isNotNull(), -1).when(old, 1).otherwise(0), F.when(n("reviewed") > 0, say(F.lit("reviewed: "), ids("reviewed"))).when(F.col("known_venue").isNotNull(), say(F.lit("venue: "), F.col("known_venue"))).when(F.col("oldest").isNull(), "no original").when(old, say(F.col("oldest.id").cast("string"), F.lit(": "), F.col("oldest.age").cast("string"), F.lit(" days")))),
        ("F6_positive_only_from_original_group", F.when((n("positive") > 0) & (n("own") == n("positive")), 1).otherwise(0), F.when((n("positive") > 0) & (n("own") == n("positive")), ids("own"))),
        ("F7_critical_outnumber_supportive", F.when(n("critical_in") > n("supportive_in"), 1).otherwise(0), say(n("critical_in").cast("string"), F.lit(" to "), n("supportive_in").cast("string"))),
    ]
    features = F.array(*[F.struct(F.lit(name).alias("name"), points.cast("int").alias("points"), F.coalesce(told, none).alias("evidence")) for name, points, told in rules])
    x = x.select(*claims.columns, F.explode(F.array(features)).alias("features"))
    x = x.withColumn("score", F.aggregate("features", F.lit(0), lambda acc, f: acc + f["points"]))
    return x.withColumn("noisy", F.col("score") >= NOISY).withColumn("watch", (F.col("score") < NOISY) & (F.col("features")[0]["points"] == 2))
