"""Share ratios, series and fits over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import series as S
from ..operators import shares as R
from .common import Registry, r6, table

registry = Registry()
TRAILING, PRECEDING = ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15")
O_TRAILING, O_PRECEDING = ("1999-01-01", "2001-12-31"), ("1995-01-01", "1998-12-31")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("window", R.assign_window(F.col("ts"), TRAILING, PRECEDING))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("window", R.assign_window(F.col("o_orderdate"), O_TRAILING, O_PRECEDING)).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


_W = "CASE WHEN ts::DATE BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' THEN 'trailing' WHEN ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' THEN 'preceding' END"
_OW = "CASE WHEN o_orderdate::DATE BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' THEN 'trailing' WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'preceding' END"


def ratio_sql(source: str, keys: str, over: str) -> str:
    """SELECT of a share table over a subquery with t and p per key."""
    return f"""WITH c AS ({source}), s AS (SELECT *, sum(t) OVER ({over}) AS scope_t, sum(p) OVER ({over}) AS scope_p FROM c),
r AS (SELECT *, CASE WHEN t > 0 AND p > 0 THEN (t / scope_t) / (p / scope_p) END AS ratio_, CASE WHEN t > 0 AND p > 0 THEN 1.96 * sqrt(1 / t + 1 / p + 1 / scope_t + 1 / scope_p) END AS se FROM s),
b AS (SELECT *, exp(ln(ratio_) - se) AS lo, exp(ln(ratio_) + se) AS hi FROM r)
SELECT {keys}, t::BIGINT AS t, p::BIGINT AS p, scope_t::BIGINT AS scope_t, scope_p::BIGINT AS scope_p, round(t / scope_t, 6) AS share_t, round(p / scope_p, 6) AS share_p,
    round(ratio_, 6) AS ratio, round(CASE WHEN p > 0 THEN t / p - 1 END, 6) AS growth, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
    CASE WHEN ratio_ >= 1.10 AND lo > 1 THEN 'rising' WHEN ratio_ <= 0.90 AND hi < 1 THEN 'declining' ELSE 'flat' END AS label FROM b"""


@registry.add(ratio_sql(f"SELECT event_type, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT *, {_W} AS w FROM events) GROUP BY 1", "event_type", ""))
def window_share_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-window share ratio, interval and trend label for each event type."""
    return R.share_table(events(spark, sf_dir), ["event_type"])


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scope and the narrower one in one pass: each row counts for every variant that it belongs to."""
    e = events(spark, sf_dir)
    named = F.array_compact(F.array(F.lit("full"), F.when(F.col("value") >= 50, "high")))
    return R.share_table(e.withColumn("variant", F.explode(named)), ["variant", "event_type"], ["variant"])


_VARIANTS = ratio_sql(f"SELECT variant, event_type, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT event_type, {_W} AS w, unnest(CASE WHEN value >= 50 THEN ['full', 'high'] ELSE ['full'] END) AS variant FROM events) GROUP BY 1, 2", "variant, event_type", "PARTITION BY variant")


@registry.add(_VARIANTS)
def share_ratio_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table for the full and the narrower scope."""
    return _variants(spark, sf_dir)


@registry.add(ratio_sql(f"SELECT variant, o_orderpriority, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT o_orderpriority, {_OW} AS w, unnest(CASE WHEN o_orderstatus = 'F' THEN ['all', 'f'] ELSE ['all'] END) AS variant FROM orders) GROUP BY 1, 2", "variant, o_orderpriority", "PARTITION BY variant"))
def order_ratio_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    named = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "f")))
    return R.share_table(o.withColumn("variant", F.explode(named)), ["variant", "o_orderpriority"], ["variant"])


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.share_series(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "event_type", "day")


_SERIES = """WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT d.day, k.event_type FROM (SELECT DISTINCT day FROM c) d CROSS JOIN (SELECT DISTINCT event_type FROM c) k),
s AS (SELECT event_type, day, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY day) AS total, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS place FROM g LEFT JOIN c USING (event_type, day)),
y AS (SELECT *, n / total AS share FROM s)"""


@registry.add(f"{_SERIES} SELECT event_type, day, n::BIGINT AS n, total::BIGINT AS total, round(share, 6) AS share, place::INT AS place FROM y")
def daily_share_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled share of each type on each day."""
    return _series(spark, sf_dir).withColumn("share", r6(F.col("share")))


def _fit_sql(source: str, extra: str = "") -> str:
    return f"""{_SERIES}{extra},
f AS (SELECT event_type, count(*) AS n, regr_slope(share, place) AS slope, greatest(regr_syy(share, place) - regr_sxy(share, place) ^ 2 / regr_sxx(share, place), 0) AS rss, regr_sxx(share, place) AS sxx FROM {source} GROUP BY 1),
e AS (SELECT *, CASE WHEN n > 2 THEN sqrt(rss / (n - 2) / sxx) END AS se FROM f)
SELECT event_type, n::BIGINT AS n, round(slope, 9) AS slope, round(se, 9) AS se, round(CASE WHEN se > 0 THEN slope / se WHEN se = 0 THEN 0 END, 4) AS t FROM e"""


def _rounded_fit(df: DataFrame) -> DataFrame:
    return df.select("event_type", "n", F.round("slope", 9).alias("slope"), F.round("se", 9).alias("se"), F.round("t", 4).alias("t"))


@registry.add(_fit_sql("y"))
def trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares slope of the daily shares, with its error."""
    return _rounded_fit(S.fit(_series(spark, sf_dir), "event_type"))


@registry.add(_fit_sql("z", ", z AS (SELECT event_type, share, place - 1 AS place FROM y WHERE place > 0 AND place < (SELECT max(place) FROM y))"))
def trend_fit_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit without the first and last, partial, days."""
    return _rounded_fit(S.fit(S.without_ends(_series(spark, sf_dir), "event_type"), "event_type"))


@registry.add(
    f"""WITH a AS ({registry.sql["window_share_ratio"]}), b AS ({_fit_sql("y")}), z AS ({registry.sql["trend_fit_trimmed"]}),
j AS (SELECT a.event_type, a.label, sign(b.slope)::INT AS sign, sign(z.slope)::INT AS inner_sign FROM a JOIN b USING (event_type) JOIN z USING (event_type))
SELECT event_type, label, sign, (label = 'rising' AND sign < 0) OR (label = 'declining' AND sign > 0) AS contradicts, (label = 'rising' AND inner_sign < 0) OR (label = 'declining' AND inner_sign > 0) AS contradicts_inner FROM j"""
)
def trend_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the sign of the fit, over all or over the whole buckets, contradict the window label?"""
    a, b, z = window_share_ratio(spark, sf_dir), trend_fit(spark, sf_dir), trend_fit_trimmed(spark, sf_dir)
    j = a.join(b.select("event_type", stats.slope_sign(F.col("slope")).alias("sign")), "event_type").join(z.select("event_type", stats.slope_sign(F.col("slope")).alias("inner")), "event_type")
    return j.select("event_type", "label", "sign", stats.contradicts(F.col("label"), F.col("sign")).alias("contradicts"), stats.contradicts(F.col("label"), F.col("inner")).alias("contradicts_inner"))


@registry.add(
    """WITH c AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT d.month, k.o_orderstatus FROM (SELECT DISTINCT month FROM c) d CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) k),
s AS (SELECT o_orderstatus, month, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY month) AS total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) - 1 AS last FROM g LEFT JOIN c USING (o_orderstatus, month)),
p AS (SELECT *, sum(n) FILTER (place > 0 AND place < last) OVER (PARTITION BY o_orderstatus) / sum(total) FILTER (place > 0 AND place < last) OVER (PARTITION BY o_orderstatus) AS pooled FROM s)
SELECT o_orderstatus, month, n::BIGINT AS n, total::BIGINT AS total, round(pooled, 6) AS pooled, round(CASE WHEN total * pooled * (1 - pooled) > 0 THEN (n - total * pooled) / sqrt(total * pooled * (1 - pooled)) END, 6) AS z FROM p"""
)
def month_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months against the pooled share of the whole months."""
    z = S.pooled_z_scores(S.share_series(orders(spark, sf_dir), "o_orderstatus", "month"), "o_orderstatus")
    return z.select("o_orderstatus", "month", "n", "total", r6(F.col("pooled")).alias("pooled"), r6(F.col("z")).alias("z"))


@registry.add(
    ratio_sql(
        f"""SELECT k.o_orderpriority, m.month AS left_out, count(*) FILTER (o.w = 'trailing' AND o.month <> m.month) AS t, count(*) FILTER (o.w = 'preceding' AND o.month <> m.month) AS p
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) m CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) k JOIN (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, {_OW} AS w FROM orders) o ON o.o_orderpriority = k.o_orderpriority GROUP BY 1, 2""",
        "o_orderpriority, left_out",
        "PARTITION BY left_out",
    )
)
def leave_one_bucket_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share table without each month in turn."""
    return S.leave_one_out(orders(spark, sf_dir), "o_orderpriority", "month", "window")


_KEPT = "CASE WHEN strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders) THEN 1 ELSE 0 END AS in_last, CASE WHEN o_orderdate::DATE < DATE '1995-07-01' THEN 1 ELSE 0 END AS in_first"


@registry.add(
    "WITH t AS ("
    + ratio_sql(
        f"""SELECT variant, o_orderpriority, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT o_orderpriority, {_OW} AS w, unnest(list_filter(['base', CASE WHEN in_last = 0 THEN 'without_last' END, CASE WHEN in_first = 0 THEN 'without_first' END, CASE WHEN in_last + in_first = 0 THEN 'without_both' END], lambda x: x IS NOT NULL)) AS variant FROM (SELECT *, {_KEPT} FROM orders)) GROUP BY 1, 2""",
        "variant, o_orderpriority",
        "PARTITION BY variant",
    )
    + ") SELECT a.variant, a.o_orderpriority, a.t, a.p, a.scope_t, a.scope_p, a.ratio, a.ci_low, a.ci_high, a.label, a.label <> b.label AS changed FROM t a JOIN t b ON a.o_orderpriority = b.o_orderpriority AND b.variant = 'base' WHERE a.variant <> 'base'"
)
def exclusion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share table without the last month, without the first weeks, and without both, against the whole one:
    each row counts for every variant that it belongs to, so the orders are read once."""
    o = orders(spark, sf_dir)
    last = o.agg(F.max("month").alias("last_month"))  # one row
    in_last, in_first = F.col("month") == F.col("last_month"), F.col("o_orderdate") < F.lit("1995-07-01").cast("timestamp")
    variants = F.array_compact(F.array(F.lit("base"), F.when(~in_last, "without_last"), F.when(~in_first, "without_first"), F.when(~in_last & ~in_first, "without_both")))
    t = R.share_table(o.crossJoin(F.broadcast(last)).withColumn("variant", F.explode(variants)), ["variant", "o_orderpriority"], ["variant"])
    base = t.where("variant = 'base'").select("o_orderpriority", F.col("label").alias("base_label"))
    out = t.where("variant <> 'base'").join(base, "o_orderpriority").withColumn("changed", F.col("label") != F.col("base_label"))
    return out.select("variant", "o_orderpriority", "t", "p", "scope_t", "scope_p", "ratio", "ci_low", "ci_high", "label", "changed")


@registry.add("SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS flagged, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS share FROM lineitem GROUP BY 1")
def quarter_dup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged share of each calendar quarter."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate")).alias("quarter"))
    flagged = F.count_if(F.col("l_returnflag") == "R")
    return li.agg(F.count("*").alias("n"), flagged.alias("flagged"), stats.safe_share(flagged, F.count("*")).alias("share"))


@registry.add("SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS flagged, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) END AS share FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def late_dup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged share of the late part; the date filter is pushed to the scan."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))
    flagged = F.count_if(F.col("l_returnflag") == "R")
    return li.agg(F.count("*").alias("n"), flagged.alias("flagged"), stats.safe_share(flagged, F.count("*")).alias("share"))


@registry.add(
    f"""WITH c AS (SELECT o_orderpriority, coalesce({_OW}, 'outside') AS w, o_orderstatus, o_totalprice FROM orders),
g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM c) CROSS JOIN (VALUES ('trailing'), ('preceding'), ('outside')) v(w))
SELECT g.o_orderpriority, g.w AS "window", count(c.w) AS n, count(*) FILTER (c.o_orderstatus = 'F') AS n_f, count(*) FILTER (c.o_orderstatus = 'O') AS n_o, count(*) FILTER (c.o_totalprice >= 200000) AS n_large FROM g LEFT JOIN c ON c.o_orderpriority = g.o_orderpriority AND c.w = g.w GROUP BY 1, 2"""
)
def bucket_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 A10: measures of every priority in every window, zeros included."""
    o = orders(spark, sf_dir).withColumn("window", F.coalesce("window", F.lit("outside")))
    c = o.groupBy("o_orderpriority", "window").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"), F.count_if(F.col("o_totalprice") >= 200000).alias("n_large"))
    grid = c.select("o_orderpriority").distinct().select("o_orderpriority", F.explode(F.array(*map(F.lit, ("trailing", "preceding", "outside")))).alias("window"))
    return grid.join(c, ["o_orderpriority", "window"], "left").fillna(0)


@registry.add(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER ({_OW} = 'trailing') AS n_trailing, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS mean_price, round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS urgent_share FROM orders GROUP BY 1")
def monthly_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each month in one aggregation."""
    o = orders(spark, sf_dir)
    return o.groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("window") == "trailing").alias("n_trailing"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), r6(F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("urgent_share"))


@registry.add(f"SELECT min(o_orderdate::DATE) FILTER ({_OW} = 'preceding') AS first_preceding, max(o_orderdate::DATE) FILTER ({_OW} = 'trailing') AS last_trailing, count(*) FILTER (day(o_orderdate) <= 7) AS first_week FROM orders")
def partial_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the windows really begin and end."""
    o = orders(spark, sf_dir)
    day = F.col("o_orderdate").cast("date")
    return o.agg(F.min(F.when(F.col("window") == "preceding", day)).alias("first_preceding"), F.max(F.when(F.col("window") == "trailing", day)).alias("last_trailing"), F.count_if(F.dayofmonth("o_orderdate") <= 7).alias("first_week"))


@registry.add(ratio_sql(f"SELECT o_orderpriority, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT *, {_OW} AS w FROM orders) GROUP BY 1", "o_orderpriority", "") + " WHERE t + p >= 30 ORDER BY ci_low DESC NULLS LAST, o_orderpriority LIMIT 3")
def fastest_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: keys with support, by the lower bound of their ratio."""
    t = R.share_table(orders(spark, sf_dir), ["o_orderpriority"]).where(F.col("t") + F.col("p") >= 30)
    return t.orderBy(F.col("ci_low").desc_nulls_last(), "o_orderpriority").limit(3)


@registry.add(f"SELECT o_custkey AS customer, count(*) FILTER ({_OW} = 'trailing') AS t, count(*) FILTER ({_OW} = 'preceding') AS p FROM orders GROUP BY 1 ORDER BY -(t + p), customer LIMIT 10")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 K2 A4: the most frequent keys, ties to the smaller."""
    o = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("customer")).agg(F.count_if(F.col("window") == "trailing").alias("t"), F.count_if(F.col("window") == "preceding").alias("p"))
    return o.orderBy(F.desc(F.col("t") + F.col("p")), "customer").limit(10)


@registry.add(f"WITH c AS (SELECT event_type, user_id % 20 AS grp, count(*) FILTER ({_W} = 'trailing') AS c_t, count(*) FILTER ({_W} = 'preceding') AS c_p FROM events GROUP BY ALL), n AS (SELECT *, sum(c_t) OVER (PARTITION BY event_type) AS n_t, sum(c_p) OVER (PARTITION BY event_type) AS n_p FROM c) SELECT event_type, grp, c_t, c_p, round(((c_t + 1) / (n_t + 1)) / ((c_p + 1) / (n_p + 1)), 6) AS over FROM n WHERE c_t + c_p >= 4 AND c_t >= 2")
def over_represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed over-representation in the trailing window."""
    e = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 20).alias("grp")).agg(F.count_if(F.col("window") == "trailing").alias("c_t"), F.count_if(F.col("window") == "preceding").alias("c_p"))
    w = Window.partitionBy("event_type")
    e = e.withColumn("n_t", F.sum("c_t").over(w)).withColumn("n_p", F.sum("c_p").over(w)).where("c_t + c_p >= 4 AND c_t >= 2")
    return e.select("event_type", "grp", "c_t", "c_p", r6(stats.over_representation(F.col("c_t"), F.col("n_t"), F.col("c_p"), F.col("n_p"))).alias("over"))


