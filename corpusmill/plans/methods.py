"""Label tables over two windows: four variants, method tables, trend rows, recounts, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as L
from ..functions import stats
from ..operators import shares as R
from .common import Registry, table
from .labels import _L, _SIZE_WINDOW, CATEGORY_SOURCES, LABELS, docs, labelled, size_window
from .shares import ratio_sql

registry = Registry()
VARIANTS = ("primary_full", "multi_full", "primary_category", "multi_category")

_XL = f"""{_L}, w AS (SELECT *, {_SIZE_WINDOW} AS win, source IN ('src1', 'src2', 'src3') AS in_category, CASE WHEN len(labels) = 0 THEN ['unclassified'] ELSE labels END AS named FROM l),
v AS (SELECT * FROM w WHERE win IS NOT NULL)"""


def _ratio_cte(source: str, key: str) -> str:
    """A share table whose scopes count records: ``source`` has key, variant, t, p, scope_t, scope_p."""
    return f"""r AS (SELECT *, CASE WHEN t > 0 AND p > 0 THEN (t / scope_t) / (p / scope_p) END AS ratio_, CASE WHEN t > 0 AND p > 0 THEN 1.96 * sqrt(1 / t + 1 / p + 1 / scope_t + 1 / scope_p) END AS se FROM ({source})),
b AS (SELECT *, exp(ln(ratio_) - se) AS lo, exp(ln(ratio_) + se) AS hi, CASE WHEN ratio_ >= 1.10 AND exp(ln(ratio_) - se) > 1 THEN 'rising' WHEN ratio_ <= 0.90 AND exp(ln(ratio_) + se) < 1 THEN 'declining' ELSE 'flat' END AS label FROM r)"""


_ONE = """SELECT '{v}' AS variant, key, count(*) FILTER (win = 'trailing') AS t, count(*) FILTER (win = 'preceding') AS p,
(SELECT count(*) FROM v WHERE win = 'trailing' AND ({c})) AS scope_t, (SELECT count(*) FROM v WHERE win = 'preceding' AND ({c})) AS scope_p FROM (SELECT win, {k} AS key FROM v WHERE {c}) GROUP BY key"""
_FOUR = " UNION ALL ".join(_ONE.format(v=f"{how}_{scope}", c="in_category" if scope == "category" else "true", k="named[1]" if how == "primary" else "unnest(named)") for scope in ("full", "category") for how in ("primary", "multi"))


def _in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labelled(spark, sf_dir).withColumn("window", size_window()).where("window IS NOT NULL")
    return x.select("doc_id", "window", F.col("source").isin(*CATEGORY_SOURCES).alias("in_category"), L.or_unclassified(F.col("labels")).alias("named"))


def _counted(rows: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """variant, key, t, p, scope_t, scope_p in one pass; keys: variant -> (does a row belong, its keys).  A row without a
    key counts the scope."""
    nothing = F.array().cast("array<struct<variant:string,key:string>>")

    def entries(variant: str, on: Column, named: Column) -> Column:
        own = F.transform(F.concat(named, F.array(F.lit(None).cast("string"))), lambda k: F.struct(F.lit(variant).alias("variant"), k.alias("key")))
        return F.when(on, own).otherwise(nothing)

    parts = [entries(v, on, named) for v, (on, named) in keys.items()]
    x = rows.select("window", F.explode(F.concat(*parts)).alias("x")).groupBy("x.variant", "x.key").agg(F.count_if(F.col("window") == "trailing").alias("t"), F.count_if(F.col("window") == "preceding").alias("p"))
    scope = Window.partitionBy("variant")
    for c in ("t", "p"):
        x = x.withColumn(f"scope_{c}", F.max(F.when(F.col("key").isNull(), F.col(c))).over(scope))
    return x.where("key IS NOT NULL")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, first = _in_windows(spark, sf_dir), F.slice("named", 1, 1)
    on = {"full": F.coalesce(F.lit(True), F.lit(True)), "category": F.coalesce("in_category", F.lit(False))}
    return R.with_ratios(_counted(rows, {f"{how}_{scope}": (on[scope], first if how == "primary" else F.col("named")) for scope in on for how in ("primary", "multi")}))


@registry.add(f"{_XL}, {_ratio_cte(_FOUR, 'key')} SELECT variant, key, t, p, scope_t, scope_p, round(ratio_, 6) AS ratio, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, label FROM b")
def label_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table by first or by all labels, in the full scope or in that of the category."""
    return _variants(spark, sf_dir).select("variant", "key", "t", "p", "scope_t", "scope_p", "ratio", "ci_low", "ci_high", "label")


@registry.add(f"{_XL}, {_ratio_cte(_FOUR, 'key')} SELECT key, string_agg(variant || '=' || label, ',' ORDER BY variant) AS labels FROM b GROUP BY key HAVING count(DISTINCT label) > 1")
def label_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose trend label is not the same in all variants."""
    return R.label_flips(_variants(spark, sf_dir), "key", "variant")


_KIND = "CASE key " + " ".join(f"WHEN '{r.key}' THEN '{r.kind or 'language'}'" for r in LABELS.rules) + " ELSE 'none' END"
_MULTI = _ONE.format(v="multi_full", c="true", k="unnest(named)")


def _method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for r in LABELS.rules for x in (r.key, r.kind or "language")])
    t = R.with_ratios(_counted(_in_windows(spark, sf_dir), {"multi_full": (F.coalesce(F.lit(True), F.lit(True)), F.col("named"))}))
    return t.select("key", F.coalesce(F.try_element_at(kinds, F.col("key")), F.lit("none")).alias("kind"), "t", "p", "scope_t", "scope_p", "ratio", "ci_low", "ci_high")


@registry.add(f"{_XL}, {_ratio_cte(_MULTI, 'key')} SELECT key, {_KIND} AS kind, t, p, round(t / scope_t, 4) AS share_t, round(p / scope_p, 4) AS share_p, round(ratio_, 3) AS ratio, round(lo, 3) AS ci_low, round(hi, 3) AS ci_high, coalesce(lo > 1 OR hi < 1, false) AS ci_excludes_1, row_number() OVER (ORDER BY t DESC, key)::INT AS place FROM b")
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares, ratios and intervals of each label, and whether the interval leaves out 1, by trailing count."""
    t = _method_table(spark, sf_dir)
    out = F.coalesce((F.col("ci_low") > 1) | (F.col("ci_high") < 1), F.lit(False)).alias("ci_excludes_1")
    place = F.row_number().over(Window.orderBy(F.desc("t"), "key")).alias("place")  # a row a label
    return t.select("key", "kind", "t", "p", stats.safe_share(F.col("t"), F.col("scope_t")).alias("share_t"), stats.safe_share(F.col("p"), F.col("scope_p")).alias("share_p"), *[F.round(c, 3).alias(c) for c in ("ratio", "ci_low", "ci_high")], out, place)


@registry.add(f"{_XL}, {_ratio_cte(_MULTI, 'key')}, k AS (SELECT key, {_KIND} AS kind, t, ratio_ FROM b), f AS (SELECT 'fastest' AS pick, key, 1 AS place FROM k WHERE t >= 30 AND ratio_ IS NOT NULL ORDER BY round(ratio_, 6) DESC, key LIMIT 1), o AS (SELECT kind AS pick, key, row_number() OVER (PARTITION BY kind ORDER BY t DESC, key)::INT AS place FROM k WHERE kind IN ('form', 'style')) SELECT * FROM o WHERE place <= 4 UNION ALL SELECT pick, key, place FROM f")
def exemplar_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commonest labels of each kind, and the label of the greatest share ratio with support of 30."""
    t = _method_table(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("t"), "key"))
    top = t.where(F.col("kind").isin("form", "style")).select(F.col("kind").alias("pick"), "key", place.alias("place")).where("place <= 4")
    best = t.where("t >= 30 AND ratio IS NOT NULL").orderBy(F.desc("ratio"), "key").limit(1)
    return top.unionByName(best.select(F.lit("fastest").alias("pick"), "key", F.lit(1).alias("place")))


WATCHED = ("insults", "contact", "german", "nowhere")
_NAMES = "(VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(WATCHED, 1)) + ") n(place, key)"


@registry.add(f"{_XL}, {_ratio_cte(_MULTI, 'key')} SELECT n.place::INT AS place, n.key, coalesce(t, 0)::BIGINT AS t, coalesce(p, 0)::BIGINT AS p, round(ratio_, 3) AS ratio, round(lo, 3) AS ci_low, round(hi, 3) AS ci_high FROM {_NAMES} LEFT JOIN b ON b.key = n.key")
def trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each label of a list, in its order, zeros and nulls where it never occurs."""
    names = spark.createDataFrame(list(enumerate(WATCHED, 1)), "place int, key string")
    t = _method_table(spark, sf_dir)
    return names.join(t, "key", "left").select("place", "key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "p")], *[F.round(c, 3).alias(c) for c in ("ratio", "ci_low", "ci_high")])


@registry.add(f"{_XL}, {_ratio_cte(_ONE.format(v='primary_full', c='true', k='named[1]'), 'key')}, k AS (SELECT key, t, p, row_number() OVER (ORDER BY t + p DESC, key) AS r FROM b) SELECT key, t, p FROM k WHERE r <= 4 OR key IN ('insults', 'shouting')")
def top_labels_and_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commonest labels over both windows, and two that are named."""
    t = _variants(spark, sf_dir).where("variant = 'primary_full'").select("key", "t", "p")
    top = t.orderBy(F.desc(F.col("t") + F.col("p")), "key").limit(4)
    return top.unionByName(t.where(F.col("key").isin("insults", "shouting"))).distinct()


def _by_cases() -> Column:
    """The first label by a chain of cases, written apart from the rule sets on purpose."""
    text, regular, rest = F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(LABELS.rules):
        hit = (F.regexp_count(text, F.lit(r.pattern)) > 0) & (F.regexp_count(text, F.lit(r.exclude)) == 0 if r.exclude else F.lit(True))
        if r.residual:
            rest = F.when(hit, r.key).otherwise(rest)
        else:
            regular = F.when(hit, r.key).otherwise(regular)
    return F.coalesce(regular, rest, F.lit("unclassified"))


def recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second implementation of the table of first labels: other expressions, plain sums, observed labels only, and
    n/a where a count is zero."""
    rows = docs(spark, sf_dir).select(_by_cases().alias("key"), "n_chars").where("n_chars >= 500")
    trailing = F.when(F.col("n_chars") >= 1500, 1).otherwise(0)
    per = rows.groupBy("key").agg(F.sum(trailing).alias("t"), F.sum(1 - trailing).alias("p"))
    whole = Window.partitionBy(F.lit(1))
    t, p, st, sp = (F.col(c).cast("double") for c in ("t", "p", "st", "sp"))
    per = per.withColumn("st", F.sum("t").over(whole)).withColumn("sp", F.sum("p").over(whole)).withColumn("known", (F.col("t") > 0) & (F.col("p") > 0))
    log = F.log(t) - F.log(st) - F.log(p) + F.log(sp)
    half = F.lit(stats.Z95) * F.sqrt(F.pow(t, F.lit(-1)) + F.pow(p, F.lit(-1)) + F.pow(st, F.lit(-1)) + F.pow(sp, F.lit(-1)))
    per = per.withColumn("log", F.when(F.col("known"), log)).withColumn("half", F.when(F.col("known"), half))
    label = F.when(~F.col("known"), "n/a").when((F.exp("log") >= 1.1) & (F.col("log") > F.col("half")), "rising").when((F.exp("log") <= 0.9) & (F.col("log") < -F.col("half")), "declining").otherwise("flat")
    return per.select("key", "t", "p", F.round(F.exp("log"), 6).alias("ratio"), F.round(F.exp(F.col("log") - F.col("half")), 6).alias("ci_low"), F.round(F.exp(F.col("log") + F.col("half")), 6).alias("ci_high"), label.alias("label"))


_PRIMARY = _ONE.format(v="primary_full", c="true", k="named[1]")


@registry.add(f"{_XL}, {_ratio_cte(_PRIMARY, 'key')} SELECT key, t, p, round(ratio_, 6) AS ratio, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, CASE WHEN t = 0 OR p = 0 THEN 'n/a' ELSE label END AS label FROM b")
def independent_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recount of the table of first labels."""
    return recount(spark, sf_dir)


@registry.add(f"{_XL}, {_ratio_cte(_PRIMARY, 'key')}, a AS (SELECT CASE key WHEN 'german' THEN 'germans' ELSE key END AS key, t + CASE WHEN key = 'english' THEN 5 ELSE 0 END AS t FROM b WHERE key <> 'insults') SELECT coalesce(a.key, b.key) AS key, a.t AS left_value, b.t AS right_value, CASE WHEN b.t IS NULL THEN 'missing' WHEN a.t IS NULL THEN 'extra' ELSE 'value' END AS mismatch FROM a FULL JOIN b ON a.key = b.key WHERE a.t IS NULL OR b.t IS NULL OR abs(a.t - b.t) > 0.01")
def recount_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table with three errors (a wrong count, a wrong name, a lost row) held against the recount."""
    t = _variants(spark, sf_dir).where("variant = 'primary_full' AND key <> 'insults'")
    t = t.select(F.when(F.col("key") == "german", "germans").otherwise(F.col("key")).alias("key"), (F.col("t") + F.when(F.col("key") == "english", 5).otherwise(0)).alias("t"))
    return R.two_sided_diff(t, recount(spark, sf_dir), "key", "t", 0.01)


@registry.add("SELECT s_name AS author, count(*) AS n FROM (SELECT arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first FROM lineitem GROUP BY l_orderkey) JOIN supplier ON s_suppkey = first GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def top_first_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest first names of ordered lists (the supplier of an order's first line)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("first"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("author"))
    counts = li.groupBy(F.col("first.l_suppkey").alias("k")).agg(F.count("*").alias("n")).join(s, "k").groupBy("author").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "author").limit(10)


@registry.add(f"{_L} SELECT label, source, count(*) AS n FROM x JOIN labels g USING (doc_id) WHERE g.quality = 1 GROUP BY 1, 2")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by server of the records whose ids are wanted."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    x = labelled(spark, sf_dir).join(wanted, "doc_id").select("source", F.explode(L.or_unclassified(F.col("labels"))).alias("label"))
    return x.groupBy("label", "source").agg(F.count("*").alias("n"))


@registry.add(f"{_L}, w AS (SELECT *, coalesce({_SIZE_WINDOW}, 'outside') AS win FROM l) SELECT win AS \"window\", coalesce(labels[1], 'unclassified') AS label, count(*) AS n FROM w GROUP BY 1, 2")
def live_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made while scanning, all windows; no window is 'outside', and rows are not deduplicated."""
    rows = docs(spark, sf_dir).select(F.coalesce(size_window(), F.lit("outside")).alias("window"), F.explode(F.array(LABELS.labels(F.col("text")))).alias("labels"))
    return rows.groupBy("window", F.coalesce(L.primary(F.col("labels")), F.lit("unclassified")).alias("label")).agg(F.count("*").alias("n"))
