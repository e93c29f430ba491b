"""Dedup, version collapse, joins, set operations, rates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import dedup as D
from ..operators import ranking, scoring
from ..operators import simjoin as J
from .common import Registry, r6, spread, table

registry = Registry()


@registry.add("SELECT arg_min(doc_id, doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each text; texts are compared by digest in the shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@registry.add("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::DATE AS day FROM orders GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the last row of each key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return D.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


_VERSIONS = """v0 AS (SELECT l_orderkey AS work, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN NULL ELSE l_linenumber END AS version, CASE WHEN l_partkey % 9 > 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS date, CASE WHEN l_linenumber % 2 = 0 THEN 'part ' || l_partkey::VARCHAR ELSE '' END AS title, l_returnflag AS term, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
v AS (SELECT * REPLACE (CASE WHEN version IS NULL AND n > 1 THEN 1 ELSE version END AS version), coalesce(nullif(date, ''), '9999') AS d FROM v0)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    version = F.when(~((n == 1) & (F.col("l_orderkey") % 2 == 0)), n)
    date = F.when(F.col("l_partkey") % 9 > 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("")
    return li.select(F.col("l_orderkey").alias("work"), version.alias("version"), date.alias("date"), F.when(n % 2 == 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).otherwise("").alias("title"), F.array("l_returnflag").alias("terms"))


@registry.add(
    f"""WITH {_VERSIONS},
c AS (SELECT work, arg_min({{'v': version, 't': title}}, (CASE WHEN version = 1 THEN 0 ELSE 1 END, d, coalesce(version, 0), title)) AS chosen, arg_max(title, (coalesce(version, 0), title)) AS latest, min(nullif(date, '')) AS date, count(*) AS n_versions, list(coalesce(version, 0) ORDER BY coalesce(version, 0)) AS versions, list(term ORDER BY d, coalesce(version, 0), term) AS terms FROM v GROUP BY 1)
SELECT work, chosen.v AS version, coalesce(nullif(chosen.t, ''), latest) AS title, date, n_versions, array_to_string(versions, ',') AS versions, array_to_string(list_sort(list_distinct(terms)), ',') AS all_terms FROM c"""
)
def version_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a work from its versions; a row without a number among others is version 1."""
    out = D.collapse_versions(_versions(spark, sf_dir), "work", "version", "date", ("title",), ("terms",))
    return out.select("work", "version", "title", "date", "n_versions", F.array_join("versions", ",").alias("versions"), F.array_join(F.array_sort("terms"), ",").alias("all_terms"))


@registry.add(
    """WITH v AS (SELECT l_orderkey AS work, l_linenumber AS version FROM lineitem WHERE NOT (l_linenumber = 1 AND l_orderkey % 3 > 0)),
g AS (SELECT work, CASE WHEN work % 2 = 0 THEN '-' ELSE '/' END AS sep, count(*) FILTER (version = 1) AS ones FROM v GROUP BY 1),
w AS (SELECT DISTINCT o_orderkey AS work, CASE o_orderkey % 5 WHEN 0 THEN 'w' || o_orderkey::VARCHAR ELSE 'w' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '/' END || 'v1' END AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)
SELECT 'w' || g.work::VARCHAR AS work, w.id, w.date FROM g JOIN w USING (work) WHERE g.ones = 0 AND (w.id LIKE '%v1' OR g.sep = '-')"""
)
def first_version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of works that lack it, from a table of single works: under 'v1', or with '-' under the bare id."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    v = li.where(~((F.col("l_linenumber") == 1) & (k % 3 > 0))).select(F.concat(F.lit("w"), k.cast("string")).alias("work"), F.col("l_linenumber").alias("version"), F.when(k % 2 == 0, "-").otherwise("/").alias("sep"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    bare = F.concat(F.lit("w"), k.cast("string"))
    works = o.select(F.when(k % 5 == 0, bare).otherwise(F.concat(bare, F.when(k % 2 == 0, "-").otherwise("/"), F.lit("v1"))).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).distinct()
    return D.fetched_first_versions(v, works, "work", "version", "sep", "id")


@registry.add("SELECT l_partkey AS concept, max(l_orderkey * 8 + l_linenumber) AS record, arg_max(l_quantity, l_orderkey * 8 + l_linenumber) AS quantity, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS terms FROM lineitem GROUP BY 1")
def highest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest record of each concept, with the terms of all."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record"), F.col("l_quantity").alias("quantity"), F.array("l_returnflag").alias("terms"))
    out = D.highest_record(li, "concept", "record", "terms")
    return out.withColumn("terms", F.array_join(F.array_sort("terms"), ","))


_LANES = "SELECT 'c' || c_custkey AS key, c_nationkey::VARCHAR || ':' || c_mktsegment || ':' || (c_custkey % 7)::VARCHAR AS identity, c_custkey % 5 AS lane FROM customer"


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(F.concat(F.lit("c"), k.cast("string")).alias("key"), F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment", (k % 7).cast("string")).alias("identity"), (k % 5).alias("lane"))


@registry.add(f"WITH l AS ({_LANES}), n AS (SELECT identity, arg_min(key, (lane, key)) AS canonical FROM l GROUP BY 1) SELECT DISTINCT l.key AS alias, n.canonical FROM l JOIN n USING (identity) WHERE l.key <> n.canonical")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lane names a thing, other keys become aliases."""
    return D.merge_identities(_lanes(spark, sf_dir), "identity", "key", "lane")[1]


@registry.add("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' || n_nationkey::VARCHAR ELSE n_name END AS n_name, n_nationkey % 3 = 0 AS edited FROM nation")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded edits; those that name another old value have no effect."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    edits = n.where(k % 3 < 2).select("n_nationkey", F.when(k % 3 == 0, F.col("n_name")).otherwise("other").alias("old"), F.concat(F.lit("new"), k.cast("string")).alias("new"))
    return D.apply_edits(n, edits, "n_nationkey", "n_name")


_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", norm.alias("norm"))


@registry.add(f"WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents), f AS (SELECT norm, min(doc_id) AS first FROM n GROUP BY 1) SELECT n.doc_id AS query, f.first AS match FROM n JOIN f USING (norm) WHERE n.doc_id <> f.first")
def exact_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, its exact half: equal normalised texts."""
    n = _normed(spark, sf_dir).select("doc_id", F.sha2("norm", 256).alias("norm"))
    f = n.groupBy("norm").agg(F.min("doc_id").alias("match"))
    return n.join(f, "norm").where(F.col("doc_id") != F.col("match")).select(F.col("doc_id").alias("query"), "match")


@registry.add(
    f"""WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents), f AS (SELECT norm, min(doc_id) AS doc_id FROM n GROUP BY 1),
e AS (SELECT n.doc_id AS query, f.doc_id AS match, 'exact' AS how, 1.0::DOUBLE AS jaccard FROM n JOIN f USING (norm) WHERE n.doc_id <> f.doc_id),
s AS (SELECT doc_id, list_distinct(string_split(norm, ' ')) AS k FROM f), z AS (SELECT doc_id, k, len(k) AS n FROM s),
p AS (SELECT a.doc_id AS query, b.doc_id AS match, len(list_intersect(a.k, b.k)) AS o, a.n AS n, b.n AS m FROM z a JOIN z b ON a.doc_id <> b.doc_id AND a.n >= 4 AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n),
w AS (SELECT query, match, o / (n + m - o) AS jaccard, row_number() OVER (PARTITION BY query ORDER BY o / (n + m - o) DESC, match) AS r FROM p WHERE o / (n + m - o) >= 0.8)
SELECT * FROM e UNION ALL SELECT query, match, 'near' AS how, round(jaccard, 6) AS jaccard FROM w WHERE r = 1"""
)
def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, else the nearest by token sets at 0.8, with prefix filtering."""
    n = _normed(spark, sf_dir).withColumn("tokens", F.split("norm", " "))
    return J.best_matches(n, "doc_id", "norm", "tokens").withColumn("jaccard", r6(F.col("jaccard")))


_TOK = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))"


@registry.add(f"WITH q AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents), i AS (SELECT item_id, unnest({_TOK}) AS t, len({_TOK}) AS size FROM benchmark) SELECT doc_id, item_id, round(count(*) / size, 6) AS share FROM q JOIN i USING (t) GROUP BY doc_id, item_id, size HAVING count(*) >= 0.8 * size")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item's words."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("tokens"))
    return J.contained(d, b, "doc_id", "item_id", "tokens", 0.8).withColumn("share", r6(F.col("share")))


@registry.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without a counterpart."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@registry.add("SELECT source, count(*) AS found FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def semi_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a counterpart, by source."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("found"))


@registry.add("SELECT d.doc_id, coalesce(d.source, '') AS source, coalesce(l.quality::VARCHAR, '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join of all documents, missing values as the empty string."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "quality")])


@registry.add("SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join in which a missing counterpart is an error."""
    j = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("n_chars").isNull(), F.raise_error(F.lit("a label has no document")).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@registry.add("SELECT l_suppkey * 1000000 + l_partkey AS cited, count(*) AS lines FROM lineitem WHERE l_suppkey * 1000000 + l_partkey NOT IN (SELECT s_suppkey * 1000000 + p_partkey FROM part, supplier WHERE p_partkey % 7 = s_suppkey % 7) GROUP BY 1")
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, of all lines, to what isn't there (parts by suppliers of another seventh), counted before the
    join."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 7).alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 7).alias("kind"))
    li = li.withColumn("kind", F.col("l_suppkey") % 7)
    gone = li.join(p, ["l_partkey", "kind"], "left_anti").unionByName(li.join(p, ["l_partkey", "kind"], "left_semi").join(s, ["l_suppkey", "kind"], "left_anti"))
    return gone.select((F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("cited"), "lines")


@registry.add("SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1-O3: union of tables of different columns."""
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@registry.add("(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two multisets of ids don't share; empty if they are equal."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@registry.add("WITH d AS (SELECT o_orderpriority, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_orderpriority, count(*) AS n, (list_sort(list(days)))[count(*) // 2 + 1]::INT AS upper_median, round(count(*) FILTER (days > 0) / count(*), 4) AS positive, min(days)::INT AS least, max(days)::INT AS most FROM d GROUP BY 1")
def lead_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead days; the upper median comes from counts per day value, never from a list of all rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("a"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("b"))
    days = li.join(o, "o_orderkey").groupBy("o_orderpriority", F.datediff("b", "a").alias("days")).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy("o_orderpriority").orderBy("days"))
    whole = F.sum("c").over(Window.partitionBy("o_orderpriority"))
    days = days.withColumn("upto", run).withColumn("n", whole)
    return days.groupBy("o_orderpriority").agg(F.sum("c").alias("n"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("days"))).alias("upper_median"), stats.safe_share(F.sum(F.when(F.col("days") > 0, F.col("c")).otherwise(0)), F.sum("c")).alias("positive"), F.min("days").alias("least"), F.max("days").alias("most"))


_WIL = """p AS (SELECT *, s / n AS r FROM g), w AS (SELECT *, (r + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(r * (1 - r) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM p)"""


@registry.add(f"WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS s, count(*) FILTER (toxic = 1) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1), {_WIL} SELECT lang, n, s AS good, round(s / n, 4) AS rate, round(greatest(0, mid - half), 3) AS low, round(least(1, mid + half), 3) AS high, t AS toxic FROM w")
def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates with Wilson intervals."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    low, high = stats.wilson_bounds(F.col("good"), F.col("n"))
    return g.select("lang", "n", "good", stats.safe_share(F.col("good"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"), "toxic")


@registry.add("WITH d AS (SELECT source, count(*) AS n, 1 - count(DISTINCT text) / count(*) AS dup FROM documents GROUP BY 1), q AS (SELECT source, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, n, round(dup, 6) AS dup, round(rate, 6) AS rate, round(n * (1 - dup) * rate, 1) AS estimate FROM d JOIN q USING (source)")
def unique_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are neither copies nor bad, estimated."""
    d = table(spark, sf_dir, "documents")
    digest = F.md5(F.col("text").cast("binary"))
    n = d.groupBy("source").agg(F.count("*").alias("n"), (1 - F.count_distinct(digest) / F.count("*")).alias("dup"))
    rate = table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("rate"))
    return n.join(rate, "source").select("source", "n", r6(F.col("dup")).alias("dup"), r6(F.col("rate")).alias("rate"), stats.unique_estimate(F.col("n"), F.col("dup"), F.col("rate")).alias("estimate"))


@registry.add("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT CASE WHEN c_nationkey < 5 THEN 'ORIGINAL' ELSE c_nationkey::VARCHAR END) AS groups FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def distinct_groups_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups counted with some of them merged."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    group = F.when(F.col("c_nationkey") < 5, "ORIGINAL").otherwise(F.col("c_nationkey").cast("string"))
    return o.join(c, "o_custkey").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"))


_FEATURES = [
    ("f1", "CASE WHEN quality = 0 THEN 2 ELSE 0 END", "'quality'"),
    ("f2", "CASE WHEN toxic = 1 THEN 2 ELSE 0 END", "'toxic'"),
    ("f3", "CASE WHEN regexp_matches(text, '[#$%&*]{3}|!!') THEN 1 ELSE 0 END", "'junk'"),
    ("f4", "CASE WHEN n_chars < 100 THEN 1 ELSE 0 END", "n_chars::VARCHAR"),
    ("f5", "CASE WHEN source = 'src0' THEN -1 ELSE 0 END", "source"),
]


@registry.add("WITH f AS (SELECT doc_id, " + ", ".join(f"{p} AS {n}, {e} AS {n}e" for n, p, e in _FEATURES) + " FROM documents JOIN labels USING (doc_id)), s AS (SELECT *, " + " + ".join(n for n, _, _ in _FEATURES) + " AS total FROM f) SELECT doc_id, total::INT AS score, CASE WHEN total >= 3 THEN 'noisy' WHEN f2 > 0 THEN 'watch' ELSE 'ok' END AS verdict, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} <> 0 THEN '{n}:' || {n}::VARCHAR || ':' || {n}e END" for n, _, _ in _FEATURES) + "], lambda x: x IS NOT NULL), '; ') AS evidence FROM s")
def rule_score_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of five features with their evidence, and the verdict."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    on = lambda c, n: F.when(c, n).otherwise(0)
    features = [
        scoring.feature("f1", on(F.col("quality") == 0, 2), F.lit("quality")),
        scoring.feature("f2", on(F.col("toxic") == 1, 2), F.lit("toxic")),
        scoring.feature("f3", on(F.col("text").rlike("[#$%&*]{3}|!!"), 1), F.lit("junk")),
        scoring.feature("f4", on(F.col("n_chars") < 100, 1), F.col("n_chars").cast("string")),
        scoring.feature("f5", on(F.col("source") == "src0", -1), F.col("source")),
    ]
    return scoring.scored(j, features, 3, "f2").select("doc_id", "score", "verdict", scoring.evidence_text(F.col("features")).alias("evidence"))


@registry.add("WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS rank FROM documents) SELECT lang, doc_id, rank::INT AS rank FROM d WHERE rank <= 15")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: fifteen documents a language, by a seeded hash."""
    return ranking.hash_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 42, 15)


@registry.add()
def seeded_sample_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the same by Python's generator, bit for bit; null is a language too."""
    return ranking.twister_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 42, 15)


@registry.add()
def seeded_shuffle_mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the first five of a seeded shuffle, bit for bit; null is a language too."""
    return ranking.twister_shuffle(table(spark, sf_dir, "documents"), "lang", "doc_id", 7, 5)


_LEVELS = ("L1", "L2", "L3", "L4")


@registry.add(
    "WITH c AS (SELECT coalesce(split_part(p_type, ' ', 1), '') AS stage, 'L' || (p_size % 4 + 1)::VARCHAR AS level, p_brand FROM part), d AS (SELECT DISTINCT * FROM c) SELECT coalesce(stage, 'all') AS stage, "
    + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT p_brand) FILTER (level = '{x}')), ','), '') AS {x}" for x in _LEVELS)
    + ", (SELECT count(*) FROM c WHERE coalesce(c.stage = d.stage, true)) AS n, count(DISTINCT p_brand) AS brands FROM d GROUP BY ROLLUP (stage)"
)
def stage_autonomy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage by level, each cell the sorted names in it, with totals; names are distinct before they are listed."""
    p = table(spark, sf_dir, "part").select(F.coalesce(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("")).alias("stage"), F.concat(F.lit("L"), (F.col("p_size") % 4 + 1).cast("string")).alias("level"), "p_brand")
    few = p.groupBy("stage", "level", "p_brand").agg(F.count("*").alias("c"))
    cells = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("level") == x, F.col("p_brand")))), ",").alias(x) for x in _LEVELS]
    out = few.rollup("stage").agg(*cells, F.sum("c").alias("n"), F.count_distinct("p_brand").alias("brands"))
    return out.withColumn("stage", F.coalesce("stage", F.lit("all")))


@registry.add("SELECT p_partkey, row_number() OVER (ORDER BY list_position(['PROMO', 'ECONOMY', 'STANDARD'], upper(split_part(p_type, ' ', 1))) NULLS LAST, CASE WHEN p_size % 7 = 0 THEN 9999 ELSE p_size END, lower(p_name), p_partkey)::INT AS place FROM part")
def catalog_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: catalogue order: known stages first, then year (9999 if it is none), then name.

    Places come from a count for each stage and year and ranks within them, so no task sorts the whole table."""
    stage = F.nullif(F.array_position(F.array(*map(F.lit, ("PROMO", "ECONOMY", "STANDARD"))), F.upper(F.split_part("p_type", F.lit(" "), F.lit(1)))), F.lit(0).cast("long"))
    year = F.coalesce(F.when(F.col("p_size") % 7 == 0, "n.d.").otherwise(F.col("p_size").cast("string")).try_cast("int"), F.lit(9999))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.coalesce(stage, F.lit(99)).alias("stage"), year.alias("year"))
    groups = rows.groupBy("stage", "year").agg(F.count("*").alias("n"))  # stages x years
    before = groups.withColumn("before", F.sum("n").over(Window.orderBy("stage", "year")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("stage", "year").orderBy("name", "p_partkey"))
    return rows.withColumn("within", within).join(before, ["stage", "year"]).select("p_partkey", (F.col("before") + F.col("within")).cast("int").alias("place"))


_CAP = 100


@registry.add(
    f"""WITH t AS (SELECT 'b' || (user_id % 8)::VARCHAR AS server, event_type AS term, count(*) AS total, least(count(*), {_CAP}) AS fetched FROM events GROUP BY ALL),
k AS (SELECT server, term, count(*) FILTER (value >= 50) AS kept FROM (SELECT 'b' || (user_id % 8)::VARCHAR AS server, event_type AS term, value, row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= {_CAP} GROUP BY ALL),
j AS (SELECT *, total > fetched AND fetched >= {_CAP} AS truncated, row_number() OVER (PARTITION BY server ORDER BY kept DESC, term) AS rank FROM t JOIN k USING (server, term))
SELECT server, sum(total)::BIGINT AS total, sum(fetched)::BIGINT AS fetched, sum(kept)::BIGINT AS kept, round(sum(kept) / sum(fetched), 4) AS ratio, coalesce(string_agg(term, ',' ORDER BY term) FILTER (truncated), '') AS truncated, string_agg(term || ':' || kept::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3 AND kept > 0) AS top_terms FROM j GROUP BY 1"""
)
def yield_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each server and term up to a cap, truncation flags, what was kept, and the best terms."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 8).cast("string")).alias("server"), F.col("event_type").alias("term"), "ts", "event_id", "value")
    t = e.groupBy("server", "term").agg(F.count("*").alias("total"))
    t = t.withColumn("fetched", F.least("total", F.lit(_CAP))).withColumn("truncated", (F.col("total") > F.col("fetched")) & (F.col("fetched") >= _CAP))
    first = ranking.top_per_group(e, ["server", "term"], [F.col("ts"), F.col("event_id")], _CAP)
    j = t.join(first.groupBy("server", "term").agg(F.count_if(F.col("value") >= 50).alias("kept")), ["server", "term"])
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy("server").orderBy(F.desc("kept"), "term")))  # the terms of a server are few
    best = F.when((F.col("rank") <= 3) & (F.col("kept") > 0), F.struct("rank", F.concat_ws(":", "term", F.col("kept").cast("string")).alias("t")))
    return j.groupBy("server").agg(
        *[F.sum(c).alias(c) for c in ("total", "fetched", "kept")],
        stats.safe_share(F.sum("kept"), F.sum("fetched")).alias("ratio"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("truncated"), F.col("term")))), ",").alias("truncated"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(best)), lambda x: x["t"]), ","), F.lit("")).alias("top_terms"),
    )


@registry.add("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: rows of each label; vectors are not read."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@registry.add(
    """WITH n AS (SELECT 'server' AS part, coalesce(source, 'unknown') AS name, count(*) AS n FROM documents GROUP BY 2),
w AS (SELECT 'window' AS part, CASE WHEN n_chars >= 1500 THEN 'trailing' WHEN n_chars >= 500 THEN 'preceding' ELSE 'outside' END AS name, count(*) AS n FROM documents WHERE source = 'src0' GROUP BY 2),
u AS (SELECT * FROM n UNION ALL SELECT * FROM w UNION ALL SELECT 'total', 'all', count(*) FROM documents) SELECT part, name, n, row_number() OVER (PARTITION BY part ORDER BY n DESC, name)::INT AS place FROM u"""
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total, each server by falling count, and the windows of one of them, in one pass."""
    d = table(spark, sf_dir, "documents")
    window = F.when(F.col("n_chars") >= 1500, "trailing").when(F.col("n_chars") >= 500, "preceding").otherwise("outside")
    row = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    parts = F.array_compact(F.array(row("total", F.lit("all")), row("server", F.coalesce("source", F.lit("unknown"))), F.when(F.col("source") == "src0", row("window", window))))
    counts = d.select(F.explode(parts).alias("p")).groupBy("p.part", "p.name").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "name")))
