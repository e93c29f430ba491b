"""Claims with labelled records, and how much of one collection another one has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as L
from ..functions import stats
from ..functions import text as T
from ..operators import claims as C
from ..operators import simjoin as J
from .common import Registry, r6, spread, table
from .shares import _OW, orders

registry = Registry()

#: A nation stands for a claim, an order of one of its customers for a record about it.
_ROWS = f"""r AS (SELECT c_nationkey AS claim, o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'supportive' WHEN 1 THEN 'supportive' WHEN 2 THEN 'critical' ELSE 'neutral' END AS stance,
    CASE o_orderkey % 7 WHEN 0 THEN 'exp' WHEN 1 THEN 'comment' ELSE 'theory' END AS kind, c_mktsegment <> 'BUILDING' AND c_nationkey % 3 > 0 OR c_mktsegment = 'BUILDING' AS same_group, (o_custkey % 40)::VARCHAR AS author, {_OW} AS win,
    o_orderstatus = 'P' AND o_totalprice > 420000 AS withdrawn, o_orderdate::DATE AS date, o_orderpriority = '1-URGENT' AS reviewed FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'we report a possible signature near ' || id::VARCHAR || ' K in thin films of this kind' ELSE 'clear evidence' END AS text FROM r QUALIFY row_number() OVER (PARTITION BY claim ORDER BY id) <= 2)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    o, k = orders(spark, sf_dir).join(c, "o_custkey"), F.col("o_orderkey")
    own = ((F.col("c_mktsegment") != "BUILDING") & (F.col("c_nationkey") % 3 > 0)) | (F.col("c_mktsegment") == "BUILDING")
    return o.select(
        F.col("c_nationkey").alias("claim"),
        k.alias("id"),
        F.when(k % 5 < 2, "supportive").when(k % 5 == 2, "critical").otherwise("neutral").alias("stance"),
        F.when(k % 7 == 0, "exp").when(k % 7 == 1, "comment").otherwise("theory").alias("kind"),
        own.alias("same_group"),
        (F.col("o_custkey") % 40).cast("string").alias("author"),
        "window",
        ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 420000)).alias("withdrawn"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_orderpriority") == "1-URGENT").alias("reviewed"),
    )


def _originals(rows: DataFrame) -> DataFrame:
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("claim").orderBy("id"))).where("rank <= 2")
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("we report a possible signature near "), F.col("id").cast("string"), F.lit(" K in thin films of this kind"))).otherwise("clear evidence")
    return first.withColumn("text", text)


@registry.add(
    f"""WITH {_ROWS}, w AS (SELECT * FROM r WHERE win IS NOT NULL), g AS (SELECT * FROM (SELECT DISTINCT claim FROM r) CROSS JOIN (VALUES ('supportive'), ('critical'), ('neutral')) s(stance))
SELECT g.claim, g.stance, count(w.id) AS n, count(*) FILTER (kind = 'exp') AS experiments, count(*) FILTER (win = 'trailing') AS trailing, count(*) FILTER (win = 'preceding') AS preceding, count(DISTINCT CASE WHEN same_group THEN 'ORIGINAL' ELSE author END) AS distinct_groups,
    CASE WHEN g.stance = 'supportive' THEN count(*) FILTER (kind = 'exp' AND NOT same_group) END AS independent_experiments FROM g LEFT JOIN w ON w.claim = g.claim AND w.stance = g.stance GROUP BY 1, 2"""
)
def claim_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the windows by claim and stance."""
    return C.tally(_records(spark, sf_dir))


_WEAK = r"possible signature"


@registry.add(
    f"""WITH {_ROWS}, k AS (SELECT n_nationkey AS claim, n_nationkey % 6 = 0 AS pair, CASE WHEN n_nationkey % 7 = 0 THEN 'Venue ' || n_nationkey::VARCHAR END AS venue FROM nation),
a AS (SELECT claim, count(*) FILTER (stance = 'supportive' AND kind = 'exp' AND NOT same_group) AS independent, count(*) FILTER (win IS NOT NULL AND (kind = 'comment' OR stance = 'critical' AND kind = 'exp')) AS nulls, count(*) FILTER (stance = 'supportive' AND withdrawn) AS pulled,
    count(*) FILTER (stance = 'supportive') AS positive, count(*) FILTER (stance = 'supportive' AND same_group) AS own, count(*) FILTER (win IS NOT NULL AND stance = 'supportive') AS pro, count(*) FILTER (win IS NOT NULL AND stance = 'critical') AS con,
    array_to_string((list(id ORDER BY id) FILTER (win IS NOT NULL AND (kind = 'comment' OR stance = 'critical' AND kind = 'exp')))[1:5], ', ') AS told FROM r GROUP BY 1),
b AS (SELECT claim, count(*) AS n, count(*) FILTER (withdrawn) AS pulled, count(*) FILTER (reviewed) AS reviewed, min(id) FILTER (contains(text, 'possible signature')) AS weak, max(date_diff('day', date, DATE '2001-06-01')) AS age,
    arg_min(substr(text, greatest(instr(text, 'possible signature') - 50, 1), instr(text, 'possible signature') - greatest(instr(text, 'possible signature') - 50, 1) + 18 + 50), id) FILTER (contains(text, 'possible signature')) AS snippet FROM o GROUP BY 1),
f AS (SELECT claim, CASE WHEN coalesce(independent, 0) > 0 OR (pair AND coalesce(n, 0) >= 2) THEN 0 ELSE 2 END AS f1, least(2, coalesce(nulls, 0)) AS f2, CASE WHEN coalesce(a.pulled, 0) + coalesce(b.pulled, 0) > 0 THEN 3 ELSE 0 END AS f3, CASE WHEN weak IS NOT NULL THEN 1 ELSE 0 END AS f4,
    CASE WHEN coalesce(reviewed, 0) > 0 OR venue IS NOT NULL THEN -1 WHEN age > 365 THEN 1 ELSE 0 END AS f5, CASE WHEN coalesce(positive, 0) > 0 AND own = positive THEN 1 ELSE 0 END AS f6, CASE WHEN coalesce(con, 0) > coalesce(pro, 0) THEN 1 ELSE 0 END AS f7,
    CASE WHEN nulls > 0 THEN nulls::VARCHAR || ' records, e.g. ' || told ELSE '' END AS null_evidence, coalesce(weak::VARCHAR || ': ' || snippet, '') AS weak_evidence FROM k LEFT JOIN a USING (claim) LEFT JOIN b USING (claim)),
s AS (SELECT *, f1 + f2 + f3 + f4 + f5 + f6 + f7 AS score FROM f) SELECT claim, f1, f2, f3, f4, f5, f6, f7, score, score >= 3 AS noisy, score < 3 AND f1 = 2 AS watch, null_evidence, weak_evidence FROM s"""
)
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven features of each claim, their sum, noisy from three points, and what is to be watched."""
    rows = _records(spark, sf_dir)
    n = F.col("n_nationkey")
    claims = table(spark, sf_dir, "nation").select(n.alias("claim"), (n % 6 == 0).alias("originals_independent"), F.when(n % 7 == 0, F.concat(F.lit("Venue "), n.cast("string"))).alias("known_venue"))
    x = C.noise_features(claims, _originals(rows), rows, "2001-06-01", L.snippet(F.col("text"), _WEAK))
    return x.select("claim", *[F.col("features")[i]["points"].alias(f"f{i + 1}") for i in range(7)], "score", "noisy", "watch", F.col("features")[1]["evidence"].alias("null_evidence"), F.col("features")[3]["evidence"].alias("weak_evidence"))


@registry.add(f"WITH {_ROWS} SELECT claim, id, strftime(date, '%Y-%m-%d') AS date, win AS \"window\", stance, kind FROM r WHERE stance = 'critical'")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records with their labels, of the critical stance."""
    return _records(spark, sf_dir).where("stance = 'critical'").select("claim", "id", F.date_format("date", "yyyy-MM-dd").alias("date"), "window", "stance", "kind")


_TITLE = "trim(regexp_replace(lower(regexp_replace(strip_accents(split_part(coalesce(text, ''), chr(10), 1)), '\\\\[a-zA-Z]+|\\$', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.TITLE_STOP) + "], t)))"
_OVERLAP = f"""t AS (SELECT doc_id, source, 'arXiv:' || CASE WHEN doc_id % 14 = 0 THEN (SELECT min(doc_id) FROM documents WHERE source = 'src0') ELSE doc_id + 1000000000 END::VARCHAR AS id, {_TITLE} AS norm FROM documents),
z AS (SELECT *, {_WORDS} AS k, CASE WHEN doc_id % 7 = 0 THEN id END AS declared FROM t),
i AS (SELECT doc_id, norm, k FROM z WHERE source = 'src0'), q AS (SELECT * FROM z WHERE source <> 'src0'),
e AS (SELECT norm, min(doc_id) AS match FROM i WHERE norm <> '' GROUP BY 1),
p AS (SELECT q.doc_id, i.doc_id AS match, len(list_intersect(q.k, i.k)) / (len(q.k) + len(i.k) - len(list_intersect(q.k, i.k))) AS j FROM q JOIN i ON len(q.k) >= 4 AND len(i.k) >= 0.8 * len(q.k) AND len(q.k) >= 0.8 * len(i.k) WHERE q.norm NOT IN (SELECT norm FROM e)),
b AS (SELECT doc_id, match, j FROM p WHERE j >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, match) = 1),
m AS (SELECT q.source, q.doc_id, q.declared, q.declared IN (SELECT 'arXiv:' || doc_id::VARCHAR FROM i) AS declared_found, CASE WHEN e.match IS NOT NULL THEN 'exact' WHEN b.match IS NOT NULL THEN 'near' END AS how, coalesce(e.match, b.match) AS match, coalesce(CASE WHEN e.match IS NOT NULL THEN 1.0 END, b.j) AS jaccard FROM q LEFT JOIN e ON e.norm = q.norm AND q.norm <> '' LEFT JOIN b USING (doc_id))"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    norm = T.title_identity(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    return d.select("doc_id", "source", F.explode(F.array(norm)).alias("norm")).withColumn("tokens", T.title_tokens(F.col("norm")))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    norm = T.title_identity(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    least = d.where("source = 'src0'").agg(F.min("doc_id").alias("least"))  # one row
    rows = d.crossJoin(F.broadcast(least)).select("source", "doc_id", F.explode(F.array(norm)).alias("norm"), F.when(F.col("doc_id") % 14 == 0, F.col("least")).when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1000000000).alias("declared"))
    rows = rows.withColumn("tokens", T.title_tokens(F.col("norm")))
    return J.overlap(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), "doc_id", "declared", "norm", "tokens")


@registry.add(f"WITH {_OVERLAP} SELECT doc_id, declared, coalesce(declared_found, false) AS declared_found, how, match, round(jaccard, 6) AS jaccard, declared IS NOT NULL OR how IS NOT NULL AS found FROM m")
def overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record outside the index, the id that it declares, the title that it matches, or both."""
    return _overlap(spark, sf_dir).select("doc_id", F.concat(F.lit("arXiv:"), F.col("declared").cast("string")).alias("declared"), "declared_found", "how", "match", r6(F.col("jaccard")).alias("jaccard"), "found")


@registry.add(
    f"""WITH {_OVERLAP} SELECT source, count(*) AS n, count(declared) AS declared, round(count(declared) / count(*), 4) AS declared_share, count(*) FILTER (declared_found) AS declared_found, count(*) FILTER (how = 'exact') AS title_exact, count(*) FILTER (how = 'near') AS title_near,
    round(count(how) / count(*), 4) AS title_share, count(*) FILTER (declared IS NOT NULL AND how IS NOT NULL) AS both, count(*) FILTER (declared IS NOT NULL OR how IS NOT NULL) AS found, round(count(*) FILTER (declared IS NOT NULL OR how IS NOT NULL) / count(*), 4) AS found_share, count(DISTINCT match) AS matched_index_rows,
    coalesce(array_to_string((list(doc_id::VARCHAR || '=' || match::VARCHAR ORDER BY doc_id) FILTER (how = 'near'))[1:5], ','), '') AS near_examples FROM m GROUP BY 1"""
)
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the overlap by server, with the first five near matches of each."""
    m = _overlap(spark, sf_dir)
    # Five examples a source come from a rank, so no list grows with the source.
    rank = F.row_number().over(Window.partitionBy("source", "how").orderBy("doc_id"))
    m = m.withColumn("example", F.when((F.col("how") == "near") & (rank <= 5), F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("="), F.col("match").cast("string")).alias("t"))))
    declared, how, n = F.col("declared").isNotNull(), F.col("how").isNotNull(), F.count("*")
    return m.groupBy("source").agg(
        n.alias("n"),
        F.count_if(declared).alias("declared"),
        stats.safe_share(F.count_if(declared), n).alias("declared_share"),
        F.count_if("declared_found").alias("declared_found"),
        F.count_if(F.col("how") == "exact").alias("title_exact"),
        F.count_if(F.col("how") == "near").alias("title_near"),
        stats.safe_share(F.count_if(how), n).alias("title_share"),
        F.count_if(declared & how).alias("both"),
        F.count_if("found").alias("found"),
        stats.safe_share(F.count_if("found"), n).alias("found_share"),
        F.count_distinct("match").alias("matched_index_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list("example")), lambda x: x["t"]), ",").alias("near_examples"),
    )


@registry.add(
    f"""WITH t AS (SELECT doc_id, {_TITLE} AS norm FROM documents), z AS (SELECT doc_id, list_sort({_WORDS}) AS k FROM t), d AS (SELECT k, min(doc_id) AS match FROM z WHERE len(k) > 0 GROUP BY 1),
p AS (SELECT a.k AS k, b.match, len(list_intersect(a.k, b.k)) AS shared, len(a.k) + len(b.k) AS total FROM d a JOIN d b ON a.k <> b.k AND len(a.k) <= 2 * len(b.k) AND len(b.k) <= 2 * len(a.k)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, shared / (total - shared) DESC, match)::INT AS rank FROM p WHERE 2 * shared >= total - shared)
SELECT z.doc_id AS query, match, shared::INT AS shared, rank FROM z JOIN o USING (k) WHERE rank <= 3"""
)
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each title the three most similar other titles of the whole table, at least half alike."""
    rows = _titles(spark, sf_dir)
    return J.title_search(rows, rows, "doc_id", "tokens", 3, 0.5, others=True)
