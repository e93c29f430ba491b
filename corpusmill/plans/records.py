"""Record predicates, topic filters, reconciliation, reference checks and list rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from .common import Registry, spread, table

registry = Registry()


@registry.add("SELECT source, count(*) AS n, count(*) FILTER (CASE source WHEN 'src0' THEN contains(text, 'License') WHEN 'src1' THEN n_chars > 2000 WHEN 'src2' THEN lang = 'en' ELSE false END) AS reviewed, count(*) FILTER (regexp_matches(text, '^[A-Z]{3,}')) AS withdrawn FROM documents GROUP BY 1")
def server_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates that depend on the server."""
    d = table(spark, sf_dir, "documents")
    reviewed = R.by_server(F.col("source"), {"src0": F.col("text").contains("License"), "src1": F.col("n_chars") > 2000, "src2": F.col("lang") == "en"})
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(reviewed).alias("reviewed"), F.count_if(F.col("text").rlike("^[A-Z]{3,}")).alias("withdrawn"))


_CLAIMS = {"licence_en": ["[Ll]icen[sc]e", "(^|[^A-Za-z])the([^A-Za-z]|$)"], "junk_mail": ["@", "!!|[#$%&*]{3}"], "rights": ["rights", "reserved"]}


@registry.add("SELECT claim, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {' AND '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{n}' END" for n, ps in _CLAIMS.items()) + "], lambda x: x IS NOT NULL)) AS claim FROM documents) GROUP BY 1")
def topic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each claim's topic, all patterns of which must match."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(R.topics(F.col("text"), _CLAIMS)).alias("claim"))
    return d.groupBy("claim").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@registry.add("WITH g AS (SELECT s_nationkey AS k, list(DISTINCT s_suppkey % 10) AS grp FROM supplier GROUP BY 1) SELECT c_custkey, coalesce(list_has_any([c_custkey % 10, c_custkey % 3], grp), false) AS same_group FROM customer LEFT JOIN g ON c_nationkey = k")
def same_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a record share a member with the original group?"""
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.collect_set(F.col("s_suppkey") % 10).alias("grp"))
    c = table(spark, sf_dir, "customer").join(g, "c_nationkey", "left")
    return c.select("c_custkey", R.same_group(F.array(F.col("c_custkey") % 10, F.col("c_custkey") % 3), F.col("grp")).alias("same_group"))


@registry.add("WITH p AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (k IS NULL) AS dropped FROM p GROUP BY 1")
def projected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from JSON, rows without the required one rejected and counted."""
    rows, good = R.project(table(spark, sf_dir, "events").select("event_type", "props"), "props", {"k": "$.k"}, "k")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~good).alias("dropped"))


@registry.add("WITH l AS (SELECT l_orderkey AS k, count(*) AS parsed FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey % 50 AS slice, count(*) * 4 AS expected, coalesce(sum(parsed), 0)::BIGINT AS parsed FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1) SELECT slice, expected, parsed, expected = parsed AND expected > 0 AS reconciled FROM s")
def slice_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced and parsed counts of each slice."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("parsed"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left")
    s = o.groupBy((F.col("o_orderkey") % 50).alias("slice")).agg((F.count("*") * 4).alias("expected"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"))
    return R.reconcile(s, "expected", "parsed")


@registry.add("SELECT o_orderstatus, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2001-12-31') > 365) AS old, max(date_diff('day', o_orderdate::DATE, DATE '2001-12-31'))::INT AS oldest FROM orders GROUP BY 1")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age at a fixed run date."""
    a = R.age_days(F.col("o_orderdate").cast("date"), "2001-12-31")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(a > 365).alias("old"), F.max(a).alias("oldest"))


@registry.add("SELECT source, count(*) FILTER (n_chars < 50) AS short, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def caveat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of what to be careful about."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") < 50).alias("short"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), F.count_distinct("lang").alias("langs"))


@registry.add(
    """WITH r AS (SELECT DISTINCT ['doi', 'arxiv', 'url'][l_linenumber % 3 + 1] AS kind, CASE l_linenumber % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey ELSE l_orderkey END AS id FROM lineitem),
p AS (SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 1 ELSE 2 END AS place FROM part WHERE p_size <= 45), a AS (SELECT r.*, CASE WHEN kind = 'doi' THEN p.place WHEN kind = 'arxiv' AND s_acctbal > 0 THEN 1 WHEN kind = 'url' AND o_orderstatus <> 'F' THEN 1 END AS place
    FROM r LEFT JOIN p ON kind = 'doi' AND p.id = r.id LEFT JOIN supplier ON kind = 'arxiv' AND s_suppkey = r.id LEFT JOIN orders ON kind = 'url' AND o_orderkey = r.id)
SELECT kind, id, place, CASE WHEN place IS NULL THEN 'missing' WHEN kind <> 'url' AND id % 5 = 1 THEN 'title' ELSE 'ok' END AS verdict FROM a"""
)
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all lines refer to, looked up by kind: parts in one table and then in another, suppliers, orders by status;
    titles compared."""
    at = F.col("l_linenumber") % 3
    kind = F.element_at(F.array(*map(F.lit, ("doi", "arxiv", "url"))), (at + 1).cast("int"))
    ids = F.when(at == 0, F.col("l_partkey")).when(at == 1, F.col("l_suppkey")).otherwise(F.col("l_orderkey"))
    name = F.concat(F.lit("T "), F.col("id").cast("string"))
    refs = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), ids.alias("id")).distinct().withColumn("title", name)
    title = F.when(F.col("id") % 5 == 0, F.concat(F.lower(name), F.lit("."))).when(F.col("id") % 5 == 1, "other").otherwise(name)
    found = lambda t, key, where: table(spark, sf_dir, t).where(where).select(F.col(key).alias("id")).select("id", title.alias("found_title"), F.lit(200).alias("status"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("found_title"), F.when(F.col("o_orderstatus") == "F", 404).otherwise(302).alias("status"))
    doi = [found("part", "p_partkey", "p_size <= 25"), found("part", "p_partkey", "p_size <= 45")]
    return R.resolve(refs, {"doi": doi, "arxiv": [found("supplier", "s_suppkey", "s_acctbal > 0")], "url": [pages]}).select("kind", "id", "place", "verdict")


@registry.add("SELECT n_nationkey, '<li id=\"ref-' || n_nationkey::VARCHAR || '\">' || n_name || '. <a href=\"https://x.org/?a=1&amp;b=' || n_nationkey::VARCHAR || '\">https://x.org/?a=1&amp;b=' || n_nationkey::VARCHAR || '</a></li>' AS item FROM nation")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered, escaped list items."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", R.reference_item(k, F.col("n_name"), F.concat(F.lit("https://x.org/?a=1&b="), k.cast("string"))).alias("item"))


def _parsed_join(cells: DataFrame, p: DataFrame) -> DataFrame:
    a = cells.select(F.concat(F.lit("part ("), F.col("p_partkey").cast("string"), F.lit(")")).alias("cell"), "p_size")
    a = a.select(F.regexp_extract("cell", r"\((\d+)\)$", 1).cast("long").alias("key"), "p_size")
    return a.join(p.select(F.col("p_partkey").alias("key"), "p_brand"), "key")


@registry.add("WITH a AS (SELECT 'part (' || p_partkey::VARCHAR || ')' AS cell, p_size FROM part), b AS (SELECT p_partkey AS key, p_brand FROM part) SELECT key, p_size, p_brand FROM a JOIN b ON key = regexp_extract(cell, '\\((\\d+)\\)$', 1)::BIGINT")
def join_on_parsed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the whole table joined on a key that is parsed from a table cell."""
    p = table(spark, sf_dir, "part")
    return _parsed_join(p, p)


@registry.add("WITH u AS (SELECT doc_id, 'moire' AS term FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, 'moiré' FROM documents WHERE lang = 'fr') SELECT doc_id, array_to_string(list_sort(list_distinct(list(term))), ',') AS terms FROM u GROUP BY 1")
def variant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of query variants, one row an id, terms united."""
    d = table(spark, sf_dir, "documents")
    u = d.where("n_chars > 1000").select("doc_id", F.lit("moire").alias("term")).unionByName(d.where("lang = 'fr'").select("doc_id", F.lit("moiré").alias("term")))
    return u.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))
