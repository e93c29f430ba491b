"""Merged keys and what cites them, joins of tables that lie in buckets, and projections from one variant column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases, records
from ..sources import buckets
from .common import Registry, r6, scratch, table

registry = Registry()

# Customers as works: each but the last of its ten gave way to the next key; what is left is one work a nation and segment.
_CLOSED = """c AS (SELECT c_custkey AS k, c_nationkey::VARCHAR || ':' || c_mktsegment AS identity, c_custkey % 5 AS lane FROM customer),
s AS (SELECT k AS alias, k + 1 AS key FROM c WHERE k % 10 <> 0 AND k + 1 IN (SELECT k FROM c)),
l AS (SELECT * FROM c WHERE k NOT IN (SELECT alias FROM s)),
n AS (SELECT identity, arg_min(k, (lane, k)) AS key FROM l GROUP BY 1),
a AS (SELECT alias, key FROM s UNION SELECT l.k, n.key FROM l JOIN n USING (identity) WHERE l.k <> n.key),
w AS (SELECT alias, key, 1 AS steps FROM a UNION ALL SELECT w.alias, a.key, steps + 1 FROM w JOIN a ON a.alias = w.key),
z AS (SELECT alias, arg_max(key, steps) AS key, max(steps) AS steps FROM w GROUP BY 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("key"), F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("identity"), (k % 5).alias("lane"))
    gone = c.where("key % 10 <> 0").select(F.col("key").alias("alias"), (F.col("key") + 1).alias("key")).join(c.select("key"), "key", "left_semi")
    return aliases.merge_lanes(c, "identity", "key", ["lane"], gone.select("alias", "key"))


@registry.add(f"WITH RECURSIVE {_CLOSED} SELECT alias, key, steps FROM z")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that gave way with the one that it stands for in the end, through chains of both kinds."""
    return _merged(spark, sf_dir)[1]


@registry.add(f"WITH RECURSIVE {_CLOSED} SELECT coalesce(z.key, o_custkey) AS key, count(*) AS rows, count(z.alias) AS rewritten, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN z ON z.alias = o_custkey GROUP BY 1")
def catalog_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of orders under the keys that theirs stand for, each checked to name a work."""
    works, closed = _merged(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_custkey").alias("cited"), "o_totalprice")
    rows = aliases.rewrite_keys(o, "key", closed, works, "key")
    return rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("key") != F.col("cited")).alias("rewritten"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@registry.add("SELECT d.doc_id, d.lang, length(coalesce(d.text, '')) AS chars, l.quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and texts written in the same buckets once, then joined bucket by bucket: nothing is shuffled again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    left = buckets.bucketed(d, "doc_id", scratch(spark, "texts"))
    right = buckets.bucketed(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", scratch(spark, "labels"))
    return buckets.join_buckets(left, right, "doc_id", "left").select(left["doc_id"], "lang", "chars", "quality", right["doc_id"].isNotNull().alias("labelled"))


# A record as each source sends it: numbers as numbers, as text or as words, one in 17 cut short.
_PAYLOAD = """CASE WHEN event_id % 17 = 0 THEN '{"id": ' || event_id WHEN event_type = 'view' THEN '{"id": ' || event_id || ', "m": {"v": "' || CASE WHEN event_id % 5 = 0 THEN 'none' ELSE (event_id % 100)::VARCHAR END || '"}}'
    WHEN event_type = 'click' THEN '{"id": "e' || event_id || '", "m": {"v": ' || event_id % 100 || '}, "x": [1, 2]}' ELSE '{"id": ' || event_id || ', "m": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '{"v": ' || event_id % 100 || '.5}' END || '}' END"""


@registry.add(
    f"""WITH e AS (SELECT event_type AS source, event_id, {_PAYLOAD} AS p FROM events), j AS (SELECT *, json_valid(p) AS ok, CASE WHEN json_valid(p) THEN p::JSON END AS v FROM e),
f AS (SELECT *, CASE WHEN json_type(v, '$.id') IN ('BIGINT', 'UBIGINT') THEN (v->>'$.id')::BIGINT END AS id, try_cast(v->>'$.m.v' AS DOUBLE) AS number, json_extract(v, '$.id') IS NOT NULL AS has_id, json_type(v, '$.m.v') IS NOT NULL AS has_number FROM j)
SELECT source, count(*) AS rows, count(*) FILTER (ok) AS parsed, count(id) AS ids, count(*) FILTER (has_id AND id IS NULL) AS wrong_ids, count(*) FILTER (id = event_id) AS same_ids, count(number) AS numbers, count(*) FILTER (has_number AND number IS NULL) AS wrong_numbers, round(coalesce(sum(number), 0), 6) AS total FROM f GROUP BY 1"""
)
def variant_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection for all sources from one variant column; a field of another type is null and counted."""
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    small = (F.col("event_id") % 100).cast("string")
    view = F.concat(F.lit('{"id": '), i, F.lit(', "m": {"v": "'), F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(small), F.lit('"}}'))
    click = F.concat(F.lit('{"id": "e'), i, F.lit('", "m": {"v": '), small, F.lit('}, "x": [1, 2]}'))
    other = F.concat(F.lit('{"id": '), i, F.lit(', "m": '), F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"v": '), small, F.lit(".5}"))), F.lit("}"))
    payload = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"id": '), i)).when(kind == "view", view).when(kind == "click", click).otherwise(other)
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("source"), payload.alias("payload"))
    out = records.variant_fields(rows, "payload", {"id": ("$.id", "bigint", True), "number": ("$.m.v", "double", False)})
    return out.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.count_if("parsed").alias("parsed"),
        F.count("id").alias("ids"),
        F.count_if("wrong_id").alias("wrong_ids"),
        F.count_if(F.col("id") == F.col("event_id")).alias("same_ids"),
        F.count("number").alias("numbers"),
        F.count_if("wrong_number").alias("wrong_numbers"),
        r6(F.coalesce(F.sum("number"), F.lit(0.0))).alias("total"),
    )
