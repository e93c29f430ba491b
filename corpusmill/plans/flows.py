"""Streams, file round trips, and pipelines that end in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonl
from ..streaming import events as S
from .common import Registry, scratch, table

registry = Registry()


@registry.add("SELECT ts::DATE AS day, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def stream_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a stream over the events, late duplicates dropped, daily counts; equal to the batch."""
    schema = table(spark, sf_dir, "events").schema
    source = S.read_stream(spark, sf_dir, schema, glob="events.parquet")
    counts = S.run_available(S.dedup_counts(source, "event_id", "ts", "event_type"), scratch(spark, "stream-counts"), scratch(spark, "stream"), ["start", "event_type"])
    return counts.select(F.col("start").cast("date").alias("day"), "event_type", "n")


@registry.add("SELECT ts::DATE AS day, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def batch_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedup_counts(table(spark, sf_dir, "events"), "event_id", "ts", "event_type").select(F.col("start").cast("date").alias("day"), "event_type", "n")


def _round_trip(spark: SparkSession, d: DataFrame) -> DataFrame:
    """Records written as JSON Lines by source, a null source to a file of its own that no source name gives, and
    read again with an explicit schema."""
    path = scratch(spark, "jsonl")
    file = F.coalesce(F.concat("source", F.lit(".jsonl")), F.lit("no source"))
    d.select(file.alias("file"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title")).write.partitionBy("file").json(path)
    rows = spark.read.schema("id string, title string, file string").option("mode", "DROPMALFORMED").json(path)
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.length("title")).alias("longest"))


@registry.add("SELECT coalesce(source || '.jsonl', 'no source') AS file, count(*) AS n, count(DISTINCT doc_id) AS ids, max(length(text)) AS longest FROM documents GROUP BY 1")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as JSON Lines and read again."""
    return _round_trip(spark, table(spark, sf_dir, "documents"))


@registry.add("SELECT event_type AS slice, count(*) AS n, count(DISTINCT event_id) AS ids, sum(event_id)::BIGINT AS checksum FROM events GROUP BY 1")
def resumed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded pages, read by a run that stops after two batches and by one that takes it up: each row once."""
    pages, target, held = scratch(spark, "pages"), scratch(spark, "scanned"), scratch(spark, "scan-state")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("slice"), "event_id")
    e.repartition(12, F.xxhash64("event_id")).write.json(pages)
    for batches in (2, None):
        S.resume_pages(spark, pages, "slice string, event_id long", target, held, batches=batches)
    rows = spark.read.schema("slice string, event_id long").parquet(target)
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("checksum"))


def _label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labels, partitioned by region of the customer's number, and by status within."""
    path = scratch(spark, "labels")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 5).cast("int").alias("region"), F.col("o_orderstatus").alias("status"))
    o.repartition("region", "status").write.partitionBy("region", "status").parquet(path)
    return spark.read.schema("o_orderkey long, year int, region int, status string").parquet(path)


@registry.add("SELECT o_custkey % 5 AS region, year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 = 2 AND year(o_orderdate) >= 1996 GROUP BY ALL")
def partition_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one server that are in scope: of the partitions only its own is read, and the year goes to the scan."""
    rows = _label_table(spark, sf_dir).where("region = 2 AND status = 'P' AND year >= 1996")
    return rows.groupBy("region", "year").agg(F.count("*").alias("n"))


@registry.add("SELECT r_name AS name, o_orderstatus AS status, count(*) AS n FROM orders JOIN region ON r_regionkey = o_custkey % 5 WHERE r_name LIKE 'A%' GROUP BY ALL")
def dynamic_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which partitions are read is known only from a small table: its filter prunes the scan while it runs."""
    r = table(spark, sf_dir, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").cast("int").alias("region"), F.col("r_name").alias("name"))
    return _label_table(spark, sf_dir).join(r, "region").groupBy("name", "status").agg(F.count("*").alias("n"))


@registry.add("SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names, n_regionkey AS region FROM nation GROUP BY 2")
def fragment_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments joined in a fixed order."""
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ").alias("names"))


def _supplemented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a table that knew those of status F and had all others appended, by the whole key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    path = scratch(spark, "supplement")
    o.where("status = 'F'").dropDuplicates(["k"]).write.parquet(path)
    jsonl.append_new(o, path, "k")
    return spark.read.parquet(path)


@registry.add("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(o_orderkey % 1000003)::BIGINT AS checksum FROM orders GROUP BY 1")
def append_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended where their key is not known yet; the whole table by status."""
    return _supplemented(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"), F.sum(F.col("k") % 1000003).alias("checksum"))
