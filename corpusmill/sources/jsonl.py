"""JSON Lines corpora with an explicit schema, other record formats, and atomic writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, server string, title string, abstract string, date string, window string, authors array<string>, categories array<string>, primary_category string, doi string, url string, matched_terms array<string>, arxiv_id string, extra string"


def read_corpus(spark: SparkSession, folder: str, keep_bad: bool = False, schema: str = CORPUS) -> DataFrame:
    """Records of ``folder/*.jsonl`` (folders inside it aside) with their file; malformed lines are dropped, or kept
    in ``bad`` to be counted."""
    reader = spark.read.schema(f"{schema}, bad string" if keep_bad else schema)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad") if keep_bad else reader.option("mode", "DROPMALFORMED")
    rows = reader.json(f"{folder}/*.jsonl")
    return rows.withColumn("file", F.col("_metadata.file_name"))


def windowed(rows: DataFrame) -> DataFrame:
    """In a window, server from the file name where it is missing, the first of each (server, id)."""
    from ..operators.dedup import keep_first

    named = rows.where("window IN ('trailing', 'preceding')").withColumn("server", F.coalesce("server", F.regexp_replace("file", r"(-\d+)?\.jsonl$", "")))
    return keep_first(named, ["server", "id"], ["file", "date", "title"])


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or object) that spans lines; a record that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


ENTRY = "id: string, title: string, summary: string, published: string, author: array<struct<name: string>>"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Atom pages: total (what the service has), n_entries, error (the text of an error entry, which has no published
    date), and entries: id, title, summary, date, authors."""
    rows = spark.read.format("xml").option("rowTag", "feed").schema(f"`opensearch:totalResults` long, entry array<struct<{ENTRY}>>").load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    entry = F.coalesce("entry", F.array().cast(f"array<struct<{ENTRY}>>"))
    good = F.transform(F.filter(entry, lambda e: e["published"].isNotNull()), lambda e: F.struct(e["id"].alias("id"), clean(e["title"]).alias("title"), clean(e["summary"]).alias("summary"), F.substring(e["published"], 1, 10).alias("date"), e["author"]["name"].alias("authors")))
    error = F.try_element_at(F.filter(entry, lambda e: e["published"].isNull()), F.lit(1))
    return rows.select(F.col("opensearch:totalResults").alias("total"), F.size(entry).alias("n_entries"), F.coalesce(error["summary"], error["title"]).alias("error"), good.alias("entries"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom pages: id, title, summary, date, authors; error entries are left out."""
    return read_feeds(spark, path).select(F.explode("entries").alias("e")).select("e.*")


_CURRENT = "_current"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def publish(rows: DataFrame, folder: str, by: str, text: bool = False) -> int:
    """Write rows as JSON Lines (or their one text column as lines) as ``<by>-NNNNN.jsonl`` files of a new version of the set
    in ``folder``.  Returns how many files there are.

    A version is a folder of its own, which no reader looks into until it is whole; then one small file that names it is
    swapped for the old one by an atomic rename.  So a reader sees the old set or the new one, never parts of both; a
    publication that fails leaves the old one as it was, and a smaller one leaves no file of a larger behind."""
    spark = rows.sparkSession
    path, fs = _fs(spark, folder)
    name = f"v-{uuid.uuid4().hex}"
    version, held = f"{folder}/{name}", f"{folder}/{name}/_held"
    n = 0
    try:
        writer = rows.write.partitionBy(by)
        (writer.text if text else writer.json)(held)
        for part in fs.listStatus(path(held)):
            value = part.getPath().getName()
            if not part.isDirectory() or "=" not in value:
                continue
            files = sorted(str(f.getPath()) for f in fs.listStatus(part.getPath()) if not f.getPath().getName().startswith((".", "_")))
            for i, f in enumerate(files):
                if not fs.rename(path(f), path(f"{version}/{value.partition('=')[2]}-{i:05d}.jsonl")):
                    raise OSError(f"{f} could not be renamed")
                n += 1
        fs.delete(path(held), True)
    except BaseException:
        fs.delete(path(version), True)
        raise
    _swap(spark, folder, name)
    return n


def _swap(spark: SparkSession, folder: str, name: str) -> None:
    path, fs = _fs(spark, folder)
    written = path(f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(written)
    out.write(bytearray(name.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
    options[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(written, path(f"{folder}/{_CURRENT}"), options)


def published(spark: SparkSession, folder: str) -> str:
    """The folder of the current version; raises if nothing was published."""
    path, fs = _fs(spark, folder)
    at = path(f"{folder}/{_CURRENT}")
    if not fs.exists(at):
        raise FileNotFoundError(f"nothing is published in {folder}")
    stream = fs.open(at)
    try:
        name = bytes(stream.readNBytes(fs.getFileStatus(at).getLen())).decode()
    finally:
        stream.close()
    return f"{folder}/{name}"


def drop_versions(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete versions that are not current, but for the ``keep`` newest, which readers may still be at.  Returns how many
    went."""
    path, fs = _fs(spark, folder)
    current = published(spark, folder).rpartition("/")[2]
    old = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("v-") and f.getPath().getName() != current]
    gone = sorted(old, reverse=True)[keep:]
    for _, name in gone:
        fs.delete(path(f"{folder}/{name}"), True)
    return len(gone)


def write_ordered(rows: DataFrame, path: str, order: tuple[str, ...] = ("date", "id")) -> None:
    """JSON Lines in a total order, null first: range partitions are written in order, so no task holds all rows."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows.orderBy(*keys).write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table lacks; returns how many.  The anti-join reads keys alone, and what is appended
    is counted while it is written."""
    spark = rows.sparkSession
    known, counted = spark.read.parquet(path).select(key), Observation()
    fresh = rows.dropDuplicates([key]).join(known, key, "left_anti").observe(counted, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").parquet(path)
    return int(counted.get["n"])
