"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_root, ship
from .kernels import give_back


_created: list[tuple[str, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _created.append((spark.sparkContext.applicationId, path))
    return path


def mark() -> int:
    """To be given to ``sweep`` later."""
    return len(_created)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the staged tables made since a mark, but for those that ``keep`` reads: results that were not written
    yet may need theirs.  Returns how many went."""
    own, kept = spark.sparkContext.applicationId, {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    gone = [(a, p) for a, p in _created[since:] if a == own and p.rpartition("/")[2] not in kept]
    for entry in gone:
        drop(spark, entry[1])
        _created.remove(entry)
    gc.collect()  # plans of the tables that went, which the JVM keeps as long as Python refers to them
    give_back()
    return len(gone)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = ship(df.sparkSession)
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores after it until no column has it, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What a document is known by: its doc_id (null: a hash of the text) and a hash of its text, so that two texts under
    one doc_id are two documents."""
    t = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.coalesce(doc_id.cast("long"), t), t


def keyed(docs: DataFrame) -> DataFrame:
    """k, t (see ``identity``), doc_id, text (null: empty)."""
    k, t = identity(F.col("doc_id"), F.col("text"))
    return docs.select(k.alias("k"), t.alias("t"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
