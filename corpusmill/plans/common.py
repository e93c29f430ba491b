"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import scratch, ship

__all__ = ["Query", "Registry", "r6", "scratch", "spread", "table"]
Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer splits than those, as a small table in one file has; else as they are.
    Sizes of at most as many files as there are cores are asked for; nothing is planned or read."""
    spark = rows.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if len(files) >= cores:
        return rows
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return rows.repartition(cores) if size < cores * split else rows
