"""Streams of records: late duplicates dropped, tumbling counts, the same result as the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files_a_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def dedup_counts(events: DataFrame, id_: str, ts: str, kind: str, late: str = "40 days", window: str = "1 day") -> DataFrame:
    """Events of each kind in each window, every id once; works on a stream and on a table.

    On a stream the window and the duplicates hang on the column that has the watermark, so that state older than
    ``late`` goes, and a window is final once the watermark has passed it."""
    at = "event_time" if events.isStreaming else ts
    if events.isStreaming:
        events = events.withColumn(at, F.col(ts).cast("timestamp"))  # watermarks need a zoned type
        events = events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])
    else:
        events = events.dropDuplicates([id_])
    return events.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def run_available(result: DataFrame, path: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Run a stream over all that is there: each micro-batch writes the windows that it changed as Parquet under its
    number (again, if it is run again); the last state of each window is the result."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = result.sparkSession.read.option("basePath", path).schema(StructType([*result.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/batch=*")
    values = [c for c in result.columns if c not in key]
    return rows.groupBy(*key).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def resume_pages(spark: SparkSession, pages: str, schema: str, target: str, checkpoint: str, files_a_trigger: int = 4, batches: int | None = None) -> int:
    """Take recorded pages (JSON files in folders of ``pages``) into the Parquet table ``target``, from where the last run
    ended.  Returns how many micro-batches this run committed.

    The checkpoint holds which files each batch has, and the sink's log which batches it has: a run that is ended anywhere,
    within a batch too, is taken up by the next, and each page is there once.  With ``batches`` the run is stopped once as
    many are committed or nothing is left.  A page that is read is not read again, even if it is written anew; a line that is no record of ``schema`` raises."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(pages)
    writer = rows.withColumn("page_file", F.input_file_name()).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    if batches is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return len(query.recentProgress)
    query, done = writer.start(), 0
    while done < batches and not query.awaitTermination(0.02):
        done = sum(p["numInputRows"] > 0 for p in query.recentProgress)
        if not query.status["isDataAvailable"] and not query.status["isTriggerActive"] and query.lastProgress is not None and query.lastProgress["numInputRows"] == 0:
            break
    query.stop()
    return done
