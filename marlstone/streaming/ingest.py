"""Incremental ingest: a stream of files merged into handle tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import handles

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below root as they appear."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append handles of the files to ``target``, one folder per batch, so that a batch that is run again replaces its own.

    Handles are content hashes, so what an earlier batch has brought is the same row; ``current`` keeps one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = handles.file_refs(batch.select("path", "content")).withColumn("seen_at", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The last row of each handle."""
    return handles.latest(spark.read.parquet(target), ["handle"], "seen_at").drop("batch")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events by window and type, with a bound on lateness where they stream; batch tables give the same counts."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    counted = events.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
