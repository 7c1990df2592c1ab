"""Incremental ingestion: files landing in a folder go through the engine once each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def outermost(folders: Iterable[str]) -> Iterator[str]:
    """Sorted folders, each ending in a slash, without those inside another: they are read with it."""
    last = None
    for folder in folders:
        if last is None or not folder.startswith(last):
            last = folder
            yield folder


def ingest_stream(spark: SparkSession, landing: str, checkpoint: str, engine) -> StreamingQuery:
    """Everything that has landed and isn't done yet, then stop. A batch run again finds its documents known."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(landing)

    def batch(rows: DataFrame, _: int) -> None:
        folders = rows.select(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))").alias("f")).distinct().orderBy("f")
        for folder in outermost(r["f"] for r in folders.toLocalIterator()):
            engine.ingest(folder)

    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(events: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Events per window and type, for batches and streams alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
