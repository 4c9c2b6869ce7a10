"""Streaming forms of the usage aggregates: findings by window with late data bounded, and incremental record updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flag_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Findings by window, flag and severity from a stream (or table) of event_id, ts, event_type; repeated events count once.

    The watermark bounds both the state of the windows and that of the deduplication.
    """
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    counted = once.groupBy(F.window("ts", window), F.col("event_type").alias("flag_id"), severity.alias("severity")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "flag_id", "severity", "n")


def follow(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_batches(stream: DataFrame, target: str, key: str, checkpoint: str):
    """Each batch's newest row of a key replaces the stored one; state lives in the versions of the target folder.

    A batch writes a folder of its own number, so that one that is run again after a failure writes the same folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        if number:
            before = batch.sparkSession.read.parquet(f"{target}/v{number - 1}")
            newest = newest.unionByName(before.join(newest.select(key), key, "left_anti"))
        newest.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
