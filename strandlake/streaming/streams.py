"""Streams: records parsed as they arrive, and counts per window with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import rejects


def folder_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parsed_stream(raw: DataFrame, contigs: DataFrame) -> DataFrame:
    """Lines of a stream typed or rejected; the parser keeps no state, so each batch is on its own."""
    return rejects.parse_vcf(raw, contigs)


def split_to_tables(parsed: DataFrame, valid_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Valid and rejected rows of each batch to their own folders; a batch that is run again writes the same files over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        rejects.valid(batch).write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        rejects.rejected(batch).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watched(rows: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark; event times without a zone are taken in the session's. For batch frames the watermark does nothing."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and window of event time; rows later than the watermark are dropped by the engine. For batch frames the watermark does nothing."""
    watched = _watched(events, at, late)
    per = watched.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    watched = _watched(events, at, late)
    per = watched.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def deduplicated_stream(rows: DataFrame, keys: list[str], at: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state older than that is let go."""
    return _watched(rows, at, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
