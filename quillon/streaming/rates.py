"""Structured Streaming counterparts: rate windows over an event stream and a review queue fed by changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators.corpus import stage_changes
from quillon.operators.logs import RATE


def windowed_over_rate(events: DataFrame, subject: str, ts: str = "ts", most: int = RATE, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """subject, start, end, n of the windows with more than `most` events; works on streams and on tables alike.

    Event times without a zone are read as UTC instants first: watermarks take only those.
    """
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    windows = timed.groupBy(subject, F.window("_t", length, slide) if slide else F.window("_t", length)).agg(F.count("*").alias("n"))
    return windows.where(F.col("n") > most).select(subject, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, subject: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """subject, start, end, n: events of a subject that follow each other within the gap are one session, which ends a gap after its
    last event; works on streams and on tables alike."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    by = timed.groupBy(subject, F.session_window("_t", gap).alias("window")).agg(F.count("*").alias("n"))
    return by.select(subject, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def stage_stream(fetched: DataFrame, current: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of fetched sections is compared with the open versions; what differs is appended to the queue at out.

    A batch that is computed again after a failure overwrites its own folder: no change is queued twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage_changes(current(), batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates_from_files(spark: SparkSession, source: str, schema: StructType, subject: str, out: str, most: int = RATE, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", files: int = 1000) -> DataFrame:
    """windowed_over_rate() as a stream over the Parquet files at source, `files` at a time, to its end; what it found, read back.

    Windows are written when the watermark has passed them, so those of the last hour of events are still open; events of windows
    that are closed already are too late and do not count. Called again with the same `out`, it goes on where it stopped.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    live = windowed_over_rate(events, subject, most=most, length=length, slide=slide, late=late)
    run = live.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rates").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{out}/rates")


def review_from_files(spark: SparkSession, source: str, current: Callable[[], DataFrame], out: str, files: int = 1000) -> DataFrame:
    """stage_stream() over the Parquet files at source (act_code, section_number, section_text), to its end; the queue, read back."""
    fetched = spark.readStream.schema("act_code string, section_number string, section_text string").option("maxFilesPerTrigger", files).parquet(source)
    stage_stream(fetched, current, f"{out}/queue", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("act_code string, section_number string, staged_text string, summary string, status string").parquet(f"{out}/queue")
