"""Event-time windows over the event stream, redelivery, and running a stream to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The events of a folder as a stream; ts is a timestamp, as watermarks ask for."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet")
    return read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, width: str, slide: str | None = None, late: str = "30 days") -> DataFrame:
    """start, event_type, n for tumbling (or, with slide, sliding) windows, which are aligned to 1970-01-01."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    n = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "30 days") -> DataFrame:
    """user_id, start, n for runs of a user's events with less than gap between them."""
    n = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def once(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event_id once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What the stream has given when its present input is used up: its last state (complete), or all it appended.

    Results and progress are in the shared folder. A batch that runs again replaces what it wrote before.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'batch=%d' % batch_id if mode == 'append' else 'state'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{'*' if mode == 'append' else 'state'}")
