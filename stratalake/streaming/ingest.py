"""Structured Streaming into Bronze.

Late corrections must win in Silver, so the stream keeps every delivery and drops nothing by watermark.  The number of a
micro-batch is published in the same log file as its rows, so a batch that a failure repeats isn't appended again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.bronze import land, stamp
from ..sources.store import Lakehouse


def stream_to_bronze(lake: Lakehouse, raw: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of raw records as one snapshot; with ``once`` stop when all that is there was read."""

    def append(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            # Spark gives every checkpoint an id of its own, also one that is made anew in the same folder
            stream = json.loads(lake._read(f"{checkpoint.rstrip('/')}/metadata"))["id"]
            land(lake, table, stamp(batch), (stream, batch_id))

    writer = raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys; state older than the watermark goes."""
    from pyspark.sql import functions as F

    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
