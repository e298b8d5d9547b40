"""Status and message streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.status import routed


def latest_status(events: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """Latest state of each key of a stream; write in update or complete mode. State is one row for each key."""
    return events.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


def counted(events: DataFrame, by: str, ts: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events for each key and window; the watermark bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def drain(messages: DataFrame, registry: DataFrame, key: str, default: str, path: str, checkpoint: str, every: str | None = "50 milliseconds") -> StreamingQuery:
    """Route a stream of messages to a folder for each sink, in micro-batches; without ``every`` until what is there now is drained."""
    out = routed(messages, registry, key, default)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return out.writeStream.partitionBy("sink").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
