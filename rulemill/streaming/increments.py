"""Change capture as a stream: an append-only log of file states kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_states(log: DataFrame) -> DataFrame:
    """(file_id, modified_at): the last state of each file in a log of states."""
    return log.groupBy("file_id").agg(F.max("modified_at").alias("modified_at"))


def follow(log: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of a streaming log, reduced to last states, to ``apply(changed, batch_id)``. Runs until what is there is taken."""
    return log.writeStream.foreachBatch(lambda df, i: apply(latest_states(df), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_by_window(events: DataFrame, span: str = "1 day", late: str = "2 days") -> DataFrame:
    """(begin, event_type, n, total) by tumbling window, with a watermark; works on tables and streams."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")
