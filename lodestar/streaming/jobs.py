"""Streaming views of events and jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Events as their files arrive; ts becomes the event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; events later than the watermark go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Idempotency: each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, stale: str = "15 minutes") -> DataFrame:
    """(user_id, status, events, last_ts): the running state of each job key; a key without an event for longer
    than the limit in event time comes out once as stale."""
    limit = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last, kind = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "status": ["stale"], "events": [n], "last_ts": [pd.Timestamp(last, unit="ms")]})
            return
        n, last, kind = state.get if state.exists else (0, 0, "")
        for b in batches:
            n += len(b)
            k = b["ts"].idxmax()
            t = int(b["ts"][k].timestamp() * 1000)
            if t >= last:
                last, kind = t, str(b["event_type"][k])
        state.update((n, last, kind))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "status": [kind], "events": [n], "last_ts": [pd.Timestamp(last, unit="ms")]})

    return events.withWatermark("ts", "1 minute").groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, events long, last_ts timestamp", "n long, last long, kind string", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that is there, into Parquet."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
