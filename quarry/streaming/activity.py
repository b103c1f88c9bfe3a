"""Streams of events: windows with a watermark, and the keyed state machine. Extensions but for the state machine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import lifecycle as L
from quarry.session import ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1, glob: str = "events*.parquet") -> DataFrame:
    """Event files as a stream; the time column is a TIMESTAMP, which watermarks need."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; rows later than the watermark are dropped by a stream, never by a batch."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, state, events) after each micro-batch, kept per key across batches.

    Events count in order of time within a batch and never rewind across batches; a late one still
    passes the transition, which ignores what would go back in rank.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("NEW", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for e in rows["event"]:
            now = L.after(now, e)
        n += len(rows)
        state.update((now, n))
        yield pd.DataFrame({key: [k[0]], "state": [now], "events": [n]})

    named = F.try_element_at(F.create_map(*[F.lit(x) for x in L.EVENTS_TO_STATES]), F.col("event_type"))
    rows = events.select(key, "ts", "event_id", named.alias("event"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} bigint, state string, events bigint", "state string, events bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there; each micro-batch's output is appended to files in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
        .option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    )
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
