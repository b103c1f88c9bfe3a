"""Queries that run a stream over the event files, beside their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rows as R
from quarry.plans.registry import query
from quarry.session import load
from quarry.streaming import activity


@query("""SELECT CAST(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS began, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def tumbling_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type (an extension); the same transform serves a stream."""
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return activity.windowed(e).select(F.unix_timestamp("window.start").alias("began"), "event_type", "events")


@query("""WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'REPLIED' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'CONTACTED' WHEN 'purchase' THEN 'WON' ELSE 'LOST' END AS st,
  CASE event_type WHEN 'signup' THEN 4 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 7 END AS rk FROM events)
SELECT user_id, coalesce(first(st ORDER BY ts DESC, event_id DESC) FILTER (WHERE rk = 7), first(st ORDER BY rk DESC)) AS state, count(*) AS events FROM r GROUP BY 1""")
def stream_states(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's state as the stream keeps it, after all events, state by state."""
    stream = activity.states(activity.read_events(spark, sf))
    out = activity.run_to_files(stream, "update")
    return R.last_wins(out, F.col("user_id"), F.col("events"), keep_keyless=False).select("user_id", "state", "events")
