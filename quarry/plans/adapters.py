"""Views of the driver's tables in the terms of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import signals as S
from quarry.session import load

REFERENCE = "1999-06-01"


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """(lead_key, kind, confidence): line items as signal events of their order."""
    kind = F.when(F.col("l_returnflag") == "R", "denied").when(F.col("l_returnflag") == "A", "continued").when(F.col("l_linestatus") == "F", "staff_concern")
    events = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lead_key"), kind.alias("kind"), (F.lit(0.55).cast("decimal(4,2)") + F.col("l_discount").cast("decimal(4,2)")).alias("confidence"))
    return events.where("kind is not null")


def order_friction(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_by_key(order_events(spark, sf), ["lead_key"], "kind", F.col("confidence"))


def lead_view(spark: SparkSession, sf: str, reference: str = REFERENCE) -> DataFrame:
    """One row per order with everything the queue looks at."""
    orders = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("lead_key"), F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("kind_of_work"), F.col("o_totalprice").alias("value"),
    )
    ref = F.lit(reference).cast("date")
    joined = orders.join(order_friction(spark, sf), "lead_key", "left")
    base = joined.select(
        "lead_key", "custkey", "event_date", "kind_of_work", "value",
        F.coalesce("score", F.lit(0)).alias("friction_score"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
        F.datediff("event_date", ref).cast("bigint").alias("days_until_event"), (F.col("event_date") > ref).alias("future"),
        F.col("kind_of_work").isin("1-URGENT", "2-HIGH").alias("actionable"),
    )
    critical = F.arrays_overlap("signals", F.array(*[F.lit(x) for x in ("denied", "withdrawn", "recommended_denial", "appeal")]))
    asks = (F.col("friction_score"), F.col("future"), F.col("actionable"), F.col("days_until_event"), critical)
    return base.select("*", S.queue_score(*asks).alias("priority_score"), S.queue_level(*asks).alias("priority"), S.urgency(F.col("days_until_event"), F.col("future")).alias("urgency"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows, each delivered once, with their application's key."""
    e = load(spark, sf, "investigation_evidence")
    return e.dropDuplicates(["evidence_id"]).withColumn("app", T.record_key(F.col("entity_identifier")))


LEAD_SQL = """
WITH e AS (
  SELECT l_orderkey AS lead_key,
    CASE WHEN l_returnflag = 'R' THEN 'denied' WHEN l_returnflag = 'A' THEN 'continued' WHEN l_linestatus = 'F' THEN 'staff_concern' END AS kind,
    CAST(0.55 AS DECIMAL(4,2)) + CAST(l_discount AS DECIMAL(4,2)) AS confidence
  FROM lineitem
), per_kind AS (
  SELECT lead_key, kind, max(confidence) AS c FROM e WHERE kind IS NOT NULL GROUP BY 1, 2
), scored AS (
  SELECT lead_key,
    CAST(least(round_even(sum(c * CASE kind WHEN 'denied' THEN 60 WHEN 'continued' THEN 20 ELSE 30 END)
      + CASE WHEN bool_or(kind = 'denied') AND bool_or(kind = 'continued') THEN 10 ELSE 0 END, 0), 100) AS BIGINT) AS score,
    list_sort(list(kind)) AS signals
  FROM per_kind GROUP BY 1
), base AS (
  SELECT o_orderkey AS lead_key, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS kind_of_work, o_totalprice AS value,
    coalesce(score, 0) AS friction_score, coalesce(signals, []) AS signals,
    CAST(date_diff('day', DATE '1999-06-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(o_orderdate AS DATE) > DATE '1999-06-01' AS future,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS actionable, coalesce(list_contains(signals, 'denied'), false) AS critical
  FROM orders LEFT JOIN scored ON o_orderkey = lead_key
), leads AS (
  SELECT *,
    CAST(least(friction_score + CASE WHEN future THEN 25 ELSE 0 END + CASE WHEN actionable THEN 15 ELSE 0 END
      + CASE WHEN future AND days <= 7 THEN 35 WHEN future AND days <= 30 THEN 20 WHEN future AND days <= 90 THEN 10 ELSE 0 END
      + CASE WHEN critical THEN 20 ELSE 0 END, 250) AS BIGINT) AS priority_score,
    CASE WHEN NOT future THEN 'ARCHIVED'
      WHEN (friction_score >= 70 AND actionable) OR (critical AND actionable) OR (days <= 7 AND (friction_score >= 20 OR actionable)) THEN 'HIGH'
      WHEN friction_score >= 20 OR actionable OR days <= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    CASE WHEN NOT future THEN 'HISTORICAL' WHEN days <= 7 THEN 'URGENT' WHEN days <= 30 THEN 'SOON' ELSE 'UPCOMING' END AS urgency
  FROM base
)
"""
