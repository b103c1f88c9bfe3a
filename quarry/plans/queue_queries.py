"""Queries over leads and signal events: scores, resolution, queues and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import rows as R
from quarry.operators import signals as S
from quarry.plans.adapters import LEAD_SQL, evidence, lead_view, order_friction
from quarry.plans.registry import query
from quarry.session import load


@query(LEAD_SQL + "SELECT lead_key, friction_score, array_to_string(signals, ',') AS signals, days AS days_until_event, priority_score, priority, urgency, c_mktsegment AS segment FROM leads JOIN customer ON custkey = c_custkey")
def lead_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Every lead with its score, level and urgency, beside its customer's segment."""
    customer = load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    leads = lead_view(spark, sf).join(customer, "custkey")
    return leads.select("lead_key", "friction_score", F.array_join("signals", ",").alias("signals"), "days_until_event", "priority_score", "priority", "urgency", "segment")


@query(LEAD_SQL + """SELECT lead_key, priority, priority_score, friction_score, days AS days_until_event FROM leads
ORDER BY CASE priority WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END DESC, priority_score DESC, friction_score DESC, days, lead_key LIMIT 20""")
def lead_queue_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty of the queue by rank, score, friction and nearness."""
    c = F.col
    return lead_view(spark, sf).orderBy(*S.queue_order(c("priority"), c("priority_score"), c("friction_score"), c("days_until_event"), c("lead_key"))).limit(20).select("lead_key", "priority", "priority_score", "friction_score", "days_until_event")


@query(LEAD_SQL + """SELECT lead_key, priority, priority_score, CAST(event_date AS VARCHAR) AS event_date FROM leads
ORDER BY CASE priority WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END DESC, priority_score DESC, event_date NULLS LAST, lead_key LIMIT 20""")
def lead_queue_by_date_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty of the same queue when the earliest date breaks ties."""
    c = F.col
    return lead_view(spark, sf).orderBy(*S.queue_order_by_date(c("priority"), c("priority_score"), c("event_date"), c("lead_key"))).limit(20).select("lead_key", "priority", "priority_score", c("event_date").cast("string").alias("event_date"))


@query(LEAD_SQL + "SELECT lead_key, kind_of_work, priority_score FROM (SELECT *, row_number() OVER (PARTITION BY kind_of_work ORDER BY priority_score DESC, lead_key) AS n FROM leads) WHERE n <= 8")
def queue_top8_per_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best leads of every kind of work."""
    return R.top_per(lead_view(spark, sf), ["kind_of_work"], 8, F.col("priority_score").desc(), F.col("lead_key")).select("lead_key", "kind_of_work", "priority_score")


@query(LEAD_SQL + "SELECT priority, urgency, count(*) AS leads, min(priority_score) AS least, max(priority_score) AS most FROM leads GROUP BY 1, 2")
def priority_bands(spark: SparkSession, sf: str) -> DataFrame:
    return lead_view(spark, sf).groupBy("priority", "urgency").agg(F.count("*").alias("leads"), F.min("priority_score").alias("least"), F.max("priority_score").alias("most"))


@query(LEAD_SQL + "SELECT lead_key, score, array_to_string(signals, ',') AS signals FROM scored")
def friction_score_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every order's signal events."""
    return order_friction(spark, sf).select("lead_key", "score", F.array_join("signals", ",").alias("signals"))


@query("""WITH k AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'appeal' WHEN 'view' THEN 'amended' WHEN 'click' THEN 'continued' WHEN 'purchase' THEN 'denied' ELSE 'recommended_denial' END AS kind,
  max(CAST(0.5 + value / 1000 AS DECIMAL(6,4))) AS c FROM events GROUP BY 1, 2)
SELECT user_id, CAST(least(round_even(sum(c * CASE kind WHEN 'appeal' THEN 35 WHEN 'amended' THEN 15 WHEN 'continued' THEN 20 WHEN 'denied' THEN 60 ELSE 50 END)
  + CASE WHEN bool_or(kind = 'recommended_denial') AND bool_or(kind = 'denied') THEN 20 ELSE 0 END + CASE WHEN bool_or(kind = 'denied') AND bool_or(kind = 'continued') THEN 10 ELSE 0 END
  + CASE WHEN bool_or(kind = 'recommended_denial') AND bool_or(kind = 'continued') THEN 10 ELSE 0 END, 0), 100) AS BIGINT) AS score FROM k GROUP BY 1""")
def friction_score_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """The same score over the event stream, each event type standing for a kind of signal."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "appeal", "view", "amended", "click", "continued", "purchase", "denied", "error", "recommended_denial")])
    events = load(spark, sf, "events").select("user_id", F.try_element_at(kinds, F.col("event_type")).alias("kind"), (0.5 + F.col("value") / 1000).alias("c"))
    return S.score_by_key(events, ["user_id"], "kind", F.col("c")).select("user_id", "score")


@query("""SELECT user_id, event_type, day, event_id FROM (SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id,
  row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1""")
def event_dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    """One event per user, type and day: the one of best evidence."""
    events = load(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "event_id", "value")
    return S.best_events(events, ["user_id", "event_type", "day"], F.col("value"), F.col("event_id")).select("user_id", "event_type", "day", "event_id")


@query("""WITH r AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, value, event_id,
  CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 80 WHEN 'click' THEN 60 WHEN 'view' THEN 40 ELSE 10 END AS rnk, CAST(floor(value / 5) AS BIGINT) AS score,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type || '@' || CAST(event_id % 12 + 1 AS VARCHAR) || ':00' END AS tm FROM events)
SELECT user_id, day, first(event_type ORDER BY rnk DESC, score DESC, (tm IS NOT NULL) DESC, event_id) AS label,
  first(tm ORDER BY rnk DESC, score DESC, event_id) FILTER (WHERE tm IS NOT NULL) AS time, first(props ORDER BY length(props) DESC, r.event_id) AS context, max(score) AS score,
  CAST(round_even(least(greatest(0.55 + CAST(max(score) AS DECIMAL(10,3)) / 250, 0.5), 0.99), 2) AS DOUBLE) AS confidence
FROM r JOIN events USING (event_id, user_id) GROUP BY 1, 2""".replace("first(event_type", "first(r.event_type"))
def date_group_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """One resolved row per user and day: label, time, context and confidence, each by its own order."""
    e = load(spark, sf, "events")
    rank = F.create_map(*[F.lit(x) for x in ("purchase", 100, "signup", 80, "click", 60, "view", 40, "error", 10)])
    time = F.when(F.col("event_id") % 3 != 0, F.concat("event_type", F.lit("@"), (F.col("event_id") % 12 + 1).cast("string"), F.lit(":00")))
    rows = e.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "event_id", "props", F.floor(F.col("value") / 5).alias("s"), time.alias("tm"))
    return S.resolve_groups(rows, ["user_id", "day"], F.col("event_type"), F.try_element_at(rank, F.col("event_type")), F.col("s"), F.col("tm"), F.col("props"), F.col("event_id"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1""")
def next_event(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of every user after a reference time."""
    later = load(spark, sf, "events").where(F.col("ts") > F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return later.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, length(props) DESC, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1""")
def best_event_of_type(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's best event of one type by confidence and length of evidence."""
    bought = load(spark, sf, "events").where("event_type = 'purchase'")
    return bought.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", F.length("props"), -F.col("event_id"))).alias("event_id"))


@query("""WITH d AS (SELECT unnest(['denied','withdrawn','recommended_denial','tabled','continued','staff_concern','additional_information','amended','appeal','neighborhood_concern','public_opposition']) AS s, unnest(range(11)) AS r),
x AS (SELECT lead_id, unnest(list_distinct(list_concat(coalesce(friction_signals, []), coalesce(status, [])))) AS s FROM opportunity)
SELECT o.lead_id, min_by(d.s, d.r) AS dominant, coalesce(bool_or(d.s IN ('denied','withdrawn','appeal')), false) AS critical FROM opportunity o LEFT JOIN x USING (lead_id) LEFT JOIN d ON d.s = x.s GROUP BY 1""")
def dominant_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest signal among a lead's signals and status markers, and whether a critical one is there."""
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("friction_signals", none), F.coalesce("status", none))
    leads = load(spark, sf, "opportunity").select("lead_id", both.alias("s"))
    critical = F.coalesce(F.arrays_overlap(F.filter("s", lambda x: x.isNotNull()), F.array(F.lit("denied"), F.lit("withdrawn"), F.lit("appeal"))), F.lit(False))
    return leads.select("lead_id", S.dominant(F.col("s")).alias("dominant"), critical.alias("critical"))


@query("""WITH e AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, field FROM investigation_evidence WHERE trim(entity_identifier) <> '')
SELECT evidence_id, count(*) OVER (PARTITION BY app, field) > 1 AS recurs FROM e""")
def recurrence_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the same kind of evidence recurs for its application.

    Counted by an aggregate and joined back, so an application that holds a third of all rows is not sorted in one task.
    """
    e = evidence(spark, sf).where("app is not null").select("evidence_id", "app", "field")
    n = e.groupBy("app", "field").agg(F.count("*").alias("n"))
    return e.join(n, (e["app"] == n["app"]) & e["field"].eqNullSafe(n["field"])).select("evidence_id", (F.col("n") > 1).alias("recurs"))


@query("""SELECT count(*) AS total, count_if(priority = 'HIGH') AS high, count_if(friction_score >= 40) AS high_friction, count_if(next_project_date > DATE '2026-01-01') AS upcoming,
  count_if(applicant_email IS NOT NULL OR applicant_phone IS NOT NULL) AS contactable, CAST(sum(coalesce(friction_score, 0)) AS BIGINT) AS friction_sum, count(DISTINCT upper(trim(application_number))) AS applications FROM opportunity""")
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts over all leads, in one pass."""
    c = F.col
    return load(spark, sf, "opportunity").agg(
        F.count("*").alias("total"), F.count_if(c("priority") == "HIGH").alias("high"), F.count_if(c("friction_score") >= 40).alias("high_friction"),
        F.count_if(c("next_project_date") > F.lit("2026-01-01").cast("date")).alias("upcoming"), F.count_if(c("applicant_email").isNotNull() | c("applicant_phone").isNotNull()).alias("contactable"),
        F.sum(F.coalesce("friction_score", F.lit(0))).alias("friction_sum"), F.count_distinct(F.upper(F.trim("application_number"))).alias("applications"),
    )


@query("SELECT v.priority, coalesce(n, 0) AS leads FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(priority) LEFT JOIN (SELECT priority, count(*) AS n FROM opportunity GROUP BY 1) USING (priority)")
def priority_histogram_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "opportunity").groupBy("priority").agg(F.count("*").alias("leads"))
    return R.zero_filled(counts, "priority", "leads", ["HIGH", "MEDIUM", "LOW"])


@query("SELECT DISTINCT trim(application_type) AS application_type FROM opportunity WHERE trim(application_type) <> '' ORDER BY 1")
def distinct_types_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "opportunity").select(T.blank_to_null(F.col("application_type")).alias("application_type")).where("application_type is not null").distinct().orderBy("application_type")


@query("""SELECT lead_id FROM opportunity WHERE upper(coalesce(priority, '')) = 'HIGH' AND friction_score >= 20 AND municipality IS NOT NULL AND lower(trim(municipality)) IN ('ostley', 'tarnwick')
  AND created_at >= TIMESTAMP '2025-06-01' - INTERVAL 365 DAY AND coalesce(list_has_any(friction_signals, ['denied', 'continued', 'appeal']), false)""")
def filters_conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    """Several optional filters at once: case-blind equality, thresholds, sets and recency to a given now."""
    o, c = load(spark, sf, "opportunity"), F.col
    since = F.lit("2025-06-01").cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")
    wanted = F.array(*[F.lit(x) for x in ("denied", "continued", "appeal")])
    keep = [F.upper(F.coalesce("priority", F.lit(""))) == "HIGH", c("friction_score") >= 20, F.lower(F.trim("municipality")).isin("ostley", "tarnwick"), c("created_at") >= since, F.arrays_overlap("friction_signals", wanted)]
    for k in keep:
        o = o.where(k)
    return o.select("lead_id")
