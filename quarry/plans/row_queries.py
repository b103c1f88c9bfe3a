"""Queries over keyed rows: deduplication, joins, overlays, intervals, versions, sets and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import text as T
from quarry.operators import rows as R
from quarry.operators import signals as S
from quarry.operators.lifecycle import EVENTS_TO_STATES, fold_states
from quarry.plans.adapters import evidence
from quarry.plans.registry import query
from quarry.session import load


@query("""SELECT lead_id FROM (SELECT lead_id, nullif(upper(trim(application_number)), '') AS k, row_number() OVER (PARTITION BY nullif(upper(trim(application_number)), '') ORDER BY created_at, lead_id) AS n FROM opportunity) WHERE n = 1 OR k IS NULL""")
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first extraction of every application; rows without a number are all kept."""
    o = load(spark, sf, "opportunity").select("lead_id", "application_number", "created_at")
    return R.first_wins(o, T.record_key(F.col("application_number")), F.col("created_at"), F.col("lead_id")).select("lead_id")


@query("""SELECT doc_id, h AS host FROM (SELECT doc_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www[.]', '') AS h, row_number() OVER (PARTITION BY regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www[.]', '') ORDER BY published_at DESC NULLS LAST, doc_id DESC) AS n FROM documents WHERE url IS NOT NULL) WHERE n = 1 AND h <> ''""")
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The latest document of every host."""
    d = load(spark, sf, "documents").select("doc_id", T.host(F.col("url")).alias("host"), "published_at")
    return R.last_wins(d, F.col("host"), F.col("published_at"), F.col("doc_id"), keep_keyless=False).select("doc_id", "host")


@query("""WITH e AS (SELECT DISTINCT evidence_id, field, lower(value) AS v, source_url FROM investigation_evidence) SELECT evidence_id FROM (SELECT evidence_id, row_number() OVER (PARTITION BY field, v, source_url ORDER BY evidence_id) AS n FROM e) WHERE n = 1""")
def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first evidence of every field, value without case, and source."""
    e = evidence(spark, sf)
    return e.groupBy("field", F.lower("value").alias("v"), "source_url").agg(F.min("evidence_id").alias("evidence_id")).select("evidence_id")


@query("""WITH e AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, source_type, lower(trim(value)) AS claim, confidence_score FROM investigation_evidence WHERE trim(entity_identifier) <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY app, source_type, claim ORDER BY confidence_score DESC NULLS LAST, evidence_id) AS n FROM e)
SELECT evidence_id, app, printf('E%04d', row_number() OVER (PARTITION BY app ORDER BY evidence_id)) AS registry_id FROM b WHERE n = 1""")
def evidence_registry_best(spark: SparkSession, sf: str) -> DataFrame:
    """Per application the surest evidence of every claim, numbered E0001 and on: what a registry that replaces would hold."""
    e = evidence(spark, sf).where("app is not null").select("evidence_id", "app", "source_type", F.lower(F.trim("value")).alias("claim"), "confidence_score")
    order = F.struct(F.coalesce("confidence_score", F.lit(float("-inf"))), -F.col("evidence_id"))
    best = e.groupBy("app", "source_type", "claim").agg(F.max_by("evidence_id", order).alias("evidence_id"))
    return R.numbered(best.select("evidence_id", "app"), ["app"], ["evidence_id"], "n").select("evidence_id", "app", F.format_string("E%04d", "n").alias("registry_id"))


@query("""WITH e AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, source_type, lower(trim(value)) AS claim, coalesce(confidence_score, -1) AS c FROM investigation_evidence WHERE trim(entity_identifier) <> ''),
b AS (SELECT *, max(c) OVER (PARTITION BY app, source_type, claim ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT evidence_id, app, printf('E%04d', row_number() OVER (PARTITION BY app ORDER BY evidence_id)) AS registry_id FROM b WHERE top IS NULL OR c > top""")
def evidence_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence registered in order: a claim that is already there is added again only with a higher confidence."""
    e = evidence(spark, sf).where("app is not null").select("evidence_id", "app", "source_type", F.lower(F.trim("value")).alias("claim"), F.coalesce("confidence_score", F.lit(-1.0)).alias("c"))
    kept = R.rising(e, ["app", "source_type", "claim"], ["evidence_id"], "c")
    return R.numbered(kept.select("evidence_id", "app"), ["app"], ["evidence_id"], "n").select("evidence_id", "app", F.format_string("E%04d", "n").alias("registry_id"))


@query("""WITH c AS (SELECT candidate_id, upper(trim(application_number)) AS app, contact_type, confidence, source_type, value FROM contact_candidate WHERE trim(application_number) <> '')
SELECT app, contact_type, first(candidate_id ORDER BY confidence DESC NULLS LAST, candidate_id) AS candidate_id FROM c GROUP BY 1, 2""")
def contact_best(spark: SparkSession, sf: str) -> DataFrame:
    """The surest contact of every application and type."""
    c = load(spark, sf, "contact_candidate").select("candidate_id", T.record_key(F.col("application_number")).alias("app"), "contact_type", "confidence").where("app is not null")
    order = F.struct(F.coalesce("confidence", F.lit(float("-inf"))), -F.col("candidate_id"))
    return R.best_per(c, ["app", "contact_type"], order, candidate_id=F.col("candidate_id"))


SOURCE_CASE = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.SOURCE_RANK.items()) + " ELSE 99 END"


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, upper(trim(application_number)) AS app, contact_type, lower(trim(value)) AS v, {SOURCE_CASE} AS r, round(coalesce(confidence, 0) - CASE WHEN is_generic THEN 0.1 ELSE 0 END, 6) AS conf
  FROM contact_candidate WHERE trim(application_number) <> '' AND trim(value) <> '')
SELECT candidate_id, app FROM (SELECT *, row_number() OVER (PARTITION BY app, contact_type, v ORDER BY r, conf DESC, candidate_id) AS n FROM c) WHERE n = 1""")
def contact_by_source_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Per written contact the row to keep: by rank of its source, then confidence, a tenth less for a role's mailbox."""
    return ranked_contacts(spark, sf).groupBy("app", "contact_type", "v").agg(F.min(F.struct("r", "c", "candidate_id")).alias("b")).select("b.candidate_id", "app")


def ranked_contacts(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "contact_candidate")
    rank = F.coalesce(F.try_element_at(S.literal_map(K.SOURCE_RANK), F.col("source_type")), F.lit(99))
    sure = F.round(F.coalesce("confidence", F.lit(0.0)) - F.when(F.col("is_generic"), 0.1).otherwise(0.0), 6)
    rows = c.select("candidate_id", T.record_key(F.col("application_number")).alias("app"), "contact_type", F.lower(F.trim("value")).alias("v"), F.coalesce("is_generic", F.lit(False)).alias("g"), rank.alias("r"), (-sure).alias("c"))
    return rows.where("app is not null and v <> ''")


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, upper(trim(application_number)) AS app, contact_type, {SOURCE_CASE} AS r, coalesce(is_generic, false) AS g, round(coalesce(confidence, 0) - CASE WHEN is_generic THEN 0.1 ELSE 0 END, 6) AS conf FROM contact_candidate WHERE trim(application_number) <> '' AND trim(value) <> '')
SELECT app, contact_type, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY app, contact_type ORDER BY contact_type = 'email' AND g, r, conf DESC, candidate_id) AS n FROM c) WHERE n = 1""")
def preferred_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The contact to use for every application and type; an e-mail of a role only where there is no other."""
    role = (F.col("contact_type") == "email") & F.col("g")
    return ranked_contacts(spark, sf).groupBy("app", "contact_type").agg(F.min(F.struct(role.alias("role"), F.col("r"), F.col("c"), F.col("candidate_id"))).alias("b")).select("app", "contact_type", "b.candidate_id")


@query("""SELECT evidence_id FROM (SELECT evidence_id, row_number() OVER (PARTITION BY field, value, source_url ORDER BY evidence_id) AS n FROM (SELECT DISTINCT evidence_id, field, value, source_url FROM investigation_evidence)) WHERE n = 1""")
def evidence_dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The first evidence of every field, value as written, and source."""
    return evidence(spark, sf).groupBy("field", "value", "source_url").agg(F.min("evidence_id").alias("evidence_id")).select("evidence_id")


@query("""WITH m AS (SELECT match_id, discovered_locality, match_score, row_number() OVER (PARTITION BY discovered_locality, match_score, source_url ORDER BY match_id) AS d FROM identity_match WHERE discovered_locality IS NOT NULL)
SELECT match_id, discovered_locality FROM (SELECT *, row_number() OVER (PARTITION BY discovered_locality ORDER BY match_score DESC NULLS LAST, match_id) AS n FROM m WHERE d = 1) WHERE n <= 20""")
def identity_top20(spark: SparkSession, sf: str) -> DataFrame:
    """Per place the twenty best findings, equal score and page counted once."""
    m = load(spark, sf, "identity_match").where("discovered_locality is not null")
    one = m.groupBy("discovered_locality", "match_score", "source_url").agg(F.min("match_id").alias("match_id"))
    return R.top_per(one, ["discovered_locality"], 20, F.col("match_score").desc_nulls_last(), F.col("match_id")).select("match_id", "discovered_locality")


@query("""WITH reg AS (SELECT DISTINCT source_domain FROM contact_candidate WHERE source_domain IS NOT NULL) SELECT DISTINCT e.evidence_id FROM investigation_evidence e WHERE e.source_domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.source_domain = e.source_domain)""")
def new_records(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence whose domain no contact candidate names."""
    return R.new_records(evidence(spark, sf).select("evidence_id", "source_domain"), load(spark, sf, "contact_candidate").where("source_domain is not null"), "source_domain").select("evidence_id")


@query("""SELECT DISTINCT e.evidence_id FROM investigation_evidence e WHERE EXISTS (SELECT 1 FROM identity_evidence c WHERE c.source_domain = e.source_domain)""")
def known_records(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence whose domain the other evidence table knows."""
    return R.known_records(evidence(spark, sf).select("evidence_id", "source_domain"), load(spark, sf, "identity_evidence"), "source_domain").select("evidence_id")


@query("""SELECT doc_id, coalesce(record_type IN ('staff_report', 'minutes'), false) AS is_packet FROM documents""")
def packet_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Packets and their complement, which nulls belong to."""
    d = load(spark, sf, "documents").select("doc_id", "record_type")
    packet = F.coalesce(F.col("record_type").isin("staff_report", "minutes"), F.lit(False))
    return R.union_sources(d.where(packet).select("doc_id", F.lit(True).alias("is_packet")), d.where(~packet).select("doc_id", F.lit(False).alias("is_packet")))


@query("""WITH e AS (SELECT upper(trim(entity_identifier)) AS app, count(DISTINCT evidence_id) AS n, max(confidence_score) AS best FROM investigation_evidence WHERE trim(entity_identifier) <> '' GROUP BY 1),
c AS (SELECT upper(trim(application_number)) AS app, count(DISTINCT candidate_id) AS n FROM contact_candidate WHERE trim(application_number) <> '' GROUP BY 1)
SELECT o.lead_id, coalesce(e.n, 0) AS evidence, coalesce(e.best, 0) AS best, coalesce(c.n, 0) AS contacts FROM opportunity o LEFT JOIN e ON e.app = upper(trim(o.application_number)) LEFT JOIN c ON c.app = upper(trim(o.application_number))""")
def left_join_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Leads beside what evidence and contacts their application has, zeros where it has none.

    Both sides are aggregated to one row per application first, so a hot application multiplies nothing.
    """
    e = evidence(spark, sf).where("app is not null").groupBy("app").agg(F.count_distinct("evidence_id").alias("evidence"), F.max("confidence_score").alias("best"))
    c = load(spark, sf, "contact_candidate").select(T.record_key(F.col("application_number")).alias("app"), "candidate_id").where("app is not null").groupBy("app").agg(F.count_distinct("candidate_id").alias("contacts"))
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"))
    return R.with_defaults(o, "app", {"evidence": F.lit(0), "best": F.lit(0.0), "contacts": F.lit(0)}, e, c).drop("app")


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier)
SELECT coalesce(c.c_custkey, o.k) AS k, coalesce(o.name, c.c_name) AS name, coalesce(o.bal, c.c_acctbal) AS bal FROM customer c FULL JOIN o ON o.k = c.c_custkey""")
def state_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A stored state overlaid with a newer one, field by field where that is not null."""
    base = load(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal")
    over = load(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS bal")
    return R.overlay(base, over, "k", ["name", "bal"])


@query("""SELECT e.event_id, CAST(floor(epoch(min(f.ts))) AS BIGINT) AS next_at FROM events e
  LEFT JOIN events f ON f.user_id = e.user_id AND f.event_type <> e.event_type AND (f.ts > e.ts OR (f.ts = e.ts AND f.event_id > e.event_id)) GROUP BY e.event_id""")
def interval_next_other(spark: SparkSession, sf: str) -> DataFrame:
    """How far every event's span reaches: to the user's next event of another type."""
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return R.next_other(e, ["user_id"], ["ts", "event_id"], "event_type", "ts").select("event_id", F.unix_timestamp(F.col("next_other_at").cast("timestamp")).alias("next_at"))


@query("""WITH b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events)
SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS events, min(event_id) AS first_id FROM b GROUP BY 1, 2""")
def range_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The events of every block that an opening event starts; those before the first share block 0."""
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return R.blocks(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "block").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


@query("""WITH u AS (SELECT nullif(upper(trim(application_number)), '') AS app, lead_id, priority, updated_at, created_at FROM opportunity)
SELECT app, first(lead_id ORDER BY updated_at DESC NULLS LAST, lead_id DESC) AS lead_id, first(priority ORDER BY updated_at DESC NULLS LAST, lead_id DESC) AS priority FROM u WHERE app IS NOT NULL GROUP BY 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A lead table after all late updates: the last one of every application counts; keyless changes are skipped."""
    u = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", "priority", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("updated_at"))
    return R.upsert(u.limit(0), u, "app", F.col("updated_at"), F.col("lead_id")).select("app", "lead_id", "priority")


@query("""WITH u AS (SELECT nullif(upper(trim(application_number)), '') AS app, lead_id, priority, coalesce(updated_at, TIMESTAMP '0001-01-01') AS t FROM opportunity),
stored AS (SELECT app, first(lead_id ORDER BY t DESC, lead_id DESC) AS lead_id, first(priority ORDER BY t DESC, lead_id DESC) AS priority FROM u WHERE app IS NOT NULL AND t < TIMESTAMP '2024-01-01' GROUP BY 1),
late AS (SELECT app, first(lead_id ORDER BY t DESC, lead_id DESC) AS lead_id, first(priority ORDER BY t DESC, lead_id DESC) AS priority FROM u WHERE app IS NOT NULL AND t >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT coalesce(l.app, s.app) AS app, coalesce(l.lead_id, s.lead_id) AS lead_id, CASE WHEN l.app IS NOT NULL THEN l.priority ELSE s.priority END AS priority FROM stored s FULL JOIN late l ON l.app = s.app""")
def upsert_onto_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Late updates put over a stored lead table: changed applications are replaced, new ones added, the others kept."""
    u = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", "priority", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("updated_at"))
    since = F.lit("2024-01-01").cast("timestamp_ntz")
    stored = R.upsert(u.limit(0), u.where(F.col("updated_at") < since), "app", F.col("updated_at"), F.col("lead_id"))
    return R.upsert(stored, u.where(F.col("updated_at") >= since), "app", F.col("updated_at"), F.col("lead_id")).select("app", "lead_id", "priority")


@query("""WITH d AS (SELECT DISTINCT evidence_id, upper(trim(application_number)) AS app, observed_at, confidence FROM identity_evidence WHERE trim(application_number) <> '' AND observed_at IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY observed_at, evidence_id) AS version, coalesce(confidence >= 0.5, false) AS final FROM d)
SELECT app, max(version) AS versions, max(version) FILTER (WHERE final) AS last_final, count_if(NOT final) AS drafts FROM v GROUP BY 1""")
def draft_and_final_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of an artifact, the sure ones final and the others drafts: how many, and the last final one."""
    d = load(spark, sf, "identity_evidence").select("evidence_id", T.record_key(F.col("application_number")).alias("app"), "observed_at", "confidence").where("app is not null and observed_at is not null").dropDuplicates(["evidence_id"])
    v = R.numbered(d, ["app"], ["observed_at", "evidence_id"], "version").withColumn("final", F.coalesce(F.col("confidence") >= 0.5, F.lit(False)))
    return v.groupBy("app").agg(F.max("version").alias("versions"), F.max(F.when(F.col("final"), F.col("version"))).alias("last_final"), F.count_if(~F.col("final")).alias("drafts"))


@query("""WITH f AS (SELECT upper(trim(application_number)) AS app, max(priority_score) AS score FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1), e AS (SELECT upper(trim(application_number)) AS app, count(DISTINCT candidate_id) AS contacts FROM contact_candidate WHERE trim(application_number) <> '' GROUP BY 1),
d AS (SELECT upper(trim(application_number)) AS app, CAST(min(observed_at)::DATE AS VARCHAR) AS first_day FROM identity_evidence WHERE trim(application_number) <> '' GROUP BY 1)
SELECT lead_id, coalesce(score, 0) AS score, coalesce(contacts, 0) AS contacts, coalesce(first_day, '') AS first_day FROM opportunity o LEFT JOIN f ON f.app = upper(trim(o.application_number)) LEFT JOIN e ON e.app = upper(trim(o.application_number)) LEFT JOIN d ON d.app = upper(trim(o.application_number))""")
def three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    """Leads beside their application's scores, contacts and dates, each aggregated to one row before it is joined."""
    app = lambda t: load(spark, sf, t).withColumn("app", T.record_key(F.col("application_number"))).where("app is not null").groupBy("app")
    f, e = app("opportunity").agg(F.max("priority_score").alias("score")), app("contact_candidate").agg(F.count_distinct("candidate_id").alias("contacts"))
    d = app("identity_evidence").agg(F.min("observed_at").cast("date").cast("string").alias("first_day"))
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"))
    return R.with_defaults(o, "app", {"score": F.lit(0), "contacts": F.lit(0), "first_day": F.lit("")}, f, e, d).drop("app")


@query("""WITH x AS (SELECT *, upper(trim(application_number)) AS app FROM identity_evidence WHERE trim(application_number) <> ''), d AS (SELECT DISTINCT evidence_id, app, observed_at FROM x),
s AS (SELECT * FROM d WHERE observed_at < TIMESTAMP '2024-01-01'), n AS (SELECT * FROM d WHERE observed_at >= TIMESTAMP '2024-01-01'),
v AS (SELECT app, count(*) AS m FROM s GROUP BY 1)
SELECT n.evidence_id, n.app, coalesce(m, 0) + row_number() OVER (PARTITION BY n.app ORDER BY n.observed_at, n.evidence_id) AS version FROM n LEFT JOIN v USING (app)""")
def versioned_append(spark: SparkSession, sf: str) -> DataFrame:
    """New artifacts numbered on from the greatest stored version of their application."""
    d = load(spark, sf, "identity_evidence").select("evidence_id", T.record_key(F.col("application_number")).alias("app"), "observed_at").where("app is not null").dropDuplicates(["evidence_id"])
    since = F.lit("2024-01-01").cast("timestamp_ntz")
    old = R.numbered_versions(None, d.where(F.col("observed_at") < since), "app", F.col("observed_at"), F.col("evidence_id"))
    return R.numbered_versions(old, d.where(F.col("observed_at") >= since), "app", F.col("observed_at"), F.col("evidence_id")).select("evidence_id", "app", "version")


@query("""WITH d AS (SELECT DISTINCT evidence_id, upper(trim(application_number)) AS app, observed_at FROM identity_evidence WHERE trim(application_number) <> '')
SELECT app, count(*) AS version, first(evidence_id ORDER BY observed_at DESC, evidence_id DESC) AS evidence_id FROM d WHERE observed_at IS NOT NULL GROUP BY 1""")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of every application's artifact."""
    d = load(spark, sf, "identity_evidence").select("evidence_id", T.record_key(F.col("application_number")).alias("app"), "observed_at").where("app is not null and observed_at is not null").dropDuplicates(["evidence_id"])
    return d.groupBy("app").agg(F.count("*").alias("version"), F.max_by("evidence_id", F.struct("observed_at", "evidence_id")).alias("evidence_id"))


@query("""WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'REPLIED' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'CONTACTED' WHEN 'purchase' THEN 'WON' ELSE 'LOST' END AS st,
  CASE event_type WHEN 'signup' THEN 4 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 7 END AS rk FROM events)
SELECT user_id, coalesce(first(st ORDER BY ts DESC, event_id DESC) FILTER (WHERE rk = 7), first(st ORDER BY rk DESC)) AS state, count(*) AS events FROM r GROUP BY 1""")
def lifecycle_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's state after all events in order: a state is never taken back but by the closing ones."""
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", F.try_element_at(F.create_map(*[F.lit(x) for x in EVENTS_TO_STATES]), F.col("event_type")).alias("event"))
    return fold_states(e, "user_id", ["ts", "event_id"], "event").select("user_id", "state", "events")


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2),
r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'REPLIED' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'CONTACTED' WHEN 'purchase' THEN 'WON' ELSE 'LOST' END AS st,
  CASE event_type WHEN 'signup' THEN 4 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 7 END AS rk FROM f)
SELECT user_id, coalesce(first(st ORDER BY ts DESC, event_id DESC) FILTER (WHERE rk = 7), first(st ORDER BY rk DESC)) AS state FROM r GROUP BY 1""")
def lifecycle_fold_opening(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold over every user's first two events, which leaves the open states visible."""
    e = R.top_per(load(spark, sf, "events"), ["user_id"], 2, F.col("ts"), F.col("event_id"))
    e = e.select("user_id", "ts", "event_id", F.try_element_at(F.create_map(*[F.lit(x) for x in EVENTS_TO_STATES]), F.col("event_type")).alias("event"))
    return fold_states(e, "user_id", ["ts", "event_id"], "event").select("user_id", "state")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, CAST(floor(epoch(min(ts))) AS BIGINT) AS began FROM s GROUP BY 1, 2""")
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Events in sessions of at most half an hour between them (an extension: the streaming windows' batch twin)."""
    e = load(spark, sf, "events").select("user_id", "ts", "event_id")
    s = R.sessions(e, ["user_id"], "ts", ["ts", "event_id"], 1800)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("began"))


@query("""WITH u AS (SELECT lower(trim(s_name)) AS name, s_suppkey AS id, 'supplier' AS origin FROM supplier UNION ALL SELECT lower(trim(c_name)), c_custkey, 'customer' FROM customer UNION ALL SELECT lower(trim(p_name)), p_partkey, 'part' FROM part)
SELECT name, first(origin ORDER BY origin DESC, id DESC) AS origin, count(*) AS rows FROM u GROUP BY 1""")
def union_sources_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Names of several sources in one list, the last source of each kept."""
    src = lambda t, n, k, o: load(spark, sf, t).select(F.lower(F.trim(n)).alias("name"), F.col(k).alias("id"), F.lit(o).alias("origin"))
    u = R.union_sources(src("supplier", "s_name", "s_suppkey", "supplier"), src("customer", "c_name", "c_custkey", "customer"), src("part", "p_name", "p_partkey", "part"))
    return u.groupBy("name").agg(F.max_by("origin", F.struct("origin", "id")).alias("origin"), F.count("*").alias("rows"))


@query("""WITH d AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, field FROM investigation_evidence WHERE trim(entity_identifier) <> '')
SELECT app, count_if(field = 'email') AS email, count_if(field = 'phone') AS phone, count_if(field = 'website') AS website, count_if(field = 'owner') AS owner FROM d GROUP BY 1""")
def evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How much evidence of every kind an application has."""
    return evidence(spark, sf).where("app is not null").groupBy("app").agg(*[F.count_if(F.col("field") == k).alias(k) for k in ("email", "phone", "website", "owner")])


@query("""WITH d AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, source_type, confidence FROM investigation_evidence WHERE trim(entity_identifier) <> '' AND source_type IS NOT NULL),
s AS (SELECT app, source_type, bool_or(confidence = 'HIGH') AS high FROM d GROUP BY 1, 2)
SELECT app, count(*) AS sources, CASE WHEN bool_and(coalesce(high, false)) THEN 'ENRICHED' WHEN bool_or(coalesce(high, false)) THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS status FROM s GROUP BY 1""")
def source_status(spark: SparkSession, sf: str) -> DataFrame:
    """An overall status from a map of the sources' states: all, any or none."""
    s = evidence(spark, sf).where("app is not null and source_type is not null").groupBy("app", "source_type").agg(F.coalesce(F.max(F.col("confidence") == "HIGH"), F.lit(False)).alias("high"))
    m = s.groupBy("app").agg(F.map_from_entries(F.collect_list(F.struct("source_type", "high"))).alias("states"))
    got = F.map_values("states")
    return m.select("app", F.size("states").cast("bigint").alias("sources"), F.when(F.forall(got, lambda x: x), "ENRICHED").when(F.exists(got, lambda x: x), "PARTIAL").otherwise("NOT_FOUND").alias("status"))


@query("""SELECT match_id, len(list_intersect(coalesce(matched_signals, []), ['name', 'company', 'location'])) AS strong, coalesce(list_has_any(matched_signals, conflicting_signals), false) AS contradicts,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(matched_signals, []), coalesce(conflicting_signals, [])))), ',') AS all_signals FROM identity_match""")
def signal_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and overlap of a finding's signals."""
    none = F.array().cast("array<string>")
    m, c = F.coalesce("matched_signals", none), F.coalesce("conflicting_signals", none)
    strong = F.size(F.array_intersect(m, F.array(*[F.lit(x) for x in ("name", "company", "location")]))).cast("bigint")
    return load(spark, sf, "identity_match").select("match_id", strong.alias("strong"), F.arrays_overlap(m, c).alias("contradicts"), F.array_join(F.array_sort(F.array_union(m, c)), ",").alias("all_signals"))


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), e AS (SELECT p_type, length(p_type) AS letters FROM t) SELECT p_partkey, letters FROM part JOIN e USING (p_type)""")
def enriched_once(spark: SparkSession, sf: str) -> DataFrame:
    """Parts beside what is worked out once per distinct type."""
    return R.once_per_distinct(load(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"], lambda d: d.withColumn("letters", F.length("p_type").cast("bigint"))).select("p_partkey", "letters")


@query("""SELECT lead_id, array_to_string(list_filter([CASE WHEN application_number IS NULL OR trim(application_number) = '' THEN 'application_number' END, CASE WHEN applicant_name IS NULL OR trim(applicant_name) = '' THEN 'applicant_name' END,
  CASE WHEN project_address IS NULL OR trim(project_address) = '' THEN 'project_address' END, CASE WHEN NOT coalesce(priority_score BETWEEN 0 AND 100, false) THEN 'priority_score' END,
  CASE WHEN NOT coalesce(updated_at >= created_at, false) THEN 'updated_at' END], lambda x: x IS NOT NULL), ',') AS errors FROM opportunity""")
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The rules every lead breaks, by name."""
    c = F.col
    rules = {n: T.blank_to_null(c(n)).isNotNull() for n in ("application_number", "applicant_name", "project_address")}
    rules |= {"priority_score": c("priority_score").between(0, 100), "updated_at": c("updated_at") >= c("created_at")}
    return R.checked(load(spark, sf, "opportunity"), **rules).select("lead_id", F.array_join("errors", ",").alias("errors"))
