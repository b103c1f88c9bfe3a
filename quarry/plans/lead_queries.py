"""Queries over lead records: predicates, parameters, service lists, merges, carried state, claims, parties and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import leads as L
from quarry.operators import rows as R
from quarry.operators import signals as S
from quarry.operators.lifecycle import RANK
from quarry.plans.adapters import evidence
from quarry.plans.registry import query
from quarry.session import load

NOW, REFERENCE = "2025-01-01 00:00:00", "2024-06-01"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Opportunities as lead records; the states that the tables lack are derived from what they state, the same way in the SQL."""
    o = load(spark, sf, "opportunity")
    contact = F.col("applicant_email").isNotNull() | F.col("applicant_phone").isNotNull()
    stages = F.array(*[F.lit(x) for x in ("NEW", "CONTACTED", "REPLIED", "OPPORTUNITY", "WON")])
    return o.select(
        "lead_id", "application_number", "applicant_name", "applicant_email", "applicant_phone", F.col("applicant_entity").alias("company_name"), "application_type", "project_address", "neighborhood", "description", "parcel_number",
        "acreage", "zoning", "owner_name", F.lit(None).cast("string").alias("owner_entity"), F.lit(None).cast("string").alias("owner_contact_name"), "friction_score", "friction_signals", "next_project_date", "priority", "priority_score", "municipality", "created_at", "updated_at",
        F.when(contact, "CONTACTABLE").when(F.col("priority") == "ARCHIVED", "ARCHIVED").when(F.col("applicant_name").isNull(), "NO_CONTACT").otherwise("NEW").alias("lead_status"),
        contact.alias("is_contactable"), (F.col("next_project_date") > F.lit(REFERENCE).cast("date")).alias("has_future_opportunity"),
        F.when(F.col("friction_score") == 0, "NEEDS_MORE_PROJECT_EVIDENCE").when(~contact, "NEEDS_CONTACT_ENRICHMENT").otherwise("READY_FOR_OUTREACH").alias("commercial_readiness"),
        F.get(stages, (F.col("priority_score") % 5).cast("int")).alias("outreach_status"), F.coalesce(F.get("friction_signals", 0), F.get("status", 0)).alias("approval_status"),
        F.regexp_extract("acreage", "([0-9]+[.]?[0-9]*)", 1).try_cast("double").alias("estimated_value_mid"), F.lit(None).cast("double").alias("public_spend_mid"),
    )


REC = f"""rec AS (SELECT *, CASE WHEN applicant_email IS NOT NULL OR applicant_phone IS NOT NULL THEN 'CONTACTABLE' WHEN priority = 'ARCHIVED' THEN 'ARCHIVED' WHEN applicant_name IS NULL THEN 'NO_CONTACT' ELSE 'NEW' END AS lead_status,
  applicant_email IS NOT NULL OR applicant_phone IS NOT NULL AS contactable, next_project_date > DATE '{REFERENCE}' AS upcoming, friction_score > 0 AS friction,
  CASE WHEN friction_score = 0 THEN 'NEEDS_MORE_PROJECT_EVIDENCE' WHEN applicant_email IS NULL AND applicant_phone IS NULL THEN 'NEEDS_CONTACT_ENRICHMENT' ELSE 'READY_FOR_OUTREACH' END AS readiness,
  (['NEW','CONTACTED','REPLIED','OPPORTUNITY','WON'])[priority_score % 5 + 1] AS stage, coalesce(friction_signals[1], status[1]) AS approval, try_cast(regexp_extract(acreage, '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS worth FROM opportunity)"""
DISCOVER = "(NOT contactable AND lead_status = 'NO_CONTACT')"


@query(f"""WITH {REC} SELECT lead_id, contactable, {DISCOVER} AS needs_discovery, coalesce(upcoming, false) AS upcoming, friction, readiness = 'READY_FOR_OUTREACH' AS ready, readiness = 'NEEDS_CONTACT_ENRICHMENT' AS needs_enrichment,
  readiness = 'NEEDS_MORE_PROJECT_EVIDENCE' AS needs_evidence, stage IN ('CONTACTED', 'REPLIED', 'ENGAGED') AS contacted, stage = 'OPPORTUNITY' AS opportunity_stage, coalesce(approval IN ('scheduled', 'pending', 'under_review'), false) AS pending,
  coalesce(approval IN ('denied', 'withdrawn', 'recommended_denial', 'tabled', 'continued'), false) AS stalled, owner_name IS NOT NULL AS owner_known FROM rec""")
def lead_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve named predicates of every lead."""
    return records(spark, sf).select("lead_id", *[p().alias(n) for n, p in L.PREDICATES.items()])


@query(f"""WITH {REC} SELECT lead_id FROM rec WHERE priority = 'HIGH' AND lead_status = 'CONTACTABLE' AND contactable AND coalesce(upcoming, false) AND friction AND readiness = 'READY_FOR_OUTREACH'
  AND coalesce(approval IN ('denied', 'withdrawn', 'recommended_denial', 'tabled', 'continued'), false) AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 900 DAY""")
def filters_all(spark: SparkSession, sf: str) -> DataFrame:
    """Leads that meet many optional filters at once."""
    f = L.Filters(priority="HIGH", lead_status="CONTACTABLE", contactability="contactable", upcoming=True, friction=True, readiness="READY_FOR_OUTREACH", approval="denied_delayed")
    return L.filtered(records(spark, sf), f).where(L.is_recent(F.lit(NOW).cast("timestamp_ntz"), 900)).select("lead_id")


@query(f"""WITH {REC} SELECT lead_id, 'type' AS list FROM rec WHERE application_type = 'Variance' UNION ALL SELECT lead_id, 'discovery' FROM rec WHERE {DISCOVER} UNION ALL SELECT lead_id, 'idle' FROM rec WHERE NOT coalesce(upcoming, false) AND NOT friction
UNION ALL SELECT lead_id, 'contacted' FROM rec WHERE stage IN ('CONTACTED', 'REPLIED', 'ENGAGED') UNION ALL SELECT lead_id, 'stage' FROM rec WHERE stage = 'OPPORTUNITY' UNION ALL SELECT lead_id, 'recent' FROM rec WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
UNION ALL SELECT lead_id, 'none' FROM rec""")
def filters_each(spark: SparkSession, sf: str) -> DataFrame:
    """The lists that single filters give; no filter at all gives every lead."""
    r = records(spark, sf)
    lists = {
        "type": L.Filters(application_type="Variance"), "discovery": L.Filters(contactability="needs_discovery"), "idle": L.Filters(upcoming=False, friction=False), "contacted": L.Filters(outreach_stage="contacted"),
        "stage": L.Filters(outreach_stage="opportunity"), "recent": L.Filters(recent=True), "none": L.Filters(),
    }
    return R.union_sources(*[L.filtered(r, f, F.lit(NOW).cast("timestamp_ntz")).select("lead_id", F.lit(n).alias("list")) for n, f in lists.items()])


ORDER = "CASE priority WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'ARCHIVED' THEN 1 ELSE 0 END DESC, priority_score DESC"


def api_order() -> list:
    c = F.col
    return S.queue_order_by_date(c("priority"), c("priority_score"), c("next_project_date"), c("lead_id"))


@query(f"WITH {REC} SELECT lead_id, priority, priority_score FROM rec WHERE upper(priority) = 'MEDIUM' AND readiness = 'READY_FOR_OUTREACH' ORDER BY {ORDER}, next_project_date NULLS LAST, lead_id LIMIT 25")
def served_leads(spark: SparkSession, sf: str) -> DataFrame:
    """A service's list: equal filters without case, the order, then the limit."""
    return L.served(records(spark, sf), api_order(), 25, priority="medium", commercial_readiness="ready_for_outreach", outreach_status=None).select("lead_id", "priority", "priority_score")


@query("SELECT lead_id FROM opportunity WHERE false")
def served_negative_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A negative limit shows nothing."""
    return L.served(records(spark, sf), api_order(), -3).select("lead_id")


@query(f"""WITH {REC}, o AS (SELECT * FROM rec ORDER BY priority_score DESC, lead_id LIMIT 8), a AS (SELECT * FROM rec WHERE priority = 'HIGH' OR priority_score >= 60 ORDER BY priority_score DESC, lead_id LIMIT 8),
u AS (SELECT * FROM rec WHERE coalesce(upcoming, false) ORDER BY next_project_date, lead_id LIMIT 8) SELECT lead_id, 'top' AS panel FROM o UNION ALL SELECT lead_id, 'attention' FROM a UNION ALL SELECT lead_id, 'upcoming' FROM u""")
def dashboard_panels(spark: SparkSession, sf: str) -> DataFrame:
    """The three panels of eight: best scores, what needs attention, what is next."""
    r, c = records(spark, sf), F.col
    best = [c("priority_score").desc(), c("lead_id")]
    panels = {"top": L.served(r, best, 8), "attention": L.served(r.where((c("priority") == "HIGH") | (c("priority_score") >= 60)), best, 8), "upcoming": L.served(r.where(L.is_upcoming()), [c("next_project_date"), c("lead_id")], 8)}
    return R.union_sources(*[df.select("lead_id", F.lit(n).alias("panel")) for n, df in panels.items()])


@query(f"""WITH {REC}, p AS (SELECT lead_id, 'discovery' AS page, row_number() OVER (ORDER BY priority_score DESC, lead_id) AS n FROM rec WHERE {DISCOVER} UNION ALL SELECT lead_id, 'enrichment', row_number() OVER (ORDER BY priority_score DESC, lead_id) FROM rec WHERE readiness = 'NEEDS_CONTACT_ENRICHMENT'
UNION ALL SELECT lead_id, 'ready', row_number() OVER (ORDER BY priority_score DESC, lead_id) FROM rec WHERE readiness = 'READY_FOR_OUTREACH' UNION ALL SELECT lead_id, 'upcoming', row_number() OVER (ORDER BY next_project_date, lead_id) FROM rec WHERE coalesce(upcoming, false))
SELECT lead_id, page FROM p WHERE n <= 50""")
def page_queues(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty of each page's queue."""
    r, c = records(spark, sf), F.col
    best = [c("priority_score").desc(), c("lead_id")]
    named = {"discovery": (L.needs_discovery(), best), "enrichment": (L.PREDICATES["needs_enrichment"](), best), "ready": (L.PREDICATES["ready"](), best), "upcoming": (L.is_upcoming(), [c("next_project_date"), c("lead_id")])}
    return R.union_sources(*[L.served(r.where(p), o, 50).select("lead_id", F.lit(n).alias("page")) for n, (p, o) in named.items()])


@query("""WITH k AS (SELECT min(upper(trim(application_number))) AS app FROM opportunity WHERE trim(application_number) <> '') SELECT upper(trim(application_number)) AS app, count(*) AS rows FROM (SELECT application_number FROM opportunity, k WHERE upper(trim(application_number)) = app LIMIT 1) GROUP BY 1""")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One lead by its number, written in another case and with blanks; the agency's table is asked where the first has none."""
    o = load(spark, sf, "opportunity").select("application_number", "lead_id")
    wanted = o.select(T.record_key(F.col("application_number")).alias("app")).agg(F.min("app").alias("app")).first()["app"]
    hit = L.lookup(o, f" {wanted.lower()} ", "application_number", load(spark, sf, "pud871_opportunity").select("application_number", F.col("pud_id").alias("lead_id")))
    return hit.groupBy(T.record_key(F.col("application_number")).alias("app")).agg(F.count("*").alias("rows"))


@query("SELECT lead_id, md5(description) AS record FROM opportunity WHERE description IS NOT NULL")
def stored_records(spark: SparkSession, sf: str) -> DataFrame:
    """The whole records of a lead table, read as one column; null records are left out."""
    o = load(spark, sf, "opportunity").select("lead_id", F.when(F.col("description").isNotNull(), F.to_json(F.struct("lead_id", F.md5("description").alias("record")))).alias("record"))
    back = L.stored_records(o).select(F.from_json("record", "lead_id long, record string").alias("r"))
    return back.select("r.lead_id", "r.record")


@query(f"""WITH {REC} SELECT count(*) AS total, count_if(priority = 'HIGH') AS high_priority, count_if(readiness = 'READY_FOR_OUTREACH') AS ready, count_if(readiness = 'NEEDS_CONTACT_ENRICHMENT') AS needs_enrichment, count_if(owner_name IS NOT NULL) AS owners_known,
  count_if(contactable) AS contactable, count_if({DISCOVER}) AS needs_discovery, count_if(upcoming) AS upcoming, round(sum(coalesce(worth, 0)), 3) AS estimated_value, CAST(0 AS DOUBLE) AS public_spend FROM rec""")
def lead_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A dashboard's counts and sums in one row."""
    return L.stats(records(spark, sf)).withColumn("estimated_value", F.round("estimated_value", 3))


@query(f"WITH {REC} SELECT (SELECT count(*) FROM rec) AS applications, (SELECT count(*) FROM rec WHERE upcoming) AS future, (SELECT count(*) FROM pud871_opportunity) AS second_list, (SELECT count(*) FROM rec WHERE friction_score >= 40) AS high_friction")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A run's counts over several tables, in one job."""
    r = records(spark, sf)
    return L.counts_of(spark, applications=(r, None), future=(r, L.is_upcoming()), second_list=(load(spark, sf, "pud871_opportunity"), None), high_friction=(r, F.col("friction_score") >= 40))


@query(f"""SELECT lead_id, coalesce(lower(trim(regexp_replace(application_type, '\\s+', ' ', 'g'))) IN {K.ACTIONABLE_TYPES} OR regexp_matches(lower(trim(regexp_replace(application_type, '\\s+', ' ', 'g'))), '{"|".join(K.ACTIONABLE_WORDS)}'), false) AS actionable FROM opportunity""")
def actionable_types(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a lead's type of application is one to act on: a fixed set or a fixed word in it."""
    return load(spark, sf, "opportunity").select("lead_id", L.is_actionable(F.col("application_type")).alias("actionable"))


@query("SELECT lead_id, friction_score FROM opportunity WHERE friction_score >= 40 AND priority = 'HIGH' ORDER BY friction_score DESC, lead_id")
def high_friction(spark: SparkSession, sf: str) -> DataFrame:
    """Leads of high friction and high priority, the highest first."""
    c = F.col
    return load(spark, sf, "opportunity").where((c("friction_score") >= 40) & (c("priority") == "HIGH")).orderBy(c("friction_score").desc(), "lead_id").select("lead_id", "friction_score")


@query("""SELECT pud_id, try_cast(trim(regexp_extract(project_address, '^\\s*([0-9]+)', 1)) AS BIGINT) AS number, CASE WHEN lead_status IS NOT NULL THEN lower(trim(lead_status)) IN ('true', '1', 'yes', 'y', 'on') END AS flag,
  CASE WHEN trim(municipality) <> '' THEN 1 ELSE 0 END AS places FROM pud871_opportunity""")
def tolerant_values(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, flags and lists read from whatever text stands there."""
    p = load(spark, sf, "pud871_opportunity")
    return p.select("pud_id", L.to_int(F.nullif(F.regexp_extract("project_address", r"^\s*([0-9]+)", 1), F.lit(""))).alias("number"), L.to_bool(F.col("lead_status")).alias("flag"), F.size(L.to_list(F.col("municipality"))).alias("places"))


LATEST = "u AS (SELECT upper(trim(application_number)) AS app, arg_max({'p': priority, 's': priority_score, 'd': next_project_date}, struct_pack(t := coalesce(updated_at, TIMESTAMP '0001-01-01'), i := lead_id)) AS r FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1)"


@query(f"""WITH {LATEST}, f AS (SELECT upper(trim(application_number)) AS app, min(lead_id) AS lead_id FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1), b AS (SELECT app, o.lead_id, o.priority, o.priority_score FROM f JOIN opportunity o USING (lead_id))
SELECT app, b.lead_id, CASE WHEN u.r.s >= 40 THEN u.r.p ELSE b.priority END AS priority, CAST(CASE WHEN u.r.s >= 40 THEN u.r.d END AS VARCHAR) AS day FROM b JOIN u USING (app)""")
def later_wins(spark: SparkSession, sf: str) -> DataFrame:
    """First extractions overlaid with later ones, nulls included; later ones of little score do not count. Columns that only the later have are null for the rest."""
    o = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", "priority", "priority_score", "next_project_date", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t")).where("app is not null")
    first = R.first_wins(o, F.col("app"), F.col("lead_id")).select("app", "lead_id", "priority")
    last = R.last_wins(o, F.col("app"), F.col("t"), F.col("lead_id")).where("priority_score >= 40").select("app", "priority", F.col("next_project_date").cast("string").alias("day"))
    return L.later_wins(first, last, "app")


@query("""WITH e AS (SELECT upper(trim(application_number)) AS app, arg_max(value, struct_pack(c := coalesce(confidence, -1), i := -candidate_id)) FILTER (WHERE contact_type = 'email') AS email FROM contact_candidate WHERE trim(application_number) <> '' GROUP BY 1)
SELECT lead_id, coalesce(applicant_email, email) AS applicant_email, applicant_phone FROM opportunity o LEFT JOIN e ON e.app = upper(trim(o.application_number))""")
def filled_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Leads whose missing e-mail the surest candidate fills; what is stated stays."""
    c = load(spark, sf, "contact_candidate").select(T.record_key(F.col("application_number")).alias("app"), "contact_type", "value", "confidence", "candidate_id").where("app is not null and contact_type = 'email'")
    best = c.groupBy("app").agg(F.max_by("value", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("candidate_id"))).alias("applicant_email"))
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"), "applicant_email", "applicant_phone")
    return L.fill_nulls(o, best, "app", ["applicant_email"]).drop("app")


@query("""WITH e AS (SELECT upper(trim(application_number)) AS app, arg_max({'v': value, 'c': confidence, 't': source_type}, struct_pack(c := coalesce(confidence, -1), i := -candidate_id)) AS r FROM contact_candidate WHERE trim(application_number) <> '' AND contact_type = 'email' GROUP BY 1)
SELECT lead_id, coalesce(nullif(trim(applicant_email), ''), r.v) AS email, CASE WHEN trim(applicant_email) <> '' THEN 1.0 WHEN r.v IS NOT NULL THEN r.c END AS email_confidence,
  CASE WHEN trim(applicant_email) <> '' THEN 'government_record' WHEN r.v IS NOT NULL THEN r.t END AS email_source FROM opportunity o LEFT JOIN e ON e.app = upper(trim(o.application_number))""")
def record_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """What is on record beats what was discovered, with source and confidence."""
    c = load(spark, sf, "contact_candidate").select(T.record_key(F.col("application_number")).alias("app"), "contact_type", "value", "confidence", "source_type", "candidate_id").where("app is not null and contact_type = 'email'")
    best = c.groupBy("app").agg(F.max_by(F.struct("value", "confidence", "source_type"), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("candidate_id"))).alias("r"))
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"), "applicant_email").join(best, "app", "left")
    return o.select("lead_id", *[v.alias(n) for n, v in L.precedence("email", F.col("applicant_email"), F.col("r.value"), F.col("r.confidence"), F.col("r.source_type")).items()])


@query("""WITH c AS (SELECT *, coalesce(applicant_phone, '') <> '' AS p, email_confidence AS ec FROM applicant_enrichment)
SELECT enrichment_id, CASE WHEN applicant_email IS NOT NULL AND ec >= 0.85 THEN 'contact_found' WHEN applicant_email IS NOT NULL OR applicant_phone IS NOT NULL OR company_website IS NOT NULL THEN 'partial' ELSE 'not_found' END AS state,
  CASE WHEN applicant_name IS NULL OR trim(applicant_name) = '' THEN 'not_found' WHEN search_query IS NULL THEN 'disabled' WHEN applicant_email IS NOT NULL OR applicant_phone IS NOT NULL OR company_website IS NOT NULL THEN 'enriched' ELSE 'not_found' END AS status FROM c""")
def enrichment_states(spark: SparkSession, sf: str) -> DataFrame:
    """What enrichment found for every row, and what the run calls it; rows without a query were not searched live."""
    c = F.col
    e = load(spark, sf, "applicant_enrichment")
    return e.select("enrichment_id", L.contact_state(c("applicant_email"), c("email_confidence"), c("applicant_phone"), c("company_website")).alias("state"), L.enrichment_status(c("applicant_name"), c("search_query").isNotNull(), F.lit(False), c("applicant_email"), c("applicant_phone"), c("company_website")).alias("status"))


@query(f"""WITH {REC}, f AS (SELECT upper(trim(application_number)) AS app, arg_min(stage, lead_id) AS file FROM rec WHERE trim(application_number) <> '' GROUP BY 1), s AS (SELECT upper(trim(application_number)) AS app, arg_max(CASE WHEN friction_score > 0 THEN stage END, lead_id) AS store FROM rec WHERE trim(application_number) <> '' AND friction GROUP BY 1)
SELECT lead_id, CASE coalesce(store, file, '') WHEN 'CONTACTED' THEN 'CONTACTED' WHEN 'REPLIED' THEN 'REPLIED' WHEN 'OPPORTUNITY' THEN 'OPPORTUNITY' WHEN 'WON' THEN 'WON' ELSE CASE readiness WHEN 'READY_FOR_OUTREACH' THEN 'READY' WHEN 'NEEDS_CONTACT_ENRICHMENT' THEN 'QUALIFIED' ELSE 'NEW' END END AS state
FROM rec LEFT JOIN f ON f.app = upper(trim(application_number)) LEFT JOIN s ON s.app = upper(trim(application_number))""")
def carried_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state after a rerun: open ones follow readiness, from contact on the earlier one is kept; the store lies over the file."""
    r = records(spark, sf).withColumn("app", T.record_key(F.col("application_number")))
    known = r.where("app is not null")
    file = known.groupBy("app").agg(F.min_by("outreach_status", "lead_id").alias("state"))
    store = known.where(L.has_friction()).groupBy("app").agg(F.max_by("outreach_status", "lead_id").alias("state"))
    before = L.previous_state("app", file, store, ["state"])
    natural = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.NATURAL.items() for x in kv]), F.col("commercial_readiness"))
    return r.join(before, "app", "left").select("lead_id", L.carried_status(F.col("state"), natural, ("NEW", "QUALIFIED", "READY"), tuple(RANK)).alias("state"))


@query("""SELECT lead_id, coalesce(nullif(owner_name, NULL), applicant_name, applicant_entity, 'Unknown') AS party, CASE WHEN owner_name IS NOT NULL THEN 'Owner' WHEN applicant_name IS NOT NULL THEN 'Applicant' WHEN applicant_entity IS NOT NULL THEN 'Company' ELSE 'Unknown' END AS role FROM opportunity""")
def primary_parties(spark: SparkSession, sf: str) -> DataFrame:
    """Whom every lead is about, and in which role."""
    return records(spark, sf).select("lead_id", L.primary_party().alias("party"), L.primary_role().alias("role"))


PARTIES = """pt AS (SELECT company_name AS k, list({'party_name': applicant_name, 'party_role': contact_role} ORDER BY enrichment_id) AS ps FROM applicant_enrichment WHERE company_name IS NOT NULL GROUP BY 1)"""


def parties(spark: SparkSession, sf: str) -> DataFrame:
    """(k, parties): the persons with roles that enrichment names for each company, in order of their rows."""
    e = load(spark, sf, "applicant_enrichment").where("company_name is not null")
    rows = e.groupBy(F.col("company_name").alias("k")).agg(F.array_sort(F.collect_list(F.struct("enrichment_id", "applicant_name", "contact_role"))).alias("ps"))
    return rows.select("k", F.transform("ps", lambda p: F.struct(p["applicant_name"].alias("party_name"), p["contact_role"].alias("party_role"))).alias("parties"))


@query(f"""WITH {PARTIES} SELECT k, list_filter(ps, lambda p: contains(lower(coalesce(p.party_role, '')), 'engineer'))[1].party_name AS engineer, list_filter(ps, lambda p: contains(lower(coalesce(p.party_role, '')), 'architect'))[1].party_name AS architect,
  len(ps) - CAST(len(list_filter(ps, lambda p: contains(lower(coalesce(p.party_role, '')), 'engineer'))) > 0 AS INT) - CAST(len(list_filter(ps, lambda p: contains(lower(coalesce(p.party_role, '')), 'architect'))) > 0 AS INT) AS others FROM pt""")
def parties_by_role(spark: SparkSession, sf: str) -> DataFrame:
    """The engineer, the architect and how many others each company's parties are."""
    p = parties(spark, sf)
    name = lambda r: L.party_of(F.col("parties"), r)["party_name"]
    n = lambda r: F.when(L.party_of(F.col("parties"), r).isNotNull(), 1).otherwise(0)
    return p.select("k", name("engineer").alias("engineer"), name("architect").alias("architect"), (F.size("parties") - n("engineer") - n("architect")).cast("bigint").alias("others"))


@query(f"""WITH {PARTIES}, o AS (SELECT pud_id, owner_entity AS k, CASE WHEN owner_name IS NOT NULL THEN [{{'party_name': owner_name, 'party_role': 'Owner'}}] ELSE [] END AS own FROM pud871_opportunity),
e AS (SELECT pud_id, own, coalesce(ps, []) AS ps FROM o LEFT JOIN pt USING (k)), x AS (SELECT pud_id, len(own) AS a, len(list_distinct(list_transform(list_filter(ps, lambda p: NOT list_contains(own, p)), lambda p: struct_pack(n := coalesce(p.party_name, '-'), r := coalesce(p.party_role, '-'))))) AS b FROM e)
SELECT pud_id, a + b AS parties FROM x""")
def joined_parties(spark: SparkSession, sf: str) -> DataFrame:
    """The parties of the second list's rows, with those that enrichment found for the same writing of the owner; the same name and role counts once."""
    kind = "array<struct<party_name:string,party_role:string>>"
    own = F.when(F.col("owner_name").isNotNull(), F.array(F.struct(F.col("owner_name").alias("party_name"), F.lit("Owner").alias("party_role")))).otherwise(F.array().cast(kind))
    o = load(spark, sf, "pud871_opportunity").select("pud_id", F.col("owner_entity").alias("k"), own.cast(kind).alias("own"))
    both = o.join(parties(spark, sf), "k", "left")
    return both.select("pud_id", F.size(L.joined_parties(F.col("own"), F.coalesce("parties", F.array().cast(kind)))).cast("bigint").alias("parties"))


@query("""WITH t AS (SELECT DISTINCT evidence_id, coalesce(evidence_text, '') AS x, upper(trim(entity_identifier)) AS app, confidence_score FROM investigation_evidence), l AS (SELECT upper(trim(application_number)) AS app, arg_min({'n': applicant_name, 'a': project_address}, lead_id) AS r FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1)
SELECT evidence_id, round(CASE WHEN contains(lower(x), 'ultimately denied') THEN 10 ELSE 0 END + CASE WHEN contains(lower(x), 'was recommended denial') THEN 10 ELSE 0 END + CASE WHEN contains(lower(x), 'recommended denial by the planning commission') THEN 8 ELSE 0 END
  + CASE WHEN contains(lower(x), 'municipal council') THEN 4 ELSE 0 END + CASE WHEN contains(lower(x), 'planning commission') THEN 3 ELSE 0 END + CASE WHEN coalesce(contains(lower(x), lower(nullif(r.n, ''))), false) THEN 5 ELSE 0 END
  + len(list_filter(regexp_extract_all(lower(coalesce(r.a, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND contains(lower(x), t))) + least(length(x) / 500, 3.0) + coalesce(confidence_score, 0), 4) AS quality FROM t LEFT JOIN l USING (app)""")
def evidence_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How clear every piece of evidence is: wording, names, place, length and confidence."""
    o = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", "applicant_name", "project_address")
    lead = R.first_wins(o, F.col("app"), F.col("lead_id"), keep_keyless=False)
    e = evidence(spark, sf).select("evidence_id", "app", "evidence_text", "confidence_score").join(lead, "app", "left")
    return e.select("evidence_id", F.round(L.evidence_quality(F.col("evidence_text"), F.col("applicant_name"), F.col("project_address"), F.col("confidence_score"), F.lit(0.0)), 4).alias("quality"))


@query(f"""WITH s AS (SELECT DISTINCT upper(trim(application_number)) AS app, observed_at::DATE AS day, CASE kind WHEN 'hearing' THEN 'public_hearing' WHEN 'role' THEN 'deadline' ELSE kind END AS label FROM identity_evidence WHERE trim(application_number) <> '' AND observed_at IS NOT NULL)
SELECT app, count_if(day > DATE '{REFERENCE}' AND label <> 'deadline') AS ahead, count_if(day <= DATE '{REFERENCE}') AS past, CAST(min(day) FILTER (WHERE day > DATE '{REFERENCE}') AS VARCHAR) AS first_ahead, CAST(coalesce(min(day) FILTER (WHERE day > DATE '{REFERENCE}'), min(day)) AS VARCHAR) AS first_shown FROM s GROUP BY 1""")
def lead_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The future dates of every application that are no deadline, its past ones, and the order in which they are shown: future first, then by day."""
    e = load(spark, sf, "identity_evidence").select(T.record_key(F.col("application_number")).alias("app"), F.to_date("observed_at").alias("day"), F.when(F.col("kind") == "hearing", "public_hearing").when(F.col("kind") == "role", "deadline").otherwise(F.col("kind")).alias("label")).where("app is not null and day is not null").distinct()  # at most the days and labels there are
    d = e.withColumn("is_future", D.is_future(F.col("day"), F.lit(REFERENCE).cast("date"))).groupBy("app").agg(F.array_sort(F.collect_list(F.struct("day", "label", "is_future"))).alias("dates"))
    shown, ahead = L.ordered_dates(F.col("dates")), L.future_dates(F.col("dates"))
    upcoming = F.filter("dates", lambda x: x["is_future"])
    return d.select("app", F.size(ahead).cast("bigint").alias("ahead"), F.size(L.historical_dates(F.col("dates"))).cast("bigint").alias("past"), F.get(upcoming, 0)["day"].cast("string").alias("first_ahead"), F.get(shown, 0)["day"].cast("string").alias("first_shown"))


@query("""WITH s AS (SELECT upper(trim(application_number)) AS app, observed_at::DATE AS day, kind AS label FROM (SELECT DISTINCT evidence_id, application_number, observed_at, kind FROM identity_evidence) WHERE trim(application_number) <> '' AND observed_at IS NOT NULL)
SELECT lead_id, min(label) AS label FROM opportunity o JOIN (SELECT app, day, min(label) AS label FROM s GROUP BY 1, 2) m ON m.app = upper(trim(o.application_number)) AND m.day = (SELECT min(day) FROM s WHERE s.app = m.app) GROUP BY 1""")
def matching_date(spark: SparkSession, sf: str) -> DataFrame:
    """For every lead the date element of its application's first day."""
    e = load(spark, sf, "identity_evidence").select(T.record_key(F.col("application_number")).alias("app"), F.to_date("observed_at").alias("day"), F.col("kind").alias("label")).where("app is not null and day is not null").distinct()
    d = e.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("day", "label"))).alias("dates"), F.min("day").alias("first"))
    picked = d.select("app", L.date_of(F.col("dates"), F.col("first"))["label"].alias("label"))
    return load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app")).join(picked, "app").select("lead_id", "label")


@query("""SELECT lead_id, array_to_string(list_transform(list_sort(list_transform(friction_signals, lambda s, i: {'r': CASE s WHEN 'denied' THEN 0 WHEN 'appeal' THEN 1 WHEN 'staff_concern' THEN 2 ELSE 3 END, 'i': i, 's': s})), lambda x: x.s), ',') AS ordered FROM opportunity""")
def signals_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Each lead's signals by severity; equal ones keep their order."""
    rank = S.literal_map({"denied": 0, "appeal": 1, "staff_concern": 2})
    return load(spark, sf, "opportunity").select("lead_id", F.array_join(L.by_rank(F.col("friction_signals"), lambda s: F.coalesce(F.try_element_at(rank, s), F.lit(3))), ",").alias("ordered"))


@query("""WITH c AS (SELECT lead_id, unnest([CASE WHEN trim(applicant_name) <> '' THEN {'c': 'Applicant: ' || trim(applicant_name), 'k': 1.0} END, CASE WHEN trim(application_number) <> '' THEN {'c': 'Application number: ' || trim(application_number), 'k': 1.0} END,
  CASE WHEN trim(application_type) <> '' THEN {'c': 'Application type: ' || trim(application_type), 'k': 1.0} END, CASE WHEN trim(project_address) <> '' THEN {'c': 'Project address: ' || trim(project_address), 'k': 1.0} END,
  CASE WHEN trim(description) <> '' THEN {'c': 'Project description: ' || trim(description), 'k': 0.9} END, CASE WHEN trim(applicant_entity) <> '' THEN {'c': 'Company: ' || trim(applicant_entity), 'k': 0.8} END, CASE WHEN trim(owner_name) <> '' THEN {'c': 'Property owner: ' || trim(owner_name), 'k': 0.9} END,
  CASE WHEN coalesce(friction_signals[1], status[1]) <> '' THEN {'c': 'Approval status: ' || coalesce(friction_signals[1], status[1]), 'k': 0.9} END, CASE WHEN trim(parcel_number) <> '' THEN {'c': 'Parcel number: ' || trim(parcel_number), 'k': 1.0} END,
  CASE WHEN trim(acreage) <> '' THEN {'c': 'Acreage: ' || trim(acreage), 'k': 0.9} END, CASE WHEN trim(zoning) <> '' THEN {'c': 'Zoning: ' || trim(zoning), 'k': 1.0} END, CASE WHEN trim(neighborhood) <> '' THEN {'c': 'Neighborhood: ' || trim(neighborhood), 'k': 1.0} END,
  CASE WHEN trim(applicant_email) <> '' THEN {'c': 'Applicant email: ' || trim(applicant_email) || ' (source: unknown)', 'k': 0.9} END, CASE WHEN trim(applicant_phone) <> '' THEN {'c': 'Applicant phone: ' || trim(applicant_phone) || ' (source: unknown)', 'k': 0.9} END,
  CASE WHEN friction_score > 0 THEN {'c': 'Friction score: ' || friction_score, 'k': 0.9} END, CASE WHEN next_project_date IS NOT NULL THEN {'c': 'Scheduled event on ' || CAST(next_project_date AS DATE), 'k': 0.95} END]) AS x FROM opportunity
  UNION ALL SELECT lead_id, {'c': 'Friction signal: ' || unnest(friction_signals), 'k': 0.9} FROM opportunity)
SELECT lead_id, count(*) AS claims, CAST(round(sum(x.k), 4) AS DOUBLE) AS weight, md5(string_agg(x.c, chr(10) ORDER BY x.c)) AS said FROM c WHERE x IS NOT NULL GROUP BY 1""")
def lead_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Everything a lead states as claims, counted, weighed and digested."""
    c = L.claims(records(spark, sf), "lead_id")
    return c.groupBy("lead_id").agg(F.count("*").alias("claims"), F.round(F.sum("confidence"), 4).alias("weight"), F.md5(F.array_join(F.array_sort(F.collect_list("claim")), "\n")).alias("said"))


@query("SELECT lead_id, CASE WHEN trim(zoning) <> '' THEN 'Zoning: ' || trim(zoning) END AS zoning FROM opportunity")
def claim_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The registered claim of a source that begins with given words; null where none does."""
    c = L.claims(records(spark, sf), "lead_id")
    reg = c.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "claim", "source"))), lambda x: F.struct(x["claim"].alias("id"), x["claim"].alias("claim"), x["source"].alias("source"))).alias("r"))
    got = reg.select("lead_id", L.claim_id(F.col("r"), "Zoning: ", "application_extraction").alias("zoning"))
    return records(spark, sf).select("lead_id").join(got, "lead_id", "left")


@query(f"""WITH h AS (SELECT doc_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[.]', '') AS h FROM documents WHERE url IS NOT NULL UNION ALL SELECT doc_id, unnest(['maps.google.com', 'city.gov', 'x.com', 'yelp.com']) FROM documents WHERE url IS NULL)
SELECT h AS host, count(*) AS n, {" OR ".join(f"h = '{d}' OR h LIKE '%.{d}'" for d in K.SOCIAL_HOSTS)} AS social, {" OR ".join(f"h = '{d}' OR h LIKE '%.{d}'" for d in K.MAP_HOSTS)} AS map, h IN {K.DIRECTORY_HOSTS} AS directory, h LIKE '%.gov' OR h LIKE '%.gov.%' AS government FROM h GROUP BY 1""")
def link_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of source each host is; documents without a url stand for one host of each kind."""
    d = load(spark, sf, "documents").select("doc_id", "url")
    kinds = F.explode(F.array(*[F.lit(x) for x in ("maps.google.com", "city.gov", "x.com", "yelp.com")]))
    hosts = d.where("url is not null").select(T.host(F.col("url")).alias("host")).union(d.where("url is null").select(kinds))
    h = F.col("host")
    return hosts.groupBy("host").agg(F.count("*").alias("n")).select("host", "n", C.is_social(h).alias("social"), C.is_map(h).alias("map"), C.is_directory(h).alias("directory"), C.is_government_host(h).alias("government"))


@query("""SELECT lead_id, regexp_replace(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:www[.])?', '') AS bare, coalesce(CASE WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END, '') AS label FROM
  (SELECT lead_id, source_url, list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1), ':.*$', ''), '^www[.]', ''), '.'), lambda x: x <> '') AS p FROM opportunity WHERE source_url IS NOT NULL)""")
def source_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The body behind each lead's source, whatever its top-level domain."""
    u = F.col("source_url")
    bare = F.regexp_replace(F.lower(F.trim(u)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?", "")
    return load(spark, sf, "opportunity").where("source_url is not null").select("lead_id", bare.alias("bare"), F.coalesce(C.root_label(u), F.lit("")).alias("label"))


@query(f"""WITH {REC} SELECT lead_id, concat_ws(chr(10) || chr(10), 'PROJECT' || chr(10) || nullif(concat_ws(chr(10), 'application_type: ' || nullif(trim(application_type), ''), 'zoning: ' || nullif(trim(zoning), '')), ''), 'OWNER' || chr(10) || nullif('owner_name: ' || nullif(trim(owner_name), ''), '')) AS profile FROM rec""")
def profile_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Records as grouped lines for a text maker; blank fields and empty groups are left out."""
    r = records(spark, sf).select("lead_id", F.nullif(F.trim("application_type"), F.lit("")).alias("application_type"), F.nullif(F.trim("zoning"), F.lit("")).alias("zoning"), F.nullif(F.trim("owner_name"), F.lit("")).alias("owner_name"))
    return r.select("lead_id", L.profile_context(r, {"project": ["application_type", "zoning"], "owner": ["owner_name"]}).alias("profile"))


@query("SELECT lead_id, application_type AS output FROM opportunity")
def passed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts through a provider that nobody registered: they come out as they are."""
    p = load(spark, sf, "opportunity").select("lead_id", F.col("application_type").alias("prompt"))
    return L.TextProviders().generate(p, "none").select("lead_id", "output")


@query("SELECT lead_id, upper(priority) AS priority, friction_score + 1 AS score FROM opportunity WHERE friction_score > 0")
def staged_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Registered stages run in their order."""
    stages = L.Stages().add("filter", lambda d: d.where("friction_score > 0")).add("name", lambda d: d.withColumn("priority", F.upper("priority"))).add("score", lambda d: d.withColumn("score", F.col("friction_score") + 1))
    return stages.run(load(spark, sf, "opportunity")).select("lead_id", "priority", "score")


@query(f"""WITH b AS (SELECT lead_id, coalesce(nullif(trim(opportunity_id), ''), '') AS oid, greatest(least(coalesce(friction_score, 0), 100), 0) AS f, coalesce(friction_signals, []) AS s, next_project_date AS d, coalesce(next_project_date > DATE '{REFERENCE}', false) AS future,
  coalesce(lower(trim(regexp_replace(application_type, '\\s+', ' ', 'g'))) IN {K.ACTIONABLE_TYPES} OR regexp_matches(lower(application_type), '{"|".join(K.ACTIONABLE_WORDS)}'), false) AS act FROM opportunity),
c AS (SELECT *, CASE WHEN future THEN CAST(date_diff('day', DATE '{REFERENCE}', CAST(d AS DATE)) AS BIGINT) END AS days, list_has_any(s, ['denied', 'withdrawn', 'recommended_denial', 'appeal']) AS crit FROM b)
SELECT oid AS opportunity_id, days AS days_until_event, CASE WHEN NOT future THEN 'HISTORICAL' WHEN days <= 7 THEN 'URGENT' WHEN days <= 30 THEN 'SOON' ELSE 'UPCOMING' END AS urgency,
  CAST(least(f + CASE WHEN future THEN 25 ELSE 0 END + CASE WHEN act THEN 15 ELSE 0 END + CASE WHEN future AND days <= 7 THEN 35 WHEN future AND days <= 30 THEN 20 WHEN future AND days <= 90 THEN 10 ELSE 0 END + CASE WHEN crit THEN 20 ELSE 0 END, 250) AS BIGINT) AS priority_score,
  CASE WHEN NOT future THEN 'ARCHIVED' WHEN (f >= 70 AND act) OR (crit AND act) OR (days <= 7 AND (f >= 20 OR act)) THEN 'HIGH' WHEN f >= 20 OR act OR days <= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority, CAST(CASE WHEN future THEN d END AS VARCHAR) AS next_project_date FROM c""")
def canonical_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Opportunities as canonical records at a reference date."""
    c = L.canonical(load(spark, sf, "opportunity"), F.lit(REFERENCE).cast("date"))
    return c.select("opportunity_id", "days_until_event", "urgency", "priority_score", "priority", F.col("next_project_date").cast("string").alias("next_project_date"))


@query(f"""WITH {REC}, l AS (SELECT lead_id, nullif(trim(owner_name), '') AS o, nullif(trim(applicant_entity), '') AS e, nullif(trim(applicant_name), '') AS n, nullif(trim(project_address), '') AS a, nullif(trim(application_number), '') AS k, nullif(trim(municipality), '') AS m FROM opportunity), p AS (SELECT *, coalesce(e, o, n) AS p FROM l)
SELECT lead_id, CASE WHEN p IS NULL THEN '' ELSE concat_ws(' | ', '"' || p || '"', '"' || o || '" "' || e || '"', '"' || p || '" "' || a || '"', '"' || p || '" contact', '"' || p || '" email phone', '"' || e || '" website', '"' || k || '"', '"' || a || '" development', '"' || p || '" "' || m || '"') END AS queries FROM p""")
def owner_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The queries that would look for the party behind every lead; none without a party."""
    c = lambda n: T.blank_to_null(F.col(n))
    q = C.party_queries(c("owner_name"), c("applicant_entity"), c("applicant_name"), c("project_address"), c("application_number"), c("municipality"))
    return load(spark, sf, "opportunity").select("lead_id", F.array_join(q, " | ").alias("queries"))
