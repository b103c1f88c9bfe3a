"""Transforms over lead records: predicates, optional filters, merges, carried state, claims and parties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import text as T


def yes(c: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


# -- coercions ---------------------------------------------------------------------------------------


def to_int(c: Column) -> Column:
    """A whole number from text such as " 12 " or "12.7"; null where there is none."""
    return F.trim(c.cast("string")).try_cast("double").cast("bigint")


def to_bool(c: Column) -> Column:
    """true, 1, yes, y and on are true, other words false, null stays null."""
    return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "on"))


def to_list(c: Column) -> Column:
    """A text as a list of one, blank and null as an empty one."""
    none = F.array().cast("array<string>")
    return F.when(T.blank_to_null(c).isNotNull(), F.array(F.trim(c))).otherwise(none)


# -- named predicates --------------------------------------------------------------------------------


def is_contactable() -> Column:
    return yes(F.col("is_contactable")) | yes(F.col("lead_status") == "CONTACTABLE")


def needs_discovery() -> Column:
    return ~is_contactable() & (F.coalesce("lead_status", F.lit("")).isin("NO_CONTACT", "NOT_RUN", "FAILED", ""))


def is_upcoming() -> Column:
    return yes(F.col("has_future_opportunity")) & F.col("next_project_date").isNotNull()


def has_friction() -> Column:
    return F.coalesce("friction_score", F.lit(0)) > 0


def is_owner_known() -> Column:
    return F.col("owner_name").isNotNull() | F.col("owner_entity").isNotNull()


def readiness_is(level: str) -> Column:
    return yes(F.col("commercial_readiness") == level)


def is_contacted() -> Column:
    return yes(F.col("outreach_status").isin(*K.CONTACTED))


def is_opportunity_stage() -> Column:
    return yes(F.col("outreach_status") == "OPPORTUNITY")


def is_pending() -> Column:
    return yes(F.lower("approval_status").isin(*K.PENDING))


def is_stalled() -> Column:
    return yes(F.lower("approval_status").isin(*K.STALLED))


def is_recent(now: Column, days: int = 30) -> Column:
    """Created at most so many days before now; a lead of the future is recent too, one without a time is not."""
    return yes(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


PREDICATES: dict[str, Callable[[], Column]] = {
    "contactable": is_contactable, "needs_discovery": needs_discovery, "upcoming": is_upcoming, "friction": has_friction, "ready": lambda: readiness_is("READY_FOR_OUTREACH"),
    "needs_enrichment": lambda: readiness_is("NEEDS_CONTACT_ENRICHMENT"), "needs_evidence": lambda: readiness_is("NEEDS_MORE_PROJECT_EVIDENCE"), "contacted": is_contacted, "opportunity_stage": is_opportunity_stage,
    "pending": is_pending, "stalled": is_stalled, "owner_known": is_owner_known,
}


def is_actionable(kind: Column) -> Column:
    """A type of application in a fixed list, or one that holds a fixed word."""
    k = F.lower(T.collapse(kind))
    return yes(k.isin(*K.ACTIONABLE_TYPES) | k.rlike("|".join(K.ACTIONABLE_WORDS)))


# -- filters with optional parameters ----------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """The ten optional filters of a list of leads; None leaves one out."""

    priority: str | None = None
    lead_status: str | None = None
    application_type: str | None = None
    contactability: str | None = None  # contactable, needs_discovery
    upcoming: bool | None = None
    friction: bool | None = None
    readiness: str | None = None
    outreach_stage: str | None = None  # contacted, opportunity
    approval: str | None = None  # pending, denied_delayed
    recent: bool | None = None


def filtered(leads: DataFrame, f: Filters, now: Column | None = None) -> DataFrame:
    """The leads that meet every filter that is set; all conditions are one predicate, which reaches the scan as far as it can."""
    conditions = [yes(F.col(c) == v) for c, v in (("priority", f.priority), ("lead_status", f.lead_status), ("application_type", f.application_type), ("commercial_readiness", f.readiness)) if v]
    named = {"contactable": is_contactable, "needs_discovery": needs_discovery, "contacted": is_contacted, "opportunity": is_opportunity_stage, "pending": is_pending, "denied_delayed": is_stalled}
    for choice in (f.contactability, f.outreach_stage, f.approval):
        if choice:
            conditions.append(named[choice]())
    conditions += [p() if want else ~p() for p, want in ((is_upcoming, f.upcoming), (has_friction, f.friction)) if want is not None]
    if f.recent:
        if now is None:
            raise ValueError("recent needs the present time as a parameter")
        conditions.append(is_recent(now))
    return leads.where(reduce(lambda a, b: a & b, conditions)) if conditions else leads


def served(leads: DataFrame, order: list[Column], limit: int | None = None, **equal: str | None) -> DataFrame:
    """The list that a service shows: equal filters without case, the order, then the limit; a negative limit shows nothing.

    A null never equals a wanted value; a filter that is None or blank is left out. Sort and limit fuse into one top-n.
    """
    for c, v in equal.items():
        if v:
            leads = leads.where(F.upper(F.coalesce(F.col(c), F.lit(""))) == v.upper())
    ordered = leads.orderBy(*order)
    return ordered if limit is None else ordered.limit(max(limit, 0))


def lookup(leads: DataFrame, number: str, key: str = "application_number", *fallbacks: DataFrame) -> DataFrame:
    """The lead of a number, from the first table that has it: at most one row."""
    wanted = number.strip().upper()
    tables = [df.where(T.record_key(F.col(key)) == wanted).limit(1).withColumn("_rank", F.lit(i)) for i, df in enumerate((leads, *fallbacks))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).orderBy("_rank").limit(1).drop("_rank")


def stored_records(leads: DataFrame, limit: int | None = None, record: str = "record") -> DataFrame:
    """The whole records of a lead table, null ones left out; no other column is read."""
    rows = leads.select(record).where(F.col(record).isNotNull())
    return rows if limit is None else rows.limit(max(limit, 0))


def stats(leads: DataFrame) -> DataFrame:
    """One row of a dashboard's counts and sums; a null counts as 0 in a sum."""
    count = {
        "high_priority": F.col("priority") == "HIGH", "ready": PREDICATES["ready"](), "needs_enrichment": PREDICATES["needs_enrichment"](), "owners_known": is_owner_known(), "contactable": is_contactable(),
        "needs_discovery": needs_discovery(), "upcoming": is_upcoming(),
    }
    sums = {"estimated_value": "estimated_value_mid", "public_spend": "public_spend_mid"}
    return leads.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in count.items()], *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(n) for n, c in sums.items()])


# -- merges and carried state ------------------------------------------------------------------------


def later_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right put over it where right has the key, nulls included. right has one row per key."""
    r = right.select(F.col(key), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key], F.lit(True).alias("_hit"))
    both = left.join(r, key, "left")
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    pick = lambda c: F.col(c) if c == key or c not in right.columns else F.col(f"_r_{c}").alias(c) if c not in left.columns else F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[pick(c) for c in names])


def fill_nulls(base: DataFrame, more: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with its null fields filled from more; a stated field is never replaced."""
    m = more.select(key, *[F.col(f).alias(f"_m_{f}") for f in fields])
    return base.join(m, key, "left").withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in fields}).drop(*[f"_m_{f}" for f in fields])


def joined_parties(own: Column, found: Column) -> Column:
    """The parties of a record and then the others', those of a name and role that is already there left out."""
    known = lambda p: F.exists(own, lambda q: q["party_name"].eqNullSafe(p["party_name"]) & q["party_role"].eqNullSafe(p["party_role"]))
    return F.concat(own, F.filter(found, lambda p, i: ~known(p) & ~F.exists(F.slice(found, F.lit(1), i), lambda q: q["party_name"].eqNullSafe(p["party_name"]) & q["party_role"].eqNullSafe(p["party_role"]))))


NATURAL = {"NOT_READY": "NEW", "NEEDS_MORE_PROJECT_EVIDENCE": "NEW", "NEEDS_CONTACT_ENRICHMENT": "QUALIFIED", "READY_FOR_OUTREACH": "READY"}


def carried_status(previous: Column, natural: Column, open_states: tuple[str, ...], known: tuple[str, ...]) -> Column:
    """The state after a rerun: open and unknown ones are derived anew, a state from contact on is frozen."""
    return F.when(previous.isin(*known) & ~previous.isin(*open_states), previous).otherwise(natural)


def previous_state(key: str, file: DataFrame, store: DataFrame, fields: list[str]) -> DataFrame:
    """The state of earlier runs from two places: the store's stated fields lie over the file's."""
    f, s = file.select(key, *[F.col(x).alias(f"_f_{x}") for x in fields]), store.select(key, *[F.col(x).alias(f"_s_{x}") for x in fields])
    return f.join(s, key, "full").select(key, *[F.coalesce(f"_s_{x}", f"_f_{x}").alias(x) for x in fields])


def precedence(value: str, government: Column, discovered: Column, sure: Column, origin: Column) -> dict[str, Column]:
    """What is on record beats what was discovered: value, its confidence and its source, as columns to add."""
    on_record = T.blank_to_null(government)
    return {
        value: F.coalesce(on_record, discovered), f"{value}_confidence": F.when(on_record.isNotNull(), 1.0).when(discovered.isNotNull(), sure),
        f"{value}_source": F.when(on_record.isNotNull(), "government_record").when(discovered.isNotNull(), origin),
    }


def enrichment_status(name: Column, live: Column, failed: Column, email: Column, phone: Column, site: Column) -> Column:
    """What enrichment made of a lead: nothing without a name, disabled without live search, else enriched by any contact."""
    any_of = email.isNotNull() | phone.isNotNull() | site.isNotNull()
    return F.when(T.blank_to_null(name).isNull(), "not_found").when(~live, "disabled").when(yes(failed), "failed").when(any_of, "enriched").otherwise("not_found")


def contact_state(email: Column, confidence: Column, phone: Column, site: Column) -> Column:
    """contact_found by a sure e-mail, partial by any contact, else not_found."""
    return F.when(email.isNotNull() & (confidence >= 0.85), "contact_found").when(email.isNotNull() | phone.isNotNull() | site.isNotNull(), "partial").otherwise("not_found")


# -- parties -----------------------------------------------------------------------------------------


def primary_party() -> Column:
    return F.coalesce("owner_entity", "owner_name", "applicant_name", "company_name", F.lit("Unknown"))


def primary_role() -> Column:
    return F.when(is_owner_known(), "Owner").when(F.col("applicant_name").isNotNull(), "Applicant").when(F.col("company_name").isNotNull(), "Company").otherwise("Unknown")


def owner_contact() -> Column:
    """The person behind the owner, where one is named beside the entity."""
    first = F.coalesce("owner_entity", "owner_name")
    return F.coalesce(F.col("owner_contact_name"), F.when(F.col("owner_name") != first, F.col("owner_name")))


def party_of(parties: Column, role: str) -> Column:
    """The first party whose role holds a word; null where none does."""
    return F.get(F.filter(parties, lambda p: F.contains(F.lower(F.coalesce(p["party_role"], F.lit(""))), F.lit(role))), 0)


def other_parties(parties: Column, *roles: str) -> Column:
    """The parties that party_of picks for none of the roles."""
    picked = F.array(*[party_of(parties, r) for r in roles])
    return F.filter(parties, lambda p: ~F.exists(picked, lambda q: q.eqNullSafe(p)))


# -- dates and events of a lead ----------------------------------------------------------------------


def future_dates(dates: Column, deadlines: tuple[str, ...] = ("deadline",)) -> Column:
    return F.filter(dates, lambda d: d["is_future"] & ~d["label"].isin(*deadlines))


def historical_dates(dates: Column) -> Column:
    return F.filter(dates, lambda d: ~d["is_future"])


def ordered_dates(dates: Column) -> Column:
    """Future dates first, then by day; equal days keep their order."""
    keyed = F.transform(dates, lambda d, i: F.struct((~d["is_future"]).alias("past"), d["day"].alias("day"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda x: x["d"])


def date_of(dates: Column, day: Column) -> Column:
    """The first date element of a day."""
    return F.get(F.filter(dates, lambda d: yes(d["day"] == day)), 0)


def by_rank(items: Column, rank: Callable[[Column], Column]) -> Column:
    """Array elements by a rank, those of one rank in their old order."""
    keyed = F.transform(items, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def evidence_quality(text: Column, applicant: Column, address: Column, confidence: Column, relevance: Column) -> Column:
    """How clear a piece of evidence for an event is: explicit wording first, then names and place, length, and its scores."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = {"ultimately denied": 10, "was recommended denial": 10, "recommended denial by the planning commission": 8, "municipal council": 4, "planning commission": 3}
    wording = sum((F.when(F.contains(low, F.lit(p)), n).otherwise(0) for p, n in points.items()), F.lit(0))
    named = F.when(yes(F.contains(low, F.lower(F.nullif(applicant, F.lit(""))))), 5).otherwise(0)
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(address, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)
    return wording + named + C.any_within(tokens, low) + F.least(F.length(low) / 500, F.lit(3.0)) + F.coalesce(confidence, F.lit(0.0)) + F.coalesce(relevance, F.lit(0.0))


# -- claims ------------------------------------------------------------------------------------------

#: What a lead states, as words before it, column, source and confidence.
CLAIMS = (
    ("Applicant: ", "applicant_name", "application_extraction", 1.0),
    ("Application number: ", "application_number", "application_extraction", 1.0),
    ("Application type: ", "application_type", "application_extraction", 1.0),
    ("Project address: ", "project_address", "application_extraction", 1.0),
    ("Project description: ", "description", "application_extraction", 0.9),
    ("Current status: ", "status_text", "application_extraction", 1.0),
    ("Contact email: ", "contact_email", "applicant_enrichment", 0.8),
    ("Contact phone: ", "contact_phone", "applicant_enrichment", 0.8),
    ("Owner contact email: ", "owner_contact_email", "applicant_enrichment", 0.8),
    ("Owner contact phone: ", "owner_contact_phone", "applicant_enrichment", 0.8),
    ("Staff contact: ", "staff_contact", "government_record", 1.0),
    ("Staff email: ", "staff_email", "government_record", 1.0),
    ("Company: ", "company_name", "applicant_enrichment", 0.8),
    ("Property owner: ", "owner_name", "application_extraction", 0.9),
    ("Approval status: ", "approval_status", "approval_action_intelligence", 0.9),
    ("Approval action: ", "approval_action", "approval_action_intelligence", 0.8),
    ("Approval reason: ", "approval_reason", "approval_action_intelligence", 0.8),
    ("Parcel number: ", "parcel_number", "application_extraction", 1.0),
    ("Acreage: ", "acreage", "application_extraction", 0.9),
    ("Zoning: ", "zoning", "application_extraction", 1.0),
    ("Neighborhood: ", "neighborhood", "application_extraction", 1.0),
)
#: Contacts of the applicant are stated with their source behind them.
SOURCED = (("Applicant email: ", "applicant_email", "email_source"), ("Applicant phone: ", "applicant_phone", "phone_source"))


def claims(leads: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, source, claim, confidence) of everything a lead states, by templates; a column that the table lacks states nothing.

    Fields, score and signals, the scheduled date, future and historical dates, parties with their
    contacts, each with the confidence of its kind.
    """
    have = set(leads.columns)
    entry = lambda source, claim, sure: F.struct(F.lit(source).alias("source"), claim.alias("claim"), F.lit(sure).cast("double").alias("confidence"))
    stated = lambda c: T.blank_to_null(F.col(c).cast("string"))
    said = [F.when(stated(c).isNotNull(), entry(source, F.concat(F.lit(label), stated(c)), sure)) for label, c, source, sure in CLAIMS if c in have]
    for label, c, origin in SOURCED:
        if c in have:
            source = F.coalesce(stated(origin), F.lit("unknown")) if origin in have else F.lit("unknown")
            said.append(F.when(stated(c).isNotNull(), entry("applicant_enrichment", F.concat(F.lit(label), stated(c), F.lit(" (source: "), source, F.lit(")")), 0.9)))
    if "friction_score" in have:
        said.append(F.when(F.col("friction_score") > 0, entry("friction_analysis", F.concat(F.lit("Friction score: "), F.col("friction_score").cast("string")), 0.9)))
    if "next_project_date" in have:
        event = F.coalesce(stated("next_project_event"), F.lit("event")) if "next_project_event" in have else F.lit("event")
        said.append(F.when(F.col("next_project_date").isNotNull(), entry("project_date_extraction", F.concat(F.lit("Scheduled "), event, F.lit(" on "), F.col("next_project_date").cast("string")), 0.95)))
    parts = [F.array_compact(F.array(*said))]
    each = lambda c, source, make, sure: F.transform(F.coalesce(F.col(c), F.array().cast(leads.schema[c].dataType)), lambda x: entry(source, make(x), sure))
    if "friction_signals" in have:
        parts.append(each("friction_signals", "friction_analysis", lambda s: F.concat(F.lit("Friction signal: "), s), 0.9))
    if "project_dates" in have:
        day = lambda words: lambda d: F.concat(F.lit(words), d["label"], F.lit(" on "), d["day"].cast("string"))
        dates = F.coalesce(F.col("project_dates"), F.array().cast(leads.schema["project_dates"].dataType))
        parts += [F.transform(future_dates(dates, ()), lambda d: entry("project_date_extraction", day("Future date: ")(d), 0.8)), F.transform(historical_dates(dates), lambda d: entry("project_date_extraction", day("Historical date: ")(d), 0.7))]
    if "parties" in have:
        role = lambda p: F.concat(F.lit("Project party: "), F.coalesce(p["party_name"], F.lit("unknown")), F.coalesce(F.concat(F.lit(" ("), p["party_role"], F.lit(")")), F.lit("")))
        mail = lambda p: F.concat(F.lit("Party contact email: "), p["party_contact_email"], F.lit(" ("), F.coalesce(p["party_name"], F.lit("unknown")), F.lit(")"))
        parts += [each("parties", "application_extraction", role, 0.9), F.filter(each("parties", "applicant_enrichment", mail, 0.8), lambda e: e["claim"].isNotNull())]
    return leads.select(key, F.posexplode(F.concat(*parts)).alias("ordinal", "_c")).select(key, "ordinal", "_c.source", "_c.claim", "_c.confidence")


def claim_id(registry: Column, prefix: str, source: str) -> Column:
    """The id of the first registered claim of a source that begins with a prefix."""
    return F.get(F.filter(registry, lambda e: F.startswith(e["claim"], F.lit(prefix)) & (e["source"] == source)), 0)["id"]


# -- plug-ins ----------------------------------------------------------------------------------------


class Stages:
    """Named transforms DataFrame -> DataFrame that run in their order; a name may be replaced, an unknown one is an error."""

    def __init__(self) -> None:
        self.steps: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Stages:
        self.steps[name] = step
        return self

    def run(self, df: DataFrame, *names: str) -> DataFrame:
        for n in names or tuple(self.steps):
            if n not in self.steps:
                raise KeyError(f"no stage named {n}")
            df = self.steps[n](df)
        return df


class TextProviders:
    """Makers of text by name, each a transform that adds a column `output` to prompts; an unknown name passes the prompt through."""

    def __init__(self, **makers: Callable[[DataFrame], DataFrame]) -> None:
        self.makers = makers

    def generate(self, prompts: DataFrame, provider: str) -> DataFrame:
        passed = prompts.withColumn("output", F.col("prompt"))
        maker = self.makers.get(provider)
        if maker is None:
            return passed
        try:
            return maker(prompts)
        except Exception as e:  # a provider that cannot be built answers with its error
            return prompts.withColumn("output", F.lit(f"[{type(e).__name__}: {e}]"))


def profile_context(df: DataFrame, fields: dict[str, list[str]]) -> Column:
    """Grouped "field: value" lines of a record; blank fields and empty groups are left out, nested values are JSON."""
    def said(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        v = F.to_json(F.col(c)) if kind in ("array", "struct", "map") else F.col(c).cast("string")
        return F.when((T.blank_to_null(v).isNotNull()) & (v != "[]"), F.concat(F.lit(f"{c}: "), v))

    groups = [F.concat_ws("\n", *[said(c) for c in cs]) for cs in fields.values()]
    return F.concat_ws("\n\n", *[F.when(g != "", F.concat(F.lit(f"{name.upper()}\n"), g)) for name, g in zip(fields, groups, strict=True)])


def counts_of(spark: SparkSession, **conditions: tuple[DataFrame, Column | None]) -> DataFrame:
    """A run's counts in one row and one job: each name counts the rows of a table that meet its condition."""
    parts = [df.agg(F.count_if(c if c is not None else F.lit(True)).alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, c) in conditions.items()]
    union = reduce(lambda a, b: a.union(b), parts)
    return union.agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in conditions])


# -- the canonical record ----------------------------------------------------------------------------

#: Columns of the canonical record by group, in their order.
GROUPS = {
    "identity": ("opportunity_id", "application_number", "applicant_name", "applicant_email", "applicant_phone"), "project": ("application_type", "project_address", "neighborhood", "description"),
    "property": ("parcel_number", "acreage", "zoning"), "owner": ("owner_name", "owner_entity", "owner_type", "owner_contact_name", "owner_contact_email", "owner_contact_phone", "owner_website", "owner_source", "owner_confidence"),
    "applicant": ("applicant_entity", "applicant_contact_name", "applicant_contact_email", "applicant_contact_phone", "applicant_source", "applicant_confidence"), "staff": ("staff_contact", "staff_email", "staff_phone"),
    "friction": ("friction_score", "friction_signals"), "timing": ("next_project_date", "next_project_event", "next_project_time", "has_future_opportunity", "days_until_event", "urgency"),
    "qualification": ("priority", "priority_score", "is_actionable", "opportunity_reason"), "provenance": ("source", "source_url", "municipality", "state"), "meta": ("created_at", "builder_version"),
}
ALIASES = {"application_type": ("type", "record_type"), "project_address": ("address",), "applicant_entity": ("company_name",), "owner_website": ("company_website",)}


def canonical(records: DataFrame, reference: Column) -> DataFrame:
    """records in the canonical columns: aliases coalesced, what depends on the date worked out, missing columns null.

    The next date and its event count only while the date lies ahead; days, urgency, score and priority follow from it.
    """
    from quarry.functions import dates as D
    from quarry.operators import signals as S

    have = set(records.columns)

    def of(name: str, kind: str = "string") -> Column:
        found = [F.col(c) for c in (name, *ALIASES.get(name, ())) if c in have]
        if not found:
            return F.lit(None).cast(kind)
        return T.first_stated(*found) if kind == "string" else found[0]

    typed = {"friction_score": "int", "friction_signals": "array<string>", "next_project_date": "date", "created_at": "timestamp", "owner_confidence": "string"}
    base = records.select(*[of(c, typed.get(c, "string")).alias(c) for g in GROUPS.values() for c in g if c not in ("has_future_opportunity", "days_until_event", "urgency", "priority", "priority_score", "is_actionable", "opportunity_reason")])
    number, address, name = F.col("application_number"), F.col("project_address"), F.col("applicant_name")
    future = D.is_future(F.col("next_project_date"), reference)
    base = base.withColumns({"opportunity_id": F.coalesce("opportunity_id", T.slug(number, address, name)), "has_future_opportunity": future, "friction_score": F.least(F.greatest(F.coalesce("friction_score", F.lit(0)), F.lit(0)), F.lit(100)), "friction_signals": F.coalesce("friction_signals", F.array().cast("array<string>")), "is_actionable": is_actionable(F.col("application_type"))})
    ahead = F.col("has_future_opportunity")
    base = base.withColumns({c: F.when(ahead, F.col(c)) for c in ("next_project_date", "next_project_event", "next_project_time")})
    base = base.withColumn("days_until_event", D.days_until(F.col("next_project_date"), reference))
    critical = F.arrays_overlap("friction_signals", F.array(*[F.lit(x) for x in ("denied", "withdrawn", "recommended_denial", "appeal")]))
    asks = (F.col("friction_score"), ahead, F.col("is_actionable"), F.col("days_until_event"), yes(critical))
    reason = F.concat_ws("; ", F.when(F.size("friction_signals") > 0, F.concat(F.lit("signals: "), F.array_join("friction_signals", ", "))), F.when(ahead, F.concat(F.lit("next date "), F.col("next_project_date").cast("string"))), F.when(F.col("is_actionable"), "actionable type"))
    base = base.withColumns({"urgency": S.urgency(F.col("days_until_event"), ahead), "priority_score": S.queue_score(*asks), "priority": S.queue_level(*asks), "opportunity_reason": T.blank_to_null(reason)})
    return base.select(*[c for g in GROUPS.values() for c in g])
