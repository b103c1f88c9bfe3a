"""Queries over packets: labelled tables, reports per number, events and their dates.

The driver's tables hold no packets with labelled tables, so rows are written out as packets and read
back: what comes out must be what the rows state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import evidence as E
from quarry.operators import extract as X
from quarry.operators import investigation as I
from quarry.operators import rows as R
from quarry.plans.registry import query
from quarry.session import load


def after(label: str, c: Column) -> Column:
    """A line "label value", or none for a null."""
    return F.concat(F.lit(label), c)


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """(pud_id, text): each row of the second list as a packet; odd rows have the owner on lines below its label."""
    p = load(spark, sf, "pud871_opportunity")
    c = lambda n: X.stated(F.col(n))
    contact = F.nullif(F.concat_ws(" | ", c("owner_name"), F.nullif(F.concat_ws(", ", c("owner_contact_email"), c("owner_contact_phone")), F.lit(""))), F.lit(""))
    owner = F.when(F.col("pud_id") % 2 == 0, after("Property Owner: ", c("owner_entity"))).otherwise(F.concat_ws("\n", after("Property Owner:\n", c("owner_entity")), after("c/o ", c("owner_name")), F.lit("")))
    lines = F.concat_ws(
        "\n", after("Case ", c("application_number")), owner, after("Owner Contact: ", contact), after("Applicant of Record: ", c("applicant_name")), after("Engineer of Record: ", c("staff_contact_name")), after("Zoning: ", c("application_type")),
        F.lit(""), F.lit("SECTION 1"), F.concat(c("applicant_name"), F.lit(" requests approval located at "), c("project_address"), F.lit(". ")), after("Property Owner: nobody of section 1 ", F.lit("")),
    )
    return p.select("pud_id", lines.alias("text"))


def said(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '[\s\x00]+', ' ', 'g')), '')"


PUD = f"""p AS (SELECT pud_id, {said('owner_entity')} AS entity, {said('owner_name')} AS name, lower(regexp_extract({said('owner_contact_email')}, '{K.EMAIL}')) AS email, {said('owner_contact_phone')} AS phone, {said('applicant_name')} AS applicant,
  {said('staff_contact_name')} AS staff, {said('application_type')} AS kind, {said('project_address')} AS addr FROM pud871_opportunity)"""
KNOWN = X.KNOWN.replace("'", "''")


@query(f"""WITH {PUD}, q AS (SELECT * REPLACE (coalesce(name, CASE WHEN email IS NULL AND NOT regexp_matches(phone, '{K.PHONE}') THEN phone END) AS name) FROM p),
o AS (SELECT *, CASE WHEN pud_id % 2 = 0 THEN entity WHEN NOT regexp_matches(entity, '{KNOWN}') THEN entity END AS e FROM q)
SELECT pud_id, coalesce(name, nullif(regexp_replace(e, ',+$', ''), '')) AS owner_name, nullif(regexp_replace(e, ',+$', ''), '') AS owner_entity, CASE WHEN e IS NOT NULL THEN 'Entity' WHEN name IS NOT NULL THEN 'Individual' END AS owner_type, name AS contact_name,
  nullif(email, '') AS contact_email, CASE WHEN regexp_matches(phone, '{K.PHONE}') THEN right(regexp_replace(regexp_extract(phone, '{K.PHONE}'), '[^0-9]', '', 'g'), 10) END AS contact_phone FROM o""")
def packet_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Owner and contact of record as the packets' tables state them, on one line or below the label."""
    return packets(spark, sf).select("pud_id", X.region(F.col("text")).alias("t")).select("pud_id", X.owner(F.col("t")).alias("o")).select("pud_id", *[f"o.{c}" for c in ("owner_name", "owner_entity", "owner_type", "contact_name", "contact_email", "contact_phone")])


@query(f"WITH {PUD} SELECT pud_id, applicant, staff AS engineer, kind AS zoning, CAST(staff IS NOT NULL AS INT) AS parties FROM p")
def packet_parties(spark: SparkSession, sf: str) -> DataFrame:
    """Applicant of record, licensed parties and zoning of the packets' tables; what stands after section 1 is no table."""
    t = F.col("t")
    x = packets(spark, sf).select("pud_id", X.region(F.col("text")).alias("t")).select("pud_id", X.applicant_of_record(t)["entity"].alias("applicant"), X.parties(t).alias("p"), X.property_details(t)["zoning"].alias("zoning"))
    return x.select("pud_id", "applicant", F.get("p", 0)["party_name"].alias("engineer"), "zoning", F.size("p").alias("parties"))


ADDRESS_LIKE = r"(?i)\b[0-9]+ (?:[NSEW]|North|South|East|West)?\s*[A-Za-z'-]+(?: [A-Za-z'-]+)? (?:Street|Avenue|Road|Drive|Lane|Court|Boulevard|Parkway|Place)\b"


@query(f"""WITH {PUD}, s AS (SELECT pud_id, regexp_replace(regexp_extract(addr, '{X.SPECIAL_ADDRESS.replace("'", "''")}'), '^$', '') AS a, regexp_extract(addr, '{X.ADDRESS.replace("'", "''")}') AS b, addr, applicant FROM p WHERE applicant IS NOT NULL AND length(addr) BETWEEN 6 AND 200 AND NOT regexp_matches(addr, '[.]\\s|Neighborhood'))
SELECT pud_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE addr END AS address FROM s""")
def packet_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The address that a packet's request is located at, by its special form, its plain one, or as it stands; for requests whose address holds no sentence end."""
    clear = load(spark, sf, "pud871_opportunity").where(X.stated(F.col("applicant_name")).isNotNull() & F.length(X.stated(F.col("project_address"))).between(6, 200) & ~X.stated(F.col("project_address")).rlike(r"[.]\s|Neighborhood")).select("pud_id")
    return packets(spark, sf).join(clear, "pud_id", "left_semi").select("pud_id", X.address(F.regexp_extract("text", r"(?s)SECTION 1\n(.*)$", 1)).alias("address"))


@query("""SELECT lead_id, CASE WHEN regexp_matches(t, 'ordinance text amendment') THEN 'Ordinance Text Amendment' WHEN regexp_matches(t, 'zone map amendment') THEN 'Zone Map Amendment' WHEN contains(t, 'concept plan') THEN 'Concept Plan' WHEN contains(t, 'project plan') THEN 'Project Plan'
  WHEN regexp_matches(t, '\\bvariance\\b') THEN 'Variance' WHEN contains(t, 'conditional use') THEN 'Conditional Use' WHEN regexp_matches(t, '\\bsubdivision\\b') THEN 'Subdivision' WHEN regexp_matches(t, 'general plan (map )?amendment|amendment to the general plan map') THEN 'General Plan Amendment' END AS kind
FROM (SELECT lead_id, lower(concat_ws('. ', application_type, description)) AS t FROM opportunity)""")
def block_types(spark: SparkSession, sf: str) -> DataFrame:
    """The type of application that a block speaks of, the more specific first."""
    return load(spark, sf, "opportunity").select("lead_id", X.application_type(F.concat_ws(". ", "application_type", "description")).alias("kind"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(lead_id, applicant, text): each lead as a request with its contacts behind the name."""
    o = load(spark, sf, "opportunity")
    name = X.stated(F.col("applicant_name"))
    text = F.concat(F.lit("The hearing opened. "), name, F.lit(" ("), F.concat_ws(", ", F.lit("clerk@city.example"), F.lower(F.trim("applicant_email")), "applicant_phone"), F.lit(") requests approval of a plan "), F.coalesce(F.upper(F.trim("application_number")), F.lit("")), F.lit("."))
    return o.select("lead_id", name.alias("applicant"), text.alias("text")).where("applicant is not null")


@query(f"""SELECT lead_id, CASE WHEN regexp_matches(lower(trim(applicant_email)), '{K.EMAIL}') THEN regexp_extract(lower(trim(applicant_email)), '{K.EMAIL}') END AS email,
  CASE WHEN regexp_matches(lower(trim(applicant_email)), '{K.EMAIL}') AND regexp_matches(applicant_phone, '{K.PHONE}') THEN right(regexp_replace(regexp_extract(applicant_phone, '{K.PHONE}'), '[^0-9]', '', 'g'), 10) END AS phone FROM opportunity WHERE trim(applicant_name) <> ''""")
def applicant_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The contact right behind an applicant's name: the municipality's address is passed over, a phone needs an address."""
    r = requests(spark, sf).select("lead_id", X.applicant_contact(F.col("text"), F.col("applicant"), ("city.example",)).alias("c"))
    return r.select("lead_id", "c.email", "c.phone")


def joint_packets(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): the leads of a block of ids in one packet, each with its number and table; later ones follow without a gap."""
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"), X.stated(F.col("owner_name")).alias("owner"), X.stated(F.col("applicant_name")).alias("applicant")).where(F.col("app").rlike(f"^{K.APPLICATION_NUMBER}$"))
    one = R.first_wins(o, F.col("app"), F.col("lead_id"))
    part = F.concat_ws("\n", "app", F.lit("STAFF REPORT ON THE APPLICANT"), after("Property Owner: ", F.col("owner")), after("Applicant of Record: ", F.col("applicant")), F.lit(""))
    rows = one.select((F.expr("lead_id div 50")).alias("doc_id"), "lead_id", part.alias("part"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lead_id", "part"))).alias("x")).select("doc_id", F.array_join(F.col("x.part"), "\n").alias("text"))


@query(f"""WITH o AS (SELECT upper(trim(application_number)) AS app, arg_min({{'o': {said('owner_name')}, 'a': {said('applicant_name')}}}, lead_id) AS r, min(lead_id) AS lead_id FROM opportunity WHERE regexp_matches(upper(trim(application_number)), '^{K.APPLICATION_NUMBER}$') GROUP BY 1)
SELECT app AS number, r.o AS owner_name, r.a AS applicant FROM o WHERE r.o IS NOT NULL OR r.a IS NOT NULL""")
def report_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Owner and applicant of every number from its own report in a joint packet; a report ends where the next number begins."""
    return X.report_identity(joint_packets(spark, sf)).select("number", F.col("owner.owner_name").alias("owner_name"), F.col("applicant.entity").alias("applicant"))


@query(f"""WITH o AS (SELECT upper(trim(application_number)) AS app, min(lead_id) AS lead_id FROM opportunity WHERE regexp_matches(upper(trim(application_number)), '^{K.APPLICATION_NUMBER}$') GROUP BY 1),
n AS (SELECT lead_id // 50 AS doc_id, app, row_number() OVER (PARTITION BY lead_id // 50 ORDER BY lead_id) AS item FROM o) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST((item - 1) % 7 + 1 AS INT) AS item, first(app ORDER BY item) AS number FROM n GROUP BY 1, 2""")
def item_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The block under every printed item number of a packet; where a number comes again, its first block."""
    d = joint_packets(spark, sf)
    hits = E.hits(d, "text", rf"\b{K.APPLICATION_NUMBER}\b").select("doc_id", "start", "hit")
    order = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "hit"))).alias("h"))
    lines = F.array_join(F.transform("h", lambda x, i: F.concat(F.lit("Item "), (i % 7 + 1).cast("string"), F.lit(" of the agenda: "), x["hit"])), "\n")
    return X.items(order.select("doc_id", lines.alias("text"))).select("doc_id", "item", X.application_number(F.col("body")).alias("number"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """(lead_id, text): the story of each lead's denial, with the days it was created and updated; every third only tells one day."""
    day = lambda c: F.date_format(c, "MMMM d, yyyy")
    both = F.concat(F.lit("The request was recommended denial by the Planning Commission on "), day("created_at"), F.lit(", and ultimately denied by the Municipal Council on "), day("updated_at"), F.lit(" at 6:00 PM."))
    one = F.concat(F.lit("A neighbor filed an appeal. It is dated "), day("created_at"), F.lit("; staff met at 9:30 am before."))
    vague = F.concat(F.lit("Letters of "), day("created_at"), F.lit(" and "), day("updated_at"), F.lit(" were read. The planning commission may make any of the following findings."))
    text = F.when(F.col("lead_id") % 3 == 0, both).when(F.col("lead_id") % 3 == 1, one).otherwise(vague)
    return load(spark, sf, "opportunity").where("created_at is not null and updated_at is not null").select("lead_id", text.alias("text"))


DECIDED = "FROM opportunity WHERE created_at IS NOT NULL AND updated_at IS NOT NULL"


@query(f"""SELECT lead_id, CAST(CASE lead_id % 3 WHEN 0 THEN created_at::DATE WHEN 1 THEN created_at::DATE ELSE CASE WHEN created_at::DATE = updated_at::DATE THEN created_at::DATE END END AS VARCHAR) AS recommended,
  CAST(CASE lead_id % 3 WHEN 0 THEN updated_at::DATE WHEN 1 THEN created_at::DATE ELSE CASE WHEN created_at::DATE = updated_at::DATE THEN created_at::DATE END END AS VARCHAR) AS denied {DECIDED}""")
def event_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The day of each kind of decision: the wording tells the first from the second, and a lone date stands for any kind."""
    d = decisions(spark, sf)
    return d.select("lead_id", *[X.event_date(F.lit(k), F.col("text")).cast("string").alias(n) for k, n in (("recommended_denial", "recommended"), ("denied", "denied"))])


@query(f"SELECT lead_id, lead_id % 3 = 0 AS recommended, lead_id % 3 = 0 AS denied, lead_id % 3 <> 2 AS appeal, lead_id % 3 = 2 AS boilerplate {DECIDED}")
def outcome_wording(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text tells of an outcome that happened; procedural wording never does, and counts as boilerplate."""
    d = decisions(spark, sf)
    return d.select("lead_id", *[X.is_outcome(F.lit(k), F.col("text")).alias(n) for k, n in (("recommended_denial", "recommended"), ("denied", "denied"), ("appeal", "appeal"))], X.is_boilerplate(F.col("text")).alias("boilerplate"))


@query(f"SELECT lead_id, CASE lead_id % 3 WHEN 0 THEN '6:00 PM' WHEN 1 THEN '9:30 AM' END AS time {DECIDED}")
def near_times(spark: SparkSession, sf: str) -> DataFrame:
    """The time of day beside the first date of a text."""
    d = decisions(spark, sf).withColumn("hit", F.regexp_extract("text", D.MENTION, 0)).withColumn("at", F.position(F.col("hit"), F.col("text")) - 1)
    return d.select("lead_id", X.near_time(F.col("text"), F.col("at"), F.length("hit")).alias("time"))


@query(f"""SELECT lead_id, CASE lead_id % 3 WHEN 0 THEN 'municipal_council_event' WHEN 1 THEN CASE WHEN created_at::DATE > DATE '2024-06-01' THEN 'future_project_event' ELSE 'historical_event' END ELSE 'planning_commission_event' END AS label,
  CASE WHEN created_at::DATE > DATE '2024-06-01' THEN 20 ELSE 0 END + CASE lead_id % 3 WHEN 0 THEN 56 + 48 + 40 + 50 + 50 + 9 WHEN 1 THEN 18 + CASE WHEN created_at::DATE > DATE '2024-06-01' THEN 4 ELSE 1 END ELSE 24 + 8 END AS score {DECIDED}""")
def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label and evidence of the first date of each text, by its sentence first and the text around it second."""
    d = decisions(spark, sf).withColumn("hit", F.regexp_extract("text", D.MENTION, 0)).withColumn("at", F.position(F.col("hit"), F.col("text")) - 1)
    s, c = T.sentence_at(F.col("text"), F.col("at")), X.local_context(F.col("text"), F.col("at"))
    future = D.is_future(D.parse_date(F.col("hit")), F.lit("2024-06-01").cast("date"))
    m = d.select("lead_id", s.alias("s"), c.alias("c"), future.alias("f")).withColumn("label", X.date_label(F.col("s"), F.col("c"), F.col("f")))
    return m.select("lead_id", "label", X.date_score(F.col("s"), F.col("c"), F.col("f"), F.col("label")).alias("score"))


@query(r"""WITH e AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, evidence_text AS t, trim(regexp_replace(lower(evidence_text), '[^a-z0-9]+', ' ', 'g')) AS k FROM investigation_evidence WHERE evidence_text IS NOT NULL AND trim(entity_identifier) <> ''),
l AS (SELECT upper(trim(application_number)) AS app, arg_min({'n': applicant_name, 'a': project_address}, lead_id) AS r FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1),
m AS (SELECT evidence_id, contains(upper(t), app) AS h, coalesce(contains(k, nullif(trim(regexp_replace(lower(r.n), '[^a-z0-9]+', ' ', 'g')), '')), false) AS n, coalesce(contains(k, nullif(trim(regexp_replace(lower(r.a), '[^a-z0-9]+', ' ', 'g')), '')), false) AS a FROM e JOIN l USING (app))
SELECT evidence_id, least(CAST(h AS INT) * 60 + CAST(n AS INT) * 25 + CAST(a AS INT) * 25, 100) / 100 AS relevance, least(45 + CAST(h AS INT) * 35 + CAST(n AS INT) * 15 + CAST(a AS INT) * 10, 99) / 100 AS confidence FROM m""")
def hit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How far every evidence text concerns its application, and how sure a hit in it would be."""
    o = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", "applicant_name", "project_address")
    lead = R.first_wins(o, F.col("app"), F.col("lead_id"), keep_keyless=False)
    e = load(spark, sf, "investigation_evidence").dropDuplicates(["evidence_id"]).select("evidence_id", T.record_key(F.col("entity_identifier")).alias("app"), "evidence_text").where("evidence_text is not null and app is not null")
    args = (F.col("app"), F.col("applicant_name"), F.col("project_address"), F.col("evidence_text"))
    return e.join(lead, "app").select("evidence_id", X.hit_relevance(*args).alias("relevance"), X.hit_confidence(*args).alias("confidence"))


@query(r"""WITH u AS (SELECT DISTINCT source_url FROM opportunity WHERE source_url IS NOT NULL UNION SELECT url FROM documents WHERE url IS NOT NULL), n AS (SELECT source_url AS url, regexp_extract(regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '([^/]*)/*$', 1) AS f FROM u)
SELECT url, CASE WHEN f = '' THEN 'government_document.pdf' WHEN lower(f) LIKE '%.pdf' THEN f ELSE f || '.pdf' END AS file FROM n""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """The file name under which a document of each address would be kept."""
    u = load(spark, sf, "opportunity").select(F.col("source_url").alias("url")).union(load(spark, sf, "documents").select("url")).where("url is not null").distinct()
    return u.select("url", X.file_name(F.col("url")).alias("file"))


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(id, url, html): every enrichment row with a site as a page that links to it, to a map and to the city."""
    e = load(spark, sf, "applicant_enrichment").where("company_name is not null and company_website is not null")
    link = F.concat(F.lit('<p>'), "company_name", F.lit(' <a href="'), "company_website", F.lit('">Visit</a></p>'))
    html = F.concat(F.lit("<html><body><h1>"), "company_name", F.lit("</h1>"), link, F.lit('<div><a href="https://maps.google.com/?q=1">Directions</a> <a href="/about">About</a></div><p>'), "company_name", F.lit(' <a href="https://city.gov/agenda">Agenda</a><a href="../team#x">Team</a></p></body></html>'))
    return e.select("enrichment_id", "company_name", F.lit("https://pages.example/a/b").alias("url"), html.alias("html"))


@query("""SELECT enrichment_id, unnest([company_website, 'https://maps.google.com/?q=1', 'https://pages.example/about', 'https://city.gov/agenda', 'https://pages.example/a/../team#x']) AS link, unnest([c || ' Visit', 'Directions', 'About', c || ' Agenda Team', c || ' Agenda Team']) AS context
FROM (SELECT *, trim(regexp_replace(company_name, '\\s+', ' ', 'g')) AS c FROM applicant_enrichment) WHERE company_name IS NOT NULL AND company_website IS NOT NULL AND regexp_matches(company_website, '(?i)^https?://')
UNION ALL SELECT enrichment_id, unnest([CASE WHEN regexp_matches(company_website, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE 'https://pages.example/a/' || company_website END, 'https://maps.google.com/?q=1', 'https://pages.example/about', 'https://city.gov/agenda', 'https://pages.example/a/../team#x']), unnest([c || ' Visit', 'Directions', 'About', c || ' Agenda Team', c || ' Agenda Team'])
FROM (SELECT *, trim(regexp_replace(company_name, '\\s+', ' ', 'g')) AS c FROM applicant_enrichment) WHERE company_name IS NOT NULL AND company_website IS NOT NULL AND NOT regexp_matches(company_website, '(?i)^https?://')""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of the pages as an absolute address, with the text of the small element it stands in."""
    a = I.anchors(site_pages(spark, sf))
    return a.select("enrichment_id", I.absolute(F.col("href"), F.col("url")).alias("link"), F.trim("context").alias("context"))


@query("""SELECT CAST(enrichment_id AS VARCHAR) AS app, regexp_replace(company_website, '[.,);\\]]+$', '') AS website FROM applicant_enrichment WHERE len(list_filter(regexp_extract_all(coalesce(company_name, ''), '[A-Za-z]{2,}'), lambda x: true)) > 0 AND regexp_matches(company_website, '(?i)^https?://')
UNION SELECT CAST(enrichment_id AS VARCHAR), 'https://pages.example/a/../team#x' FROM applicant_enrichment WHERE len(regexp_extract_all(coalesce(company_name, ''), '[A-Za-z]{2,}')) > 0 AND company_website IS NOT NULL
UNION SELECT CAST(enrichment_id AS VARCHAR), 'https://pages.example/a/' || company_website FROM applicant_enrichment WHERE len(regexp_extract_all(coalesce(company_name, ''), '[A-Za-z]{2,}')) > 0 AND NOT regexp_matches(company_website, '(?i)^https?://') AND NOT regexp_matches(company_website, '^[A-Za-z][A-Za-z0-9+.-]*:')""")
def company_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of relevant pages whose own context names the lead, without maps and governments."""
    none = F.lit(None).cast("string")
    p = site_pages(spark, sf).select(F.col("enrichment_id").cast("string").alias("app"), "url", "html", F.col("company_name").alias("text"), F.col("company_name").alias("applicant_name"), none.alias("owner_entity"), none.alias("address"), none.alias("neighborhood"))
    return I.company_links(p, "public_web").select("app", "website")


@query("""WITH s AS (SELECT CAST(enrichment_id AS VARCHAR) AS app, company_website AS site, applicant_name AS n, CASE WHEN regexp_matches(lower(applicant_email), '^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$') AND split_part(lower(applicant_email), '@', 2) NOT IN ('example.com', 'example.org', 'example.net', 'test.com', 'localhost') THEN lower(applicant_email) END AS mail
  FROM applicant_enrichment WHERE regexp_matches(company_website, '^https?://[^/]+$'))
SELECT app, 'website' AS field, site AS value, site AS source_url, CAST(0.75 AS DOUBLE) AS confidence_score FROM s
UNION ALL SELECT app, 'email', mail, site || '/team', greatest(least(88 - CASE WHEN split_part(mail, '@', 1) IN ('info', 'contact', 'hello', 'support', 'admin', 'office', 'sales', 'marketing', 'noreply', 'no-reply', 'webmaster') THEN 15 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_extract_all(coalesce(n, ''), '[A-Za-z]{3,}'), lambda t: contains(split_part(mail, '@', 1), lower(t)))) > 0 THEN 8 ELSE 0 END, 99), 0) / 100 FROM (SELECT DISTINCT s.app, s.site, s.n, t.mail FROM s JOIN s t USING (site)) WHERE mail IS NOT NULL""")
def website_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each enrichment row's site gives: its root page and a long team page; the short contact page gives nothing."""
    e = load(spark, sf, "applicant_enrichment").where(F.col("company_website").rlike("^https?://[^/]+$")).select(F.col("enrichment_id").cast("string").alias("app"), F.col("company_website").alias("site"), F.col("applicant_name").alias("owner_name"), F.lower("applicant_email").alias("mail"))
    page = lambda path, text: e.select(F.concat("site", F.lit(path)).alias("url"), text.alias("text"))
    filler = F.lit("Our people have worked on plans and permits in the towns of the valley for more than forty years. Write to us: ")
    pages = page("", F.lit("Welcome")).union(page("/team", F.concat(filler, F.coalesce("mail", F.lit(""))))).union(page("/contact", F.lit("desk@short.example"))).distinct()
    return I.website(e.select("app", "owner_name"), e.select("app", "site"), pages).select("app", "field", "value", "source_url", "confidence_score")
