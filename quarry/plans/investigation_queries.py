"""Queries over what searches and pages tell of leads: evidence generators, scores, identities, resumable sources.

The tables of evidence and contact rows stand for search results: their source is the link, their title
and text are what a search shows. Texts of documents stand for fetched pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import text as T
from quarry.operators import investigation as I
from quarry.operators import rows as R
from quarry.plans.registry import query
from quarry.session import load


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per application: the names and place of its first lead."""
    o = load(spark, sf, "opportunity").select(T.record_key(F.col("application_number")).alias("app"), "lead_id", F.col("applicant_entity").alias("owner_entity"), "owner_name", "applicant_name", "applicant_email", F.col("project_address").alias("address"), "neighborhood", "municipality", "state", "source_url")
    one = R.first_wins(o, F.col("app"), F.col("lead_id"), keep_keyless=False)
    return one.withColumn("primary", I.primary(F.col("owner_entity"), F.col("owner_name"), F.col("applicant_name")))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """(app, link, title, snippet): evidence and contact rows as search results, each once."""
    e = load(spark, sf, "investigation_evidence").select(T.record_key(F.col("entity_identifier")).alias("app"), F.col("source_url").alias("link"), F.col("source_title").alias("title"), F.col("evidence_text").alias("snippet"))
    c = load(spark, sf, "contact_candidate").select(T.record_key(F.col("application_number")).alias("app"), F.col("source_url").alias("link"), F.col("source_title").alias("title"), F.col("value").alias("snippet"))
    return e.union(c).where("app is not null").distinct()


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """Results beside their lead; results of unknown applications fall away."""
    return results(spark, sf).join(leads(spark, sf).drop("source_url"), "app")


HOST = "nullif(regexp_replace(regexp_extract(lower({0}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[.]', ''), '')"
GOVERNMENT = "(split_part(value, '@', 2) LIKE '%.gov' OR split_part(value, '@', 2) LIKE '%.gov.%')"
BASE = f"""l AS (SELECT upper(trim(application_number)) AS app, arg_min({{'e': applicant_entity, 'o': owner_name, 'a': applicant_name, 'd': project_address, 'n': neighborhood}}, lead_id) AS r FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1),
leads AS (SELECT app, r.e AS owner_entity, r.o AS owner_name, r.a AS applicant_name, r.d AS address, r.n AS neighborhood, coalesce(nullif(trim(r.e), ''), nullif(trim(r.o), ''), nullif(trim(r.a), '')) AS prim FROM l),
res AS (SELECT upper(trim(entity_identifier)) AS app, source_url AS link, source_title AS title, evidence_text AS snippet FROM investigation_evidence WHERE trim(entity_identifier) <> ''
  UNION SELECT upper(trim(application_number)), source_url, source_title, value FROM contact_candidate WHERE trim(application_number) <> ''),
x AS (SELECT leads.*, link, title, snippet, {HOST.format('link')} AS host, coalesce(title, '') || chr(10) || coalesce(snippet, '') AS both_text FROM res JOIN leads USING (app))"""


def contact_sql(source: str, email: float, phone: float, text: str = "both_text") -> str:
    """SELECTs of the addresses and phones of a CTE's texts."""
    return f"""SELECT app, 'email' AS field, value, link AS source_url, CAST({email} AS DOUBLE) AS confidence_score FROM (SELECT DISTINCT app, link, lower(unnest(regexp_extract_all({text}, '{K.EMAIL}'))) AS value FROM {source})
  WHERE split_part(value, '@', 2) NOT IN {K.PLACEHOLDER_DOMAINS} AND NOT {GOVERNMENT}
UNION SELECT app, 'phone', value, link, CAST({phone} AS DOUBLE) FROM (SELECT DISTINCT app, link, right(regexp_replace(unnest(regexp_extract_all({text}, '{K.PHONE}')), '[^0-9]', '', 'g'), 10) AS value FROM {source})"""


COLUMNS = ("app", "field", "value", "source_url", "confidence_score")
SOCIAL = " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in K.SOCIAL_HOSTS)
MAPS = " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in K.MAP_HOSTS)
WEB = f"""web AS ({contact_sql('x', 0.55, 0.5)}
UNION SELECT app, 'website', link, link, 0.45 FROM x WHERE host IS NOT NULL AND NOT ({SOCIAL}) AND NOT ({MAPS}) AND host NOT IN {K.DIRECTORY_HOSTS})"""


@query(f"WITH {BASE}, {WEB} SELECT app, field, min(value) AS value, source_url, max(confidence_score) AS confidence_score FROM web GROUP BY app, field, lower(value), source_url")
def web_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What search results give by themselves."""
    return I.web(searched(spark, sf)).select(*COLUMNS)


@query(f"WITH {BASE}, {WEB} SELECT DISTINCT x.app, CASE WHEN x.app IN (SELECT app FROM web) THEN 'ENRICHED' ELSE 'PARTIAL' END AS status FROM x")
def web_status(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the web source for every lead that has results."""
    s = searched(spark, sf)
    return I.web_status(s, I.web(s))


@query(f"""WITH {BASE}, y AS (SELECT *, concat_ws(' ', title, snippet) AS said FROM x WHERE NOT coalesce({SOCIAL}, false))
SELECT app, 'search_result' AS field, link AS value, link AS source_url, CAST(0.3 AS DOUBLE) AS confidence_score FROM y WHERE link IS NOT NULL UNION {contact_sql('y', 0.55, 0.65, 'said')}""")
def search_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Results as evidence of their own, with what their title and snippet give."""
    return I.search_rows(searched(spark, sf)).select(*COLUMNS)


NAME_HITS = "len(list_filter(list_transform(regexp_extract_all(coalesce(applicant_name, ''), '[A-Za-z]{2,}'), lambda t: lower(t)), lambda t: contains(lower(said), t)))"


@query(rf"""WITH {BASE}, y AS (SELECT *, trim(regexp_replace(concat_ws(' ', trim(regexp_replace(title, '[\s\x00]+', ' ', 'g')), trim(regexp_replace(snippet, '[\s\x00]+', ' ', 'g'))), '[\s\x00]+', ' ', 'g')) AS said FROM x),
s AS (SELECT app, left(said, 500) AS value, link AS source_url, least((35 + least({NAME_HITS} * 15, 30)) / 100, 0.9) AS score FROM y WHERE said <> '')
SELECT app, min(md5(lower(value))) AS value, source_url, CAST(max(score) AS DOUBLE) AS confidence_score FROM s GROUP BY app, lower(value), source_url""")
def parsed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every result's text, surer the more of the applicant's name it holds."""
    r = I.parsed_results(searched(spark, sf), F.col("applicant_name"))
    return r.select("app", F.md5(F.lower("value")).alias("value"), "source_url", "confidence_score")


@query(f"""WITH {BASE}, y AS (SELECT * FROM x WHERE regexp_matches(host, '^dir[0-9]+[.]example$'))
SELECT DISTINCT app, 'business_listing' AS field, prim AS value, link AS source_url, CAST(0.55 AS DOUBLE) AS confidence_score FROM y WHERE prim IS NOT NULL UNION {contact_sql('y', 0.5, 0.45)}""")
def directory_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What the directories of these tables list."""
    return I.directories(searched(spark, sf), lambda h: C.false_if_null(h.rlike(r"^dir[0-9]+\.example$"))).select(*COLUMNS)


@query(f"WITH {BASE} SELECT DISTINCT app, 'linkedin_profile' AS field, link AS value, link AS source_url, CAST(0.6 AS DOUBLE) AS confidence_score FROM x WHERE contains(host, 'site1')")
def profile_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Links into a network, here the hosts named site1 and on."""
    return I.profiles(searched(spark, sf), "site1").select(*COLUMNS)


@query(f"""WITH {BASE} SELECT DISTINCT app, 'business_record' AS field, prim AS value, link AS source_url, CAST(0.5 AS DOUBLE) AS confidence_score FROM x
WHERE host IS NOT NULL AND regexp_matches(lower(prim), '{"|".join(K.COMPANY_WORDS)}') AND regexp_matches(lower(both_text), '{"|".join(K.RECORD_WORDS)}')""")
def public_record_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Results that speak of a registered company."""
    return I.public_records(searched(spark, sf)).select(*COLUMNS)


def longer_sql(column: str, n: int) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), ' +'), lambda t: length(t) > {n})"


@query(f"""WITH {BASE} SELECT app, 'project_relationship' AS field, concat_ws(' -> ', prim, address) AS value, link AS source_url, CAST(0.6 AS DOUBLE) AS confidence_score FROM x
WHERE len(list_filter({longer_sql('address', 1)}, lambda t: contains(lower(both_text), t))) >= 2 AND len(list_filter({longer_sql('prim', 2)}, lambda t: contains(lower(both_text), t))) >= 1 GROUP BY ALL""")
def project_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Results that name both the project's address and its party."""
    return I.projects(searched(spark, sf)).select(*COLUMNS)


EXISTING = "have AS (SELECT app FROM web WHERE field IN ('email', 'phone', 'website') GROUP BY 1 HAVING count(*) >= 3)"


@query(f"WITH {BASE}, {WEB}, {EXISTING}, y AS (SELECT * FROM x WHERE app NOT IN (SELECT app FROM have)) {contact_sql('y', 0.5, 0.45)}")
def contact_source(spark: SparkSession, sf: str) -> DataFrame:
    """The contact source: only leads with fewer than three contact rows from the web source are searched."""
    s = searched(spark, sf)
    return I.contacts(s, I.web(s))[0].select(*COLUMNS)


@query(f"""WITH {BASE}, {WEB}, {EXISTING}, y AS (SELECT * FROM x WHERE app NOT IN (SELECT app FROM have)), found AS ({contact_sql('y', 0.5, 0.45)})
SELECT DISTINCT app, CASE WHEN app IN (SELECT app FROM have) OR app IN (SELECT app FROM found) THEN 'ENRICHED' ELSE 'NOT_FOUND' END AS status FROM x""")
def contact_source_status(spark: SparkSession, sf: str) -> DataFrame:
    """Leads with enough contacts are ENRICHED without a search."""
    s = searched(spark, sf)
    return I.contacts(s, I.web(s))[1]


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as fetched pages of their application's lead; the first line is the title, staff reports stand for PDFs."""
    d = load(spark, sf, "documents").where("text is not null").select(T.record_key(F.col("application_number")).alias("app"), "doc_id", F.coalesce("url", F.concat(F.lit("https://none.example/"), F.col("doc_id").cast("string"))).alias("url"), "text", F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60)).alias("title"), F.coalesce(F.col("record_type") == "staff_report", F.lit(False)).alias("is_pdf"))
    return d.where("app is not null").join(leads(spark, sf).drop("source_url"), "app")


def relevance_sql(text: str, name: str = "applicant_name", firm: str = "owner_entity", vetted: int = 0) -> str:
    tokens = lambda c, p: f"list_transform(regexp_extract_all(coalesce({c}, ''), '{p}'), lambda t: lower(t))"
    hits = lambda c, p: f"len(list_filter({tokens(c, p)}, lambda t: contains(lower({text}), t)))"
    n = lambda c, p: f"len({tokens(c, p)})"
    w, a, f = "[A-Za-z]{2,}", "[A-Za-z0-9]{2,}", "[A-Za-z]{3,}"
    return f"""CASE WHEN {hits(name, w)} = 0 THEN 0.0 ELSE least(CASE WHEN {hits(name, w)} = {n(name, w)} THEN 50 ELSE 15 END + CASE WHEN {n('address', a)} > 0 AND {hits('address', a)} * 10 >= {n('address', a)} * 6 THEN 30 ELSE 0 END
  + CASE WHEN contains(lower({text}), lower(nullif(trim(neighborhood), ''))) THEN 15 ELSE 0 END + CASE WHEN {n(firm, f)} > 0 AND {hits(firm, f)} = {n(firm, f)} THEN 35 ELSE 0 END + {vetted}, 100) / 100 END"""


PAGES = f"""pages AS (SELECT leads.*, doc_id, coalesce(url, 'https://none.example/' || doc_id) AS url, text, left(split_part(text, chr(10), 1), 60) AS title, coalesce(record_type = 'staff_report', false) AS is_pdf
  FROM documents d JOIN leads ON leads.app = upper(trim(d.application_number)) WHERE text IS NOT NULL)"""


@query(f"WITH {BASE}, {PAGES} SELECT doc_id, CAST({relevance_sql('text')} AS DOUBLE) AS relevance, {relevance_sql('text')} >= 0.5 AS accepted FROM pages")
def page_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """How far every page concerns its lead, by several signals of which the name is a must."""
    r = C.relevance(F.col("text"), F.col("applicant_name"), F.col("address"), F.col("neighborhood"), F.col("owner_entity"))
    return pages(spark, sf).select("doc_id", r.alias("relevance"), (r >= C.ACCEPTED).alias("accepted"))


@query(f"""WITH {BASE}, {PAGES}, p AS (SELECT *, {HOST.format('url')} AS host FROM pages WHERE NOT is_pdf OR {relevance_sql('text')} >= 0.5),
e AS (SELECT DISTINCT app, url, host, applicant_name, lower(unnest(regexp_extract_all(text, '{K.EMAIL}'))) AS value FROM p),
m AS (SELECT app, 'email' AS field, value, url AS source_url, CAST(greatest(least(70 - CASE WHEN split_part(value, '@', 1) IN {K.ROLE_MAILBOXES} THEN 15 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_extract_all(coalesce(applicant_name, ''), '[A-Za-z]{{3,}}'), lambda t: contains(split_part(value, '@', 1), lower(t)))) > 0 THEN 8 ELSE 0 END, 99), 0) / 100 AS DOUBLE) AS confidence_score
  FROM e WHERE split_part(value, '@', 2) NOT IN {K.PLACEHOLDER_DOMAINS} AND NOT {GOVERNMENT}),
f AS (SELECT DISTINCT app, 'phone' AS field, right(regexp_replace(unnest(regexp_extract_all(text, '{K.PHONE}')), '[^0-9]', '', 'g'), 10) AS value, url AS source_url, CAST(0.75 AS DOUBLE) AS confidence_score FROM p),
t AS (SELECT app, 'page_title' AS field, min(title) AS value, url AS source_url, CAST(0.35 AS DOUBLE) AS confidence_score FROM pages WHERE NOT is_pdf AND title <> '' GROUP BY app, url, lower(title))
SELECT * FROM m UNION SELECT * FROM f UNION ALL SELECT * FROM t""")
def page_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What pages give; PDFs only where they concern the lead."""
    return I.page_evidence(pages(spark, sf), "public_web").select(*COLUMNS)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


FORWARD, BACKWARD = quoted(C.NAME_THEN_ROLE), quoted(C.ROLE_THEN_NAME)
ROLE_CASE = "CASE lower(z[2]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ROLES.items()) + " END"


def profile_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Enrichment rows as pages about their company, or about the applicant where none is stated, that name the applicant with a role."""
    e = load(spark, sf, "applicant_enrichment")
    none = F.lit(None).cast("string")
    return e.select(
        F.col("enrichment_id").cast("string").alias("app"), F.concat(F.lit("https://profiles.example/"), F.col("enrichment_id").cast("string")).alias("url"), F.coalesce("company_name", "applicant_name").alias("lead"), F.col("company_name").alias("owner_entity"),
        none.alias("address"), none.alias("neighborhood"), F.concat_ws(". ", "company_name", F.concat("applicant_name", F.lit(", "), "contact_role")).alias("text"),
    ).withColumnRenamed("lead", "applicant_name")


PROFILES = """pages AS (SELECT CAST(enrichment_id AS VARCHAR) AS app, 'https://profiles.example/' || enrichment_id AS url, coalesce(company_name, e.applicant_name) AS applicant_name, company_name AS owner_entity,
  CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS neighborhood, concat_ws('. ', company_name, e.applicant_name || ', ' || contact_role) AS text FROM applicant_enrichment e)"""


@query(rf"""WITH {PROFILES}, m AS (SELECT *, unnest(list_concat(list_zip(regexp_extract_all(text, {FORWARD}, 1), regexp_extract_all(text, {FORWARD}, 2)), list_zip(regexp_extract_all(text, {BACKWARD}, 2), regexp_extract_all(text, {BACKWARD}, 1)))) AS z FROM pages),
n AS (SELECT *, trim(regexp_replace(z[1], '[\s\x00]+', ' ', 'g')) AS name, {ROLE_CASE} AS role FROM m),
t AS (SELECT *, list_transform(regexp_extract_all(coalesce(applicant_name, ''), '[A-Za-z]{{2,}}'), lambda x: lower(x)) AS a, list_transform(regexp_extract_all(name, '[A-Za-z]+'), lambda x: lower(x)) AS b, {relevance_sql('text')} >= 0.5 AS fits FROM n
  WHERE role IS NOT NULL AND NOT regexp_matches(name, '(?i)(?:llc|l\.l\.c|inc|corp|corporation|company|lp|ltd|trust)|[a-z] & [A-Z]|(?:builders|holdings|homes|partners|properties|realty)$')),
s AS (SELECT *, len(a) > 0 AND (len(list_intersect(a, b)) = len(list_distinct(a)) OR (len(b) > 0 AND len(list_intersect(a, b)) = len(list_distinct(b)))) AS same FROM t)
SELECT DISTINCT app, url, name, role, same AS same_person FROM s WHERE same OR (fits AND NOT coalesce(lower(name) = lower(trim(owner_entity)), false))""")
def role_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The persons with roles that pages name: the applicant's own role, or others on pages that concern the lead."""
    return I.role_candidates(profile_pages(spark, sf)).select("app", "url", "name", "role", "same_person")


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, upper(trim(application_number)) AS app, regexp_replace(lower(trim(value)), '^mailto:', '') AS value, {HOST.format('source_url')} AS host, source_type FROM contact_candidate WHERE contact_type = 'email' AND trim(application_number) <> ''),
l AS (SELECT upper(trim(application_number)) AS app, arg_min({{'a': applicant_name}}, lead_id).a AS name FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1),
v AS (SELECT *, regexp_matches(value, '^{K.EMAIL}$') AND split_part(value, '@', 2) NOT IN {K.PLACEHOLDER_DOMAINS} AS valid FROM c LEFT JOIN l USING (app)),
s AS (SELECT candidate_id, value, CASE WHEN coalesce(valid, false) THEN least(1000, 400 + CASE source_type WHEN 'government_record' THEN 300 ELSE 0 END + CASE WHEN split_part(value, '@', 2) IN {K.FREE_DOMAINS} THEN 0 ELSE 100 END
  - CASE WHEN split_part(value, '@', 1) IN {K.GENERIC_MAILBOXES} THEN 100 ELSE 0 END + CASE WHEN len(list_filter(regexp_extract_all(coalesce(name, ''), '[A-Za-z]{{2,}}'), lambda t: contains(split_part(value, '@', 1), lower(t)))) > 0 THEN 100 ELSE 0 END
  + CASE WHEN host = split_part(value, '@', 2) THEN 50 ELSE 0 END) / 1000 ELSE 0.0 END AS score FROM v)
SELECT candidate_id, CAST(max(score) AS DOUBLE) AS score, CASE WHEN max(score) >= 0.8 THEN 'HIGH' WHEN max(score) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM s GROUP BY 1""")
def email_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How sure every e-mail candidate is its applicant's."""
    c = load(spark, sf, "contact_candidate").where("contact_type = 'email'").select("candidate_id", T.record_key(F.col("application_number")).alias("app"), F.lower(F.trim("value")).alias("value"), T.host(F.col("source_url")).alias("host"), "source_type").where("app is not null")
    one = c.join(leads(spark, sf).select("app", "applicant_name"), "app", "left")
    scored = one.groupBy("candidate_id").agg(F.max(C.email_score(F.col("value"), F.col("applicant_name"), F.col("host"), F.col("source_type"))).alias("score"))
    return scored.select("candidate_id", "score", C.label(F.col("score")).alias("label"))


IDENTITY = f"""m AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, lower(coalesce(evidence_text, '')) AS text, coalesce(source_domain, '') AS domain, source_url FROM investigation_evidence WHERE field IN ('email', 'phone') AND trim(entity_identifier) <> ''),
scored AS (SELECT evidence_id, app, source_url, CASE WHEN len(list_filter({longer_sql('trim(owner_name)', 2)}, lambda t: contains(text, t))) >= 1 THEN 25 ELSE 0 END
  + CASE WHEN domain <> '' AND len(list_filter({longer_sql('trim(owner_entity)', 2)}, lambda t: contains(lower(domain), t))) >= 1 THEN 30 ELSE 0 END
  + CASE WHEN len(list_filter({longer_sql('trim(address)', 3)}, lambda t: contains(text, t))) >= 2 THEN 20 ELSE 0 END + CASE WHEN contains(domain, '.gov') THEN 15 ELSE 0 END
  + CASE WHEN domain IN {K.DIRECTORY_HOSTS} THEN 10 ELSE 0 END + CASE WHEN contains(domain, 'site6') THEN 15 ELSE 0 END AS points FROM m JOIN leads USING (app))"""


def scored_identities(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "investigation_evidence").select("evidence_id", "field", T.record_key(F.col("entity_identifier")).alias("app"), "evidence_text", "source_domain", "source_url").where("app is not null").dropDuplicates(["evidence_id"])
    return I.identity_scores(e.join(leads(spark, sf).drop("source_url"), "app"), network="site6")


@query(f"WITH {BASE}, {IDENTITY} SELECT evidence_id, CAST(least(points, 100) / 100 AS DOUBLE) AS match_score, CASE WHEN points >= 80 THEN 'HIGH' WHEN points >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM scored")
def identity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How sure every e-mail and phone evidence is about the lead's owner; the hosts named site6 and on stand for a network."""
    return scored_identities(spark, sf).select("evidence_id", "match_score", "label")


@query(f"""WITH {BASE}, {IDENTITY}, d AS (SELECT app, points, source_url, min(evidence_id) AS evidence_id FROM scored GROUP BY 1, 2, 3)
SELECT app, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY points DESC, evidence_id) AS n FROM d) WHERE n <= 20""")
def identity_matches_top20(spark: SparkSession, sf: str) -> DataFrame:
    """Per lead the twenty surest matches, equal score and page counted once."""
    one = scored_identities(spark, sf).groupBy("app", "match_score", "source_url").agg(F.min("evidence_id").alias("evidence_id"))
    return R.top_per(one, ["app"], 20, F.col("match_score").desc(), F.col("evidence_id")).select("app", "evidence_id")


QUERY_PARTS = "nullif(trim(regexp_replace(applicant_name, '[\\s\\x00]+', ' ', 'g')), '') AS n, nullif(trim(regexp_replace(project_address, '[\\s\\x00]+', ' ', 'g')), '') AS a, nullif(concat_ws(' ', nullif(trim(municipality), ''), nullif(trim(state), '')), '') AS p"


@query(f"""WITH s AS (SELECT lead_id, applicant_email AS e, {QUERY_PARTS} FROM opportunity),
v AS (SELECT *, CASE WHEN regexp_matches(lower(trim(e)), '^{K.EMAIL}$') AND split_part(lower(trim(e)), '@', 2) NOT IN {K.PLACEHOLDER_DOMAINS} THEN lower(trim(e)) END AS email FROM s)
SELECT lead_id, CASE WHEN n IS NULL THEN 'missing_applicant_name' ELSE 'identity_only' END AS identity_status, CASE WHEN n IS NULL THEN 'LOW' WHEN email IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS identity_confidence,
  CASE WHEN n IS NOT NULL THEN split_part(email, '@', 2) END AS email_domain,
  CASE WHEN n IS NULL THEN '' ELSE concat_ws(' | ', '"' || n || '" "' || a || '"', '"' || n || '" "' || p || '"', '"' || n || '" contact email', '"' || n || '" "' || a || '" email', '"' || n || '" LinkedIn') END AS queries FROM v""")
def applicant_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Every lead's identity of record, and the queries that would look for it."""
    o = load(spark, sf, "opportunity").select("lead_id", "applicant_name", "applicant_email", F.col("project_address").alias("address"), "municipality", "state")
    return I.identity(o).select("lead_id", "identity_status", "identity_confidence", "email_domain", F.array_join("search_queries", " | ").alias("queries"))


@query(f"""WITH {BASE}, {WEB}, s AS (SELECT DISTINCT app FROM x), st AS (SELECT app, 'web' AS source, CASE WHEN app IN (SELECT app FROM web) THEN 'ENRICHED' ELSE 'NOT_FOUND' END AS status FROM s),
w AS (SELECT app, count(*) AS n FROM web GROUP BY 1), done AS (SELECT app FROM s WHERE app LIKE '%0')
SELECT app, CASE WHEN app IN (SELECT app FROM done) OR app IN (SELECT app FROM web) THEN 'ENRICHED' ELSE 'NOT_FOUND' END AS web,
  CAST(CASE WHEN app IN (SELECT app FROM done) THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS rows FROM s LEFT JOIN w USING (app)""")
def resumed_source(spark: SparkSession, sf: str) -> DataFrame:
    """A resumed run of the web source: leads it has enriched before (whose number ends in 0) are skipped and stay enriched."""
    s = searched(spark, sf)
    apps = s.select("app").distinct()
    done = apps.where(F.col("app").endswith("0")).select("app", F.lit("web").alias("source"), F.lit("ENRICHED").alias("status"))
    found, states = I.run_sources(apps, done, {"web": lambda todo, _: I.web(s.join(todo, "app", "left_semi"))})
    n = found.groupBy("app").agg(F.count("*").alias("rows"))
    return states.select("app", F.col("status").alias("web")).join(n, "app", "left").select("app", "web", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(f"""WITH {BASE}, {WEB}, dirs AS (SELECT DISTINCT app FROM x WHERE regexp_matches(host, '^dir[0-9]+[.]example$') AND prim IS NOT NULL), prof AS (SELECT DISTINCT app FROM x WHERE contains(host, 'site1')),
p AS (SELECT DISTINCT app FROM x WHERE host IS NOT NULL AND regexp_matches(lower(prim), '{"|".join(K.COMPANY_WORDS)}') AND regexp_matches(lower(both_text), '{"|".join(K.RECORD_WORDS)}')),
n AS (SELECT app, CAST(app IN (SELECT app FROM web) AS INT) + CAST(app IN (SELECT app FROM dirs) AS INT) + CAST(app IN (SELECT app FROM prof) AS INT) + CAST(app IN (SELECT app FROM p) AS INT) AS k FROM (SELECT DISTINCT app FROM x))
SELECT app, CASE WHEN k >= 3 THEN 'ENRICHED' WHEN k >= 1 THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS status FROM n""")
def investigation_status(spark: SparkSession, sf: str) -> DataFrame:
    """The overall status of every lead after several sources ran in their order."""
    s = searched(spark, sf)
    own = lambda f: lambda todo, _: f(s.join(todo, "app", "left_semi"))
    sources = {"web": own(I.web), "directories": own(lambda r: I.directories(r, lambda h: C.false_if_null(h.rlike(r"^dir[0-9]+\.example$"))).where("field = 'business_listing'")), "linkedin": own(lambda r: I.profiles(r, "site1")), "public_records": own(I.public_records)}
    apps = s.select("app").distinct()
    none = apps.limit(0).select("app", F.lit("").alias("source"), F.lit("").alias("status"))
    return I.overall_status(I.run_sources(apps, none, sources)[1])
