"""Queries over texts: positions, windows, sections, dates, contacts and the evidence they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import evidence as E
from quarry.plans.adapters import evidence
from quarry.plans.registry import query
from quarry.session import load
from quarry.sources import listing, packets

WS = r"'[ \t\n\r\f\v]+'"


@query("SELECT c_custkey, regexp_replace(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g'), '-')), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS match_key, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS collapsed FROM customer")
def slug_and_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A name's slug, its key for comparing, and the name without surplus blanks."""
    return load(spark, sf, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.match_key(F.col("c_name")).alias("match_key"), T.collapse(F.col("c_name")).alias("collapsed"))


@query("""SELECT lead_id, coalesce(nullif(trim(applicant_entity), ''), nullif(trim(applicant_name), ''), nullif(trim(owner_name), ''), 'unnamed') AS party,
  try_cast(regexp_extract(acreage, '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS acres, coalesce(lower(trim(owner_type)) IN ('entity', 'trust'), false) AS is_entity FROM opportunity""")
def alias_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """The first stated alias of a party, a tolerant number and a tolerant flag."""
    o, c = load(spark, sf, "opportunity"), F.col
    party = F.coalesce(T.first_stated(c("applicant_entity"), c("applicant_name"), c("owner_name")), F.lit("unnamed"))
    acres = F.regexp_extract("acreage", r"([0-9]+[.]?[0-9]*)", 1).try_cast("double")
    return o.select("lead_id", party.alias("party"), acres.alias("acres"), F.coalesce(F.lower(F.trim("owner_type")).isin("entity", "trust"), F.lit(False)).alias("is_entity"))


@query(f"""SELECT DISTINCT evidence_id, array_to_string(list_distinct_ordered, ',') AS emails FROM (SELECT evidence_id, list_transform(regexp_extract_all(evidence_text, '{K.EMAIL}'), lambda x: lower(x)) AS l,
  list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM investigation_evidence WHERE evidence_text IS NOT NULL) WHERE len(l) > 0""")
def contact_emails(spark: SparkSession, sf: str) -> DataFrame:
    """The e-mail addresses of every evidence text, distinct, in order."""
    e = evidence(spark, sf).select("evidence_id", T.emails(F.col("evidence_text")).alias("l"))
    return e.where(F.size("l") > 0).select("evidence_id", F.array_join("l", ",").alias("emails"))


@query(f"""SELECT DISTINCT evidence_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS phones FROM (SELECT evidence_id,
  list_transform(regexp_extract_all(evidence_text, '{K.PHONE}'), lambda x: right(regexp_replace(x, '[^0-9]', '', 'g'), 10)) AS l FROM investigation_evidence WHERE evidence_text IS NOT NULL) WHERE len(l) > 0""")
def contact_phones(spark: SparkSession, sf: str) -> DataFrame:
    """The phone numbers of every evidence text as ten digits."""
    e = evidence(spark, sf).select("evidence_id", T.phones(F.col("evidence_text")).alias("l"))
    return e.where(F.size("l") > 0).select("evidence_id", F.array_join("l", ",").alias("phones"))


@query(f"""WITH x AS (SELECT DISTINCT evidence_id, upper(trim(entity_identifier)) AS app, source_type, evidence_text FROM investigation_evidence WHERE evidence_text IS NOT NULL),
e AS (SELECT DISTINCT evidence_id, app, 'email' AS kind, lower(unnest(regexp_extract_all(evidence_text, '{K.EMAIL}'))) AS value, source_type FROM x),
p AS (SELECT DISTINCT evidence_id, app, 'phone' AS kind, right(regexp_replace(unnest(regexp_extract_all(evidence_text, '{K.PHONE}')), '[^0-9]', '', 'g'), 10) AS value, source_type FROM x),
b AS (SELECT *, CASE source_type WHEN 'government_record' THEN 0.85 WHEN 'public_web' THEN 0.55 ELSE 0.5 END AS base FROM (SELECT * FROM e UNION ALL SELECT * FROM p))
SELECT evidence_id, app, kind, value, CAST(round(CASE kind WHEN 'email' THEN base - CASE WHEN split_part(value, '@', 1) IN {K.GENERIC_MAILBOXES} THEN 0.15 ELSE 0 END ELSE least(base + 0.10, 0.95) END, 2) AS DOUBLE) AS confidence FROM b""")
def evidence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Contact candidates that evidence texts give, with a confidence by their source and kind."""
    return E.contact_candidates(evidence(spark, sf).select("evidence_id", "app", "source_type", F.col("evidence_text").alias("text"))).select("evidence_id", "app", "kind", "value", "confidence")


@query("""SELECT doc_id, h AS host, regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS root, coalesce(h LIKE '%.example' AND h LIKE 'web-crawl%', false) AS crawled FROM (SELECT doc_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[.]', ''), '') AS h FROM documents)""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", T.host(F.col("url")).alias("host"))
    return d.select("doc_id", "host", T.root_domain(F.col("host")).alias("root"), F.coalesce(F.col("host").like("%.example") & F.col("host").like("web-crawl%"), F.lit(False)).alias("crawled"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>"\)\]]+')) AS url FROM documents WHERE text IS NOT NULL)
SELECT url, max(doc_id) AS doc_id, count(*) AS times, CASE WHEN regexp_matches(lower(url), 'agenda') THEN 'agenda' WHEN regexp_matches(lower(url), 'packet|[.]pdf') THEN 'packet' ELSE 'other' END AS kind FROM l GROUP BY 1""")
def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link that a text names, classified, its last document kept."""
    return listing.links(load(spark, sf, "documents").select("doc_id", "text"))


@query("""WITH h AS (SELECT doc_id, text, unnest(regexp_extract_all(text, 'Condition [0-9]+')) AS hit, unnest(range(1, len(regexp_extract_all(text, 'Condition [0-9]+')) + 1)) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, string_split_regex(text, 'Condition [0-9]+') AS parts, regexp_extract_all(text, 'Condition [0-9]+') AS hits FROM documents WHERE text IS NOT NULL)
SELECT h.doc_id, h.hit, CAST(list_sum(list_transform(s.parts[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(s.hits[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
  substring(text, CAST(greatest(start - 30, 0) + 1 AS BIGINT), CAST(start + length(hit) + 40 - greatest(start - 30, 0) AS BIGINT)) AS around FROM h JOIN s USING (doc_id)""")
def pattern_hits_with_context(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of a pattern with their places and the text around each; windows are cut last."""
    hits = E.hits(load(spark, sf, "documents").select("doc_id", "text"), "text", r"Condition [0-9]+")
    return hits.select("doc_id", "hit", F.col("start").cast("bigint").alias("start"), T.window_around(F.col("text"), F.col("start"), F.length("hit"), 30, 40).alias("around"))


@query("""WITH s AS (SELECT doc_id, text, string_split_regex(text, '(^|\\n)[0-9]+[.] ') AS parts FROM documents WHERE starts_with(text, 'AGENDA')) SELECT doc_id, CAST(len(parts) - 1 AS BIGINT) AS items,
  regexp_extract(parts[2], 'PL[A-Z]{2,6}[0-9]{8}') AS first_number, length(parts[2]) AS first_length FROM s""")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Agendas cut at their item numbers: how many items, and what the first one holds."""
    d = load(spark, sf, "documents").where(F.col("text").startswith("AGENDA")).select("doc_id", F.split("text", r"(?:^|\n)[0-9]+[.] ").alias("parts"))
    return d.select("doc_id", (F.size("parts") - 1).cast("bigint").alias("items"), F.regexp_extract(F.get("parts", 1), K.APPLICATION_NUMBER, 0).alias("first_number"), F.length(F.get("parts", 1)).cast("bigint").alias("first_length"))


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE starts_with(text, 'AGENDA'))
SELECT doc_id, CAST(regexp_extract(line, '^([0-9]+)[.] ', 1) AS BIGINT) AS item, regexp_extract(line, 'PL[A-Z]{2,6}[0-9]{8}') AS number, trim(regexp_extract(line, ' - (.*)$', 1)) AS subject FROM x WHERE regexp_matches(line, '^[0-9]+[.] ')""")
def agenda_items(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered items of agendas with their application number and subject."""
    return E.agenda_items(load(spark, sf, "documents").select("doc_id", "text"))


@query(r"""SELECT doc_id, trim(regexp_extract(text, '(?i)(?:^|\n)[ \t]*Variance[ \t]*:[ \t]*([^\n]*)', 1)) AS fee FROM documents WHERE regexp_matches(text, '(?:^|\n)[ \t]*Variance[ \t]*:')""")
def labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    """The value behind a label on a line of its own."""
    return load(spark, sf, "documents").select("doc_id", T.labelled(F.col("text"), "Variance").alias("fee")).where("fee is not null")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_extract(text, '([^.!?;\n]*(?:\n[^.!?;\n]+)*petition with [0-9]+ signatures[^.!?;\n]*(?:\n[^.!?;\n]+)*[.!?;]?)', 1), '\s+', ' ', 'g')) AS sentence FROM documents WHERE regexp_matches(text, 'petition with [0-9]+ signatures')""")
def sentence_context(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence around the first hit of a pattern."""
    d = load(spark, sf, "documents").select("doc_id", "text", (F.regexp_instr("text", F.lit("petition with [0-9]+ signatures")) - 1).alias("at")).where("at >= 0")
    return d.select("doc_id", T.sentence_at(F.col("text"), F.col("at")).alias("sentence"))


@query("""SELECT DISTINCT evidence_id, CAST(coalesce(CASE WHEN regexp_matches(discovered_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(left(discovered_at, 10) AS DATE) END, CAST(try_strptime(discovered_at, '%m/%d/%Y') AS DATE), CAST(try_strptime(discovered_at, '%B %d, %Y') AS DATE), CAST(try_strptime(discovered_at, '%b %d, %Y') AS DATE), CAST(try_strptime(discovered_at, '%d %b %Y') AS DATE)) AS VARCHAR) AS day FROM investigation_evidence""")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in several forms, read as days."""
    return evidence(spark, sf).select("evidence_id", D.parse_date(F.trim("discovered_at")).cast("string").alias("day"))


@query("""SELECT lead_id, CAST(date_diff('day', DATE '2026-01-01', next_project_date) AS BIGINT) AS days, coalesce(next_project_date > DATE '2026-01-01', false) AS future, CAST(CASE WHEN next_project_date >= DATE '2026-01-01' THEN next_project_date END AS VARCHAR) AS kept FROM opportunity""")
def days_until(spark: SparkSession, sf: str) -> DataFrame:
    """Days to an event, whether it lies ahead, and the date unless it has passed; the reference date is given."""
    d, ref = F.col("next_project_date"), F.lit("2026-01-01").cast("date")
    return load(spark, sf, "opportunity").select("lead_id", D.days_until(d, ref).alias("days"), D.is_future(d, ref).alias("future"), D.only_future(d, ref).cast("string").alias("kept"))


@query(rf"""WITH m AS (SELECT parsed_id, unnest(regexp_extract_all(text, '{D.MENTION}')) AS said FROM (SELECT DISTINCT parsed_id, text FROM parsed_document)) SELECT parsed_id, CAST(day AS VARCHAR) AS day, count(*) AS times
FROM (SELECT parsed_id, coalesce(try_cast(said AS DATE), CAST(try_strptime(said, '%m/%d/%Y') AS DATE), CAST(try_strptime(said, '%B %d, %Y') AS DATE)) AS day FROM m) WHERE day IS NOT NULL GROUP BY 1, 2""")
def date_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The dates that parsed documents mention, and how often."""
    d = load(spark, sf, "parsed_document").select("parsed_id", "text").distinct()
    said = d.select("parsed_id", F.explode(F.regexp_extract_all("text", F.lit(D.MENTION), F.lit(0))).alias("said"))
    return said.select("parsed_id", D.parse_date(F.col("said")).cast("string").alias("day")).where("day is not null").groupBy("parsed_id", "day").agg(F.count("*").alias("times"))


@query("""WITH o AS (SELECT lead_id, upper(trim(application_number)) AS app, nullif(trim(regexp_replace(lower(applicant_name), '[^a-z0-9]+', ' ', 'g')), '') AS n, nullif(trim(regexp_replace(lower(project_address), '[^a-z0-9]+', ' ', 'g')), '') AS a FROM opportunity WHERE trim(application_number) <> ''),
d AS (SELECT evidence_id, upper(trim(entity_identifier)) AS app, trim(regexp_replace(lower(any_value(evidence_text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM investigation_evidence WHERE evidence_text IS NOT NULL AND trim(entity_identifier) <> '' GROUP BY 1, 2)
SELECT o.lead_id, d.evidence_id FROM o JOIN d USING (app) WHERE contains(d.t, o.n) OR contains(d.t, o.a)""")
def context_join(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of an application whose text names the whole applicant or the address, for every lead."""
    key = lambda c: F.nullif(T.match_key(F.col(c)), F.lit(""))
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"), key("applicant_name").alias("name"), key("project_address").alias("address"))
    d = evidence(spark, sf).where("evidence_text is not null").select("evidence_id", "app", T.match_key(F.col("evidence_text")).alias("text"))
    return o.join(d, "app").where(F.contains("text", "name") | F.contains("text", "address")).select("lead_id", "evidence_id")


@query("""WITH o AS (SELECT lead_id, upper(trim(application_number)) AS app, list_filter(list_distinct(string_split(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2) AS w FROM opportunity WHERE trim(application_number) <> '' AND description IS NOT NULL),
d AS (SELECT doc_id, upper(trim(application_number)) AS app, list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2) AS w FROM documents WHERE trim(application_number) <> '' AND text IS NOT NULL)
SELECT o.lead_id, max(len(list_intersect(o.w, d.w)) / len(o.w)) AS relevance FROM o JOIN d USING (app) WHERE len(o.w) > 0 GROUP BY 1""")
def token_overlap_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a lead's description its application's documents repeat, at best."""
    o = load(spark, sf, "opportunity").select("lead_id", T.record_key(F.col("application_number")).alias("app"), T.words(F.col("description")).alias("part")).where("app is not null and size(part) > 0")
    d = load(spark, sf, "documents").select(T.record_key(F.col("application_number")).alias("app"), T.words(F.col("text")).alias("whole")).where("app is not null and whole is not null")
    return o.join(d, "app").groupBy("lead_id").agg(F.max(T.overlap(F.col("part"), F.col("whole"))).alias("relevance"))


@query("""SELECT parsed_id, length(t) AS rebuilt, t = text AS same FROM (SELECT parsed_id, text, (SELECT coalesce(string_agg(chr(10) || '--- PAGE ' || p.page || ' ---' || chr(10) || chr(10) || p.text, chr(10) ORDER BY p.page), '') FROM (SELECT unnest(pages) AS p)) AS t FROM (SELECT parsed_id, any_value(text) AS text, any_value(pages) AS pages FROM parsed_document WHERE text IS NOT NULL AND len(pages) > 0 GROUP BY 1))""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of parsed files put together from their pages, and whether it is the stored one."""
    d = load(spark, sf, "parsed_document").where("text is not null and size(pages) > 0").dropDuplicates(["parsed_id"])
    return d.select("parsed_id", "text", packets.join_pages(F.col("pages")).alias("t")).select("parsed_id", F.length("t").cast("bigint").alias("rebuilt"), (F.col("t") == F.col("text")).alias("same"))


@query("""SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes, base64(encode(text)) AS payload FROM documents WHERE text IS NOT NULL""")
def blob_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Checksum, size in bytes and the whole payload encoded in one line."""
    return load(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"), F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("payload"))


@query("""SELECT lead_id, coalesce(regexp_matches(trim(applicant_name), '^[A-Z]([a-z''’-]+|[.])( +[A-Z]([a-z''’-]+|[.])){1,3}$'), false) AS person, coalesce(regexp_matches(applicant_name, '(?i)\\b(?:llc|l\\.l\\.c|inc|corp|corporation|company|lp|ltd|trust)\\b|[a-z] & [A-Z]|\\b(?:builders|holdings|homes|partners|properties|realty)$'), false) AS company FROM opportunity""")
def name_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name is shaped like a person's or a company's."""
    n = F.col("applicant_name")
    return load(spark, sf, "opportunity").select("lead_id", T.is_person_shaped(n).alias("person"), T.is_company_shaped(n).alias("company"))


@query("""SELECT lead_id, concat_ws('; ', CASE WHEN friction_score >= 40 THEN 'high friction ' || friction_score END, CASE WHEN len(friction_signals) > 0 THEN 'signals: ' || array_to_string(list_sort(friction_signals), ', ') END, CASE WHEN next_project_date IS NOT NULL THEN 'next date ' || CAST(next_project_date AS VARCHAR) END) AS reason FROM opportunity""")
def reason_text(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence of the pieces that a lead has; missing ones are left out."""
    c = F.col
    pieces = [F.when(c("friction_score") >= 40, F.concat(F.lit("high friction "), c("friction_score").cast("string"))), F.when(F.size("friction_signals") > 0, F.concat(F.lit("signals: "), F.array_join(F.array_sort("friction_signals"), ", "))), F.concat(F.lit("next date "), c("next_project_date").cast("string"))]
    return load(spark, sf, "opportunity").select("lead_id", F.concat_ws("; ", *pieces).alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1000000 THEN '$' || format('{:,.1f}', o_totalprice / 1000000) || 'M' WHEN o_totalprice >= 1000 THEN '$' || format('{:,.0f}', round_even(o_totalprice / 1000, 0)) || 'K' ELSE '$' || format('{:,.0f}', round_even(o_totalprice, 0)) END AS shown FROM orders""")
def display_money(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", T.money(F.col("o_totalprice")).alias("shown"))


@query("""SELECT event_id, json_valid(props) AS valid, (SELECT count(*) FROM (SELECT unnest(json_keys(props)))) AS keys FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Properties read tolerantly: whether they parse, and how many there are."""
    return load(spark, sf, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.size(F.json_object_keys("props")).cast("bigint").alias("keys"))


@query(f"""SELECT DISTINCT evidence_id, l[-1] AS last_email, l[1] AS first_email, CAST(len(l) AS BIGINT) AS written FROM (SELECT evidence_id, list_transform(regexp_extract_all(evidence_text, '{K.EMAIL}'), lambda x: lower(x)) AS l FROM investigation_evidence WHERE evidence_text IS NOT NULL) WHERE len(l) > 0""")
def first_and_last_contact(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last address that a text writes: who is named first, and whom it closes with."""
    e = evidence(spark, sf).select("evidence_id", F.transform(T.all_matches(F.col("evidence_text"), K.EMAIL), F.lower).alias("l")).where(F.size("l") > 0)
    return e.select("evidence_id", F.element_at("l", -1).alias("last_email"), F.get("l", 0).alias("first_email"), F.size("l").cast("bigint").alias("written"))


@query(r"""SELECT DISTINCT evidence_id, regexp_extract(h, '^([0-9]{1,2})', 1) || ':' || coalesce(nullif(regexp_extract(h, ':([0-9]{2})', 1), ''), '00') || ' ' || CASE WHEN regexp_matches(lower(h), 'p[.]?m$') THEN 'PM' ELSE 'AM' END AS at
FROM (SELECT evidence_id, regexp_extract(evidence_text, '(?i)\b([0-9]{1,2}(?::[0-9]{2})?) ?([ap])[.]?m\b', 0) AS h FROM investigation_evidence) WHERE h <> ''""")
def times_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """The first time of day of every evidence text, in one form."""
    return evidence(spark, sf).select("evidence_id", D.clock(F.col("evidence_text")).alias("at")).where("at is not null")


@query("""SELECT lead_id, CAST(len(list_filter(friction_signals, lambda s: s IN ('denied', 'withdrawn', 'recommended_denial'))) AS BIGINT) AS severe, CAST(len(list_filter(friction_signals, lambda s: s NOT IN ('denied', 'withdrawn', 'recommended_denial'))) AS BIGINT) AS mild,
  array_to_string(list_transform(list_sort(list_transform(list_filter(friction_signals, lambda s: s IS NOT NULL), lambda s: printf('%02d', coalesce(list_position(['denied','withdrawn','recommended_denial','tabled','continued','staff_concern','additional_information','amended','appeal','neighborhood_concern','public_opposition'], s), 99)) || s)), lambda s: s[3:]), ',') AS ordered
FROM opportunity WHERE friction_signals IS NOT NULL""")
def signals_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """A lead's signals counted by severity and put in the order of dominance, inside the array."""
    severe, order = F.array(*[F.lit(x) for x in ("denied", "withdrawn", "recommended_denial")]), F.array(*[F.lit(x) for x in K.SIGNALS])
    rank = lambda s: F.coalesce(F.nullif(F.array_position(order, s), F.lit(0)), F.lit(99))
    s = F.filter("friction_signals", lambda x: x.isNotNull())
    ranked = F.transform(F.array_sort(F.transform(s, lambda x: F.struct(rank(x).alias("r"), x.alias("s")))), lambda x: x["s"])
    count = lambda keep: F.size(F.filter(s, keep)).cast("bigint")
    leads = load(spark, sf, "opportunity").where("friction_signals is not null")
    return leads.select("lead_id", count(lambda x: F.array_contains(severe, x)).alias("severe"), count(lambda x: ~F.array_contains(severe, x)).alias("mild"), F.array_join(ranked, ",").alias("ordered"))


@query(r"""WITH b AS (SELECT parsed_id, any_value(text) AS t FROM parsed_document WHERE text IS NOT NULL GROUP BY 1),
l AS (SELECT parsed_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM b)
SELECT parsed_id, CAST(n AS BIGINT) AS line_no, line FROM l WHERE regexp_matches(line, '^(STAFF ANALYSIS|FINDINGS OF FACT|BACKGROUND|RECOMMENDATION|Public Comment|[IVX]+[.] .*|[0-9]+[.] [A-Z].*)$')""")
def section_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The section headings of parsed files and their lines: the bounds of every section."""
    d = load(spark, sf, "parsed_document").where("text is not null").select("parsed_id", "text").dropDuplicates(["parsed_id"])
    lines = d.select("parsed_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(r"^(STAFF ANALYSIS|FINDINGS OF FACT|BACKGROUND|RECOMMENDATION|Public Comment|[IVX]+[.] .*|[0-9]+[.] [A-Z].*)$"))
    return lines.select("parsed_id", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")
