"""Queries over sources: searches, fetches, directories, lists of records, display texts and stored rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import text as T
from quarry.plans.investigation_queries import BASE, HOST, leads, results
from quarry.plans.registry import query
from quarry.session import load
from quarry.sources import search, store


def canned(q: str) -> list[dict]:
    """A client for searches that answers from the query alone."""
    return [{"link": f"https://r{i}.example/{len(q)}", "title": q.strip('"'), "snippet": f"result {i}"} for i in range(len(q) % 10)]


@query("""WITH q AS (SELECT DISTINCT '"' || n_name || '" contact' AS query FROM nation), r AS (SELECT query, unnest(range(least(length(query) % 10, 8))) AS i FROM q)
SELECT query, CAST(i AS INT) AS ordinal, 'https://r' || i || '.example/' || length(query) AS link FROM r""")
def search_source(spark: SparkSession, sf: str) -> DataFrame:
    """A search as a data source: at most eight results of each query, in their order."""
    search.register(spark)
    names = [r["n_name"] for r in load(spark, sf, "nation").select("n_name").distinct().orderBy("n_name").collect()]  # 25 at every size
    queries = "\n".join(f'"{n}" contact' for n in names)
    return spark.read.format("search").option("client", "quarry.plans.source_queries:canned").option("queries", queries).load().select("query", "ordinal", "link")


@query(rf"""WITH w AS (SELECT upper(trim(entity_identifier)) AS key, min(evidence_id) AS ordinal, lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_replace(source_url[length(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1:], '#.*$', ''), '/+$', '') AS url
  FROM investigation_evidence WHERE source_url IS NOT NULL AND trim(entity_identifier) <> '' GROUP BY 1, 3), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal, url) AS n FROM w),
p AS (SELECT DISTINCT lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_replace(source_url[length(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1:], '#.*$', ''), '/+$', '') AS url, length(source_url) % 7 AS m FROM investigation_evidence WHERE source_url IS NOT NULL)
SELECT key, url, bool_or(m = 2) AS is_pdf FROM t JOIN p USING (url) WHERE n <= 6 AND m NOT IN (0, 1) GROUP BY 1, 2""")
def fetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first six addresses of every application as fetched: failed answers and other kinds of content fall away, PDFs are marked."""
    e = load(spark, sf, "investigation_evidence").where("source_url is not null")
    n = F.length("source_url") % 7
    pages = e.select(F.col("source_url").alias("url"), F.when(n == 0, 404).otherwise(200).alias("status"), F.when(n == 1, "image/png").when(n == 2, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit("").alias("body")).distinct()
    wanted = e.select(T.record_key(F.col("entity_identifier")).alias("key"), F.col("evidence_id").alias("ordinal"), F.col("source_url").alias("url")).where("key is not null")
    return search.fetched(wanted, pages).groupBy("key", "url").agg(F.max("is_pdf").alias("is_pdf"))


@query(f"""WITH {BASE} SELECT app, unnest({list(K.DIRECTORY_HOSTS)}) AS host, '"' || prim || '"' AS name FROM leads WHERE prim IS NOT NULL""")
def directory_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The queries that ask every directory about each lead."""
    q = search.directory_queries(leads(spark, sf).select("app", F.col("primary").alias("name")))
    return q.select("app", "host", F.regexp_extract("query", '^(".*") site:', 1).alias("name"))


@query(rf"""WITH {BASE}, town AS (SELECT upper(trim(application_number)) AS app, arg_min({{'m': municipality}}, lead_id).m AS name FROM opportunity WHERE trim(application_number) <> '' GROUP BY 1), y AS (SELECT app, town.name, link, coalesce(title, '') || ' ' || coalesce(snippet, '') AS said, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS dir FROM x JOIN town USING (app) WHERE host IS NOT NULL),
t AS (SELECT *, list_transform(regexp_extract_all(coalesce(name, ''), '[A-Za-z]{{2,}}'), lambda w: lower(w)) AS ws FROM y), o AS (SELECT app, dir AS host, link, row_number() OVER (PARTITION BY app, dir ORDER BY link) AS n FROM (SELECT DISTINCT app, dir, link FROM t WHERE len(ws) > 0 AND len(list_filter(ws, lambda w: contains(lower(said), w))) = len(ws)))
SELECT app, host, link FROM o WHERE n <= 3""")
def directory_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Per application and site the first three results that name its town in full; towns stand for leads here, whose names no result holds."""
    s = results(spark, sf).join(leads(spark, sf).select("app", F.col("municipality").alias("name")), "app")
    r = s.select("app", "name", "link", "title", "snippet", T.root_domain(T.host(F.col("link"))).alias("host")).where("host <> ''").dropDuplicates(["app", "host", "link", "title", "snippet"])
    words = C.name_tokens(F.col("name"))
    full = r.where(C.any_within(words, F.lower(F.concat_ws(" ", "title", "snippet"))) == F.size(words)).dropDuplicates(["app", "host", "link"])
    return search.listed(full.withColumn("ordinal", F.lit(0))).select("app", "host", "link")


@query("""WITH u AS (SELECT source_url AS url, 0 AS n, lead_id AS o, 'leads' AS source FROM opportunity UNION ALL SELECT source_url, 1, pud_id, 'agency' FROM pud871_opportunity UNION ALL SELECT source_url, 2, match_id, 'findings' FROM identity_match UNION ALL SELECT url, 3, doc_id, 'feed' FROM documents)
SELECT url, first(source ORDER BY n DESC, o DESC) AS source, count(*) AS times FROM u WHERE url IS NOT NULL GROUP BY 1""")
def all_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of several lists and a feed in one, the last of each address kept."""
    part = lambda t, u, k, s: load(spark, sf, t).select(F.lit(s).alias("source"), F.lit(None).cast("string").alias("title"), F.col(u).alias("url"), F.lit(None).cast("date").alias("day"), F.col(k).alias("ordinal"))
    lists = [part("opportunity", "source_url", "lead_id", "leads"), part("pud871_opportunity", "source_url", "pud_id", "agency"), part("identity_match", "source_url", "match_id", "findings")]
    return search.all_sources(lists, [part("documents", "url", "doc_id", "feed")]).select("url", "source", "times")


@query(f"""SELECT DISTINCT candidate_id, regexp_matches(v, '^{K.EMAIL}$') AND split_part(v, '@', 2) NOT IN {K.PLACEHOLDER_DOMAINS} AS valid, split_part(v, '@', 2) IN {K.FREE_DOMAINS} AS free, split_part(v, '@', 1) IN {K.GENERIC_MAILBOXES} AS generic,
  nullif(split_part(v, '@', 2), '') AS domain FROM (SELECT candidate_id, regexp_replace(lower(trim(value)), '^mailto:', '') AS v FROM contact_candidate WHERE contact_type = 'email' AND trim(value) <> '')""")
def email_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of address every e-mail candidate is."""
    c = load(spark, sf, "contact_candidate").where("contact_type = 'email' and trim(value) <> ''").select("candidate_id", C.email_of(F.col("value")).alias("v")).distinct()
    v = F.col("v")
    return c.select("candidate_id", C.is_valid(v).alias("valid"), C.is_free(v).alias("free"), T.is_generic(v).alias("generic"), C.email_domain(v).alias("domain"))


@query("""SELECT o_orderkey, CASE WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Tomorrow' WHEN days < 0 THEN -days || 'd ago' ELSE 'In ' || days || 'd' END AS days, array_to_string(list_transform(list_filter(string_split_regex(o_orderpriority, '[_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title
FROM (SELECT o_orderkey, o_orderpriority, date_diff('day', DATE '1999-06-01', CAST(o_orderdate AS DATE)) AS days FROM orders)""")
def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Days until a date and a name in title case, as people read them."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1999-06-01").cast("date"))
    return load(spark, sf, "orders").select("o_orderkey", T.days_text(days).alias("days"), T.title_case(F.col("o_orderpriority")).alias("title"))


@query("""SELECT s_suppkey, CASE WHEN low = high THEN '$' || low || 'K' ELSE '$' || low || 'K – $' || CASE WHEN high >= 1000 THEN CASE WHEN high % 1000 = 0 THEN CAST(high // 1000 AS VARCHAR) ELSE format('{:.1f}', high / 1000) END || 'M' ELSE high || 'K' END END AS shown
FROM (SELECT s_suppkey, s_suppkey % 400 + 1 AS low, s_suppkey % 400 + 1 + s_suppkey % 3 * 500 AS high FROM supplier)""")
def display_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of amounts in abbreviated form."""
    low = (F.col("s_suppkey") % 400 + 1) * 1000
    return load(spark, sf, "supplier").select("s_suppkey", T.currency_range(low.cast("double"), (low + F.col("s_suppkey") % 3 * 500_000).cast("double")).alias("shown"))


@query("""SELECT lead_id, len(coalesce(friction_signals, [])) AS signals, len(coalesce(status, [])) AS states, upper(trim(application_number)) AS app FROM opportunity""")
def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Leads as rows to store: typed columns, empty arrays for null ones, and the whole record, read back from it."""
    rows = store.lead_rows(load(spark, sf, "opportunity"), ("friction_signals", "status"))
    back = F.from_json("record", "lead_id bigint, application_number string")
    return rows.select(back["lead_id"].alias("lead_id"), F.size("friction_signals").cast("bigint").alias("signals"), F.size("status").cast("bigint").alias("states"), F.upper(F.trim(back["application_number"])).alias("app"))


@query(f"""SELECT DISTINCT evidence_id, {HOST.format('source_url')} AS host, substring(evidence_text, CAST(greatest(position(lower('hearing') IN lower(evidence_text)) - 120, 1) AS BIGINT), CAST(position('hearing' IN lower(evidence_text)) + 7 + 120 - greatest(position('hearing' IN lower(evidence_text)) - 120, 1) AS BIGINT)) AS around
FROM investigation_evidence WHERE contains(lower(evidence_text), 'hearing')""")
def surrounding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text around the first place of a value, compared without case."""
    from quarry.operators.investigation import surrounding

    e = load(spark, sf, "investigation_evidence").where(F.contains(F.lower("evidence_text"), F.lit("hearing")))
    return e.select("evidence_id", T.host(F.col("source_url")).alias("host"), surrounding(F.col("evidence_text"), F.lit("hearing")).alias("around")).distinct()


