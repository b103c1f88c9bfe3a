"""The queries of the training-data problems and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import addresses, bpe, entity_match, mixing, name_variants, ocr, pii, spam, survivors
from quarry.session import load


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a lead and a finding about its applicant."""
    return p1_matches(spark, sf).select("lead_id", "match_id")


def p1_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The applicant that every finding is about, how many leads it has, and the confidence: the pairs of p1_found, not multiplied out."""
    return entity_match.findings_about(entity_match.leads_of(load(spark, sf, "opportunity")), entity_match.findings_of(load(spark, sf, "identity_match")))


def p1_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with the confidence of each."""
    return entity_match.matches(entity_match.leads_of(load(spark, sf, "opportunity")), entity_match.findings_of(load(spark, sf, "identity_match")))


#: The key of the surrogates; a deployment passes its own secret to pii.redacted.
SURROGATE_KEY = "demonstration key"


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of personal data in the evidence texts and snippets."""
    return pii.items(pii.texts_of(load(spark, sf, "investigation_evidence"), load(spark, sf, "identity_evidence"))).select("evidence_id", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The texts with typed placeholders and with surrogates."""
    return pii.redacted(pii.texts_of(load(spark, sf, "investigation_evidence"), load(spark, sf, "identity_evidence")), SURROGATE_KEY)


def p2_surrogate_faults(spark: SparkSession, sf: str) -> DataFrame:
    """How often, over all texts, two entities share a surrogate or one has two: never."""
    return pii.surrogate_faults(pii.texts_of(load(spark, sf, "investigation_evidence"), load(spark, sf, "identity_evidence")), SURROGATE_KEY)


def name_rows(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.rows_of(load(spark, sf, "opportunity"), load(spark, sf, "pud871_opportunity"), load(spark, sf, "applicant_enrichment"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows whose name fields denote the same person or organisation in different writings."""
    return name_variants.found(name_rows(spark, sf))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every row that names somebody, and its number of links."""
    return name_variants.members(name_rows(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of scanned texts that carry a defect, and which."""
    return ocr.defects(load(spark, sf, "parsed_document"))


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as continuous paragraphs."""
    return ocr.repaired(load(spark, sf, "parsed_document"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows of opportunity and pud871_opportunity at the same site."""
    return addresses.found(addresses.rows_of(load(spark, sf, "opportunity"), load(spark, sf, "pud871_opportunity")))


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows every row shares its site with."""
    return addresses.link_counts(addresses.rows_of(load(spark, sf, "opportunity"), load(spark, sf, "pud871_opportunity")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """For each contact with several candidate ids, which rows supply its value and its domain."""
    return survivors.found(load(spark, sf, "contact_candidate"))


def p6_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record of every contact."""
    return survivors.survivors(load(spark, sf, "contact_candidate"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode(load(spark, sf, "documents"))


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents there are, and how many come back from their ids unchanged."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs)).withColumnRenamed("text", "back")
    same = F.count_if(F.coalesce("text", F.lit("")) == F.col("back"))
    return docs.join(back, "doc_id").agg(F.count("*").alias("documents"), same.alias("unchanged"))


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    """How often the mix uses each document."""
    return mixing.mixed(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source holds of the mix."""
    return mixing.mixed(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))[1]


def p8_clamped_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas of a mix nine tenths as large as all repetitions could make it, by size in characters: sources that cannot fill their share are clamped."""
    docs = load(spark, sf, "documents").select("doc_id", F.nullif(F.trim("source"), F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("tokens"))
    targets = load(spark, sf, "mix_targets")
    room = sum(have * cap for _, share, have, cap, _ in mixing.quotas(docs, targets) if share > 0)
    rows = [(s, have, q) for s, _, have, _, q in mixing.quotas(docs, targets, 0.9 * room)]
    return spark.createDataFrame(rows, "source string, available bigint, quota double").withColumn("quota", F.round("quota", 2))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are spam."""
    return spam.found(load(spark, sf, "documents"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The list density of every document and the part of it that other hosts repeat."""
    return spam.scores(load(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_matches, p1_findings, p2_found, p2_redacted, p2_surrogate_faults, p3_found, p3_classes, p4_found, p4_repaired, p5_found, p5_links, p6_found, p6_survivors, p7_ids, p7_round_trip, p8_uses, p8_shares, p8_clamped_quotas, p9_found, p9_scores)}


P6_KEYED = r"""
WITH named AS (
  SELECT candidate_id, upper(trim(application_number)) AS app, lower(trim(contact_type)) AS kind, lower(trim(value)) AS v,
         confidence, discovered_at, source_domain
  FROM contact_candidate
  WHERE trim(application_number) <> '' AND trim(value) <> '' AND candidate_id IS NOT NULL
), keyed AS (
  SELECT DISTINCT candidate_id, app, kind, confidence, discovered_at, nullif(trim(source_domain), '') AS dom,
    CASE kind
      WHEN 'email' THEN regexp_extract(v, '[a-z0-9._%+''-]+@[a-z0-9-]+([.][a-z0-9-]+)+')
      WHEN 'phone' THEN right(regexp_replace(regexp_replace(v, '\s*(ext|x|#)[.]?\s*[0-9]+.*$', ''), '[^0-9]', '', 'g'), 10)
      ELSE regexp_replace(regexp_replace(regexp_replace(v, '^https?://', ''), '[/?#].*$', ''), '^www[.]', '')
    END AS contact
  FROM named
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_surrogate_faults": "SELECT unnest(['email', 'phone', 'id_number', 'address', 'name']) AS pii_type, CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS split",
        "p8_clamped_quotas": """
WITH a AS (SELECT trim(source) AS source, sum(coalesce(n_chars, 0)) AS available FROM documents WHERE trim(source) <> '' GROUP BY 1),
t AS (SELECT m.source, target_share AS w, CAST(coalesce(available, 0) AS BIGINT) AS available, coalesce(available, 0) * max_repeats AS room FROM mix_targets m LEFT JOIN a USING (source)),
s AS (SELECT *, sum(room) OVER () * 0.9 AS total, sum(room) OVER (ORDER BY room / w, source) AS filled, sum(w) OVER () - sum(w) OVER (ORDER BY room / w, source) AS open_w, lead(room / w) OVER (ORDER BY room / w, source) AS next_ratio, room / w AS ratio FROM t WHERE w > 0 AND room > 0),
l AS (SELECT min(level) AS level FROM (
  SELECT max(total) / sum(w) AS level FROM s HAVING max(total) / sum(w) <= min(ratio) UNION ALL SELECT (total - filled) / open_w FROM s WHERE open_w > 1e-12 AND (total - filled) / open_w >= ratio AND (total - filled) / open_w <= next_ratio))
SELECT t.source, available, CAST(round(coalesce(least(w * level, room), 0), 2) AS DOUBLE) AS quota FROM t, l
""",
        "p7_round_trip": "SELECT count(*) AS documents, count(*) AS unchanged FROM documents",
        "p6_found": P6_KEYED
        + """
SELECT DISTINCT
  first(candidate_id ORDER BY confidence DESC NULLS LAST, discovered_at DESC NULLS LAST, candidate_id) AS value_from,
  coalesce(first(candidate_id ORDER BY discovered_at DESC NULLS LAST, confidence DESC NULLS LAST, candidate_id) FILTER (WHERE dom IS NOT NULL), 0) AS domain_from
FROM keyed GROUP BY app, kind, contact HAVING count(DISTINCT candidate_id) > 1
"""
    }
