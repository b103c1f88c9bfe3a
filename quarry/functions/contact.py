"""Column functions over e-mail addresses, hosts and names: what kind of source or contact something is, and how sure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import text as T


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def email_of(c: Column) -> Column:
    """An address as it is compared: trimmed, lower case, without mailto:."""
    return T.blank_to_null(F.regexp_replace(F.lower(F.trim(c)), "^mailto:", ""))


def email_domain(email: Column) -> Column:
    return F.nullif(F.split_part(F.lower(email), F.lit("@"), F.lit(2)), F.lit(""))


def is_placeholder(email: Column) -> Column:
    d = email_domain(email)
    return d.isNull() | d.isin(*K.PLACEHOLDER_DOMAINS)


def is_valid(email: Column) -> Column:
    """Shaped as an address, and not of a placeholder's domain."""
    return false_if_null(email_of(email).rlike(f"^{K.EMAIL}$") & ~is_placeholder(email_of(email)))


def is_free(email: Column) -> Column:
    return false_if_null(email_domain(email).isin(*K.FREE_DOMAINS))


def is_government_host(host: Column) -> Column:
    return false_if_null(host.endswith(".gov") | host.contains(".gov."))


def is_government_email(email: Column) -> Column:
    return is_government_host(email_domain(email))


def is_social(host: Column) -> Column:
    return T.hosted_by(host, K.SOCIAL_HOSTS)


def is_map(host: Column) -> Column:
    return T.hosted_by(host, K.MAP_HOSTS)


def is_directory(host: Column) -> Column:
    return false_if_null(host.isin(*K.DIRECTORY_HOSTS))


def is_probable_website(host: Column) -> Column:
    """A host that is stated and is no social network's."""
    return host.isNotNull() & false_if_null(~host.isin(*K.SOCIAL_HOSTS))


def is_company_site(host: Column) -> Column:
    """A host that can be a company's own: no social network, map, directory or government."""
    return is_probable_website(host) & ~is_social(host) & ~is_map(host) & ~is_directory(host) & ~is_government_host(host)


def root_label(url_or_email: Column) -> Column:
    """The last label but one of a host, so that one body is known under several top-level domains."""
    v = F.lower(F.trim(url_or_email))
    host = F.when(v.contains("@") & ~v.contains("://"), F.regexp_extract(v, "@([^@]*)$", 1)).otherwise(F.regexp_extract(v, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1))
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(host, ":.*$", ""), r"^www\.", ""), r"\."), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).when(F.size(parts) == 1, F.get(parts, 0))


def label(score: Column) -> Column:
    """HIGH from .80, MEDIUM from .55, else LOW; null for no score."""
    return F.when(score >= 0.80, "HIGH").when(score >= 0.55, "MEDIUM").when(score.isNotNull(), "LOW")


def any_within(tokens: Column, text: Column) -> Column:
    """How many of the tokens stand somewhere in a text."""
    return F.size(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.contains(text, t)))


def name_tokens(name: Column, least: int = 2, letters: str = "A-Za-z") -> Column:
    """The lower-case words of a name that have at least so many letters; an empty array for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(f"[{letters}]{{{least},}}"), F.lit(0)), F.lower)


def email_score(email: Column, name: Column, source_host: Column, evidence_type: Column) -> Column:
    """How sure an address is the applicant's in the identity stage; 0 for an invalid one."""
    e = email_of(email)
    by_type = F.when(evidence_type == "official_site", 0.25).when(evidence_type == "search_result", 0.05).when(evidence_type == "government_record", 0.30).otherwise(0.0)
    named = any_within(name_tokens(name), T.mailbox(e)) > 0
    score = (
        F.lit(0.40) + by_type + F.when(~is_free(e), 0.10).otherwise(0.0) - F.when(T.is_generic(e), 0.10).otherwise(0.0)
        + F.when(named, 0.10).otherwise(0.0) + F.when(false_if_null(source_host == email_domain(e)), 0.05).otherwise(0.0)
    )
    return F.when(is_valid(e), F.least(F.lit(1.0), F.round(score, 3))).otherwise(0.0)


#: What a source of a type says about an address, in hundredths.
EMAIL_BASE = {"government_record": 92, "official_website": 88, "public_web": 70, "public_business_directory": 60, "search_result": 55}


def email_confidence(email: Column, host: Column, source_type: Column, name: Column) -> Column:
    """How sure an address is the applicant's in the contact stage; whole hundredths up to the end, so engines agree."""
    base = reduce(lambda c, kv: c.when(source_type == kv[0], kv[1]), list(EMAIL_BASE.items())[1:], F.when(source_type == "government_record", EMAIL_BASE["government_record"])).otherwise(50)
    local = T.mailbox(email)
    points = (
        base - F.when(local.isin(*K.ROLE_MAILBOXES), 15).otherwise(0) + F.when(any_within(name_tokens(name, 3), local) > 0, 8).otherwise(0)
        - F.when(is_social(host), 15).otherwise(0)
    )
    return F.least(F.greatest(points, F.lit(0)), F.lit(99)) / 100


def source_confidence(host: Column, source_type: Column) -> Column:
    return F.when(is_government_host(host), 0.90).when(source_type == "official_website", 0.88).when(source_type == "public_business_directory", 0.55).otherwise(0.65)


def relevance(text: Column, name: Column, address: Column | None = None, neighborhood: Column | None = None, company: Column | None = None, source_type: Column | None = None) -> Column:
    """How far a text concerns an applicant, 0 to 1. Some word of the name must stand in it; the rest only adds.

    The whole name counts .50, a part .15; most of the address .30; the neighbourhood .15; the whole
    company .35; a vetted type of source .10. Points are whole hundredths.
    """
    none = F.lit(None).cast("string")
    of = lambda c: none if c is None else c
    addr = F.transform(F.regexp_extract_all(F.coalesce(of(address), F.lit("")), F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    parts = F.struct(F.lower(text).alias("low"), name_tokens(name).alias("words"), addr.alias("addr"), name_tokens(of(company), 3).alias("firm"), F.lower(T.blank_to_null(of(neighborhood))).alias("hood"), of(source_type).alias("kind"))

    def score(x: Column) -> Column:
        met = any_within(x["words"], x["low"])
        points = (
            F.when(met == F.size(x["words"]), 50).otherwise(15)
            + F.when((F.size(x["addr"]) > 0) & (any_within(x["addr"], x["low"]) * 10 >= F.size(x["addr"]) * 6), 30).otherwise(0)
            + F.when(false_if_null(F.contains(x["low"], x["hood"])), 15).otherwise(0)
            + F.when((F.size(x["firm"]) > 0) & (any_within(x["firm"], x["low"]) == F.size(x["firm"])), 35).otherwise(0)
            + F.when(false_if_null(x["kind"].isin("government_record", "public_business_directory")), 10).otherwise(0)
        )
        return F.when(false_if_null(met > 0), F.least(points, F.lit(100)) / 100).otherwise(0.0)

    # the words are worked out once, however often the score looks at them
    return F.element_at(F.transform(F.array(parts), score), 1)


ACCEPTED = 0.50


def search_queries(name: Column, address: Column, municipality: Column, state: Column) -> Column:
    """The queries that would look for an applicant, without repetitions; an empty array without a name."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    n, a = T.blank_to_null(T.collapse(name)), T.blank_to_null(T.collapse(address))
    place = F.nullif(F.concat_ws(" ", T.blank_to_null(T.collapse(municipality)), T.blank_to_null(T.collapse(state))), F.lit(""))
    said = F.array(
        F.concat(q(n), F.lit(" "), q(a)), F.concat(q(n), F.lit(" "), q(place)), F.concat(q(n), F.lit(" contact email")), F.concat(q(n), F.lit(" "), q(a), F.lit(" email")), F.concat(q(n), F.lit(" LinkedIn")),
    )
    return T.unique_ignoring_case(F.array_compact(said))


#: Role phrases, longer ones first, and a capitalised name of two or three words.
ROLE = "|".join(sorted(K.ROLES, key=lambda r: (-len(r), r)))
PERSON = r"[A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+){1,2}"
NAME_THEN_ROLE = rf"({PERSON})\s*[,–—-]\s*((?i:{ROLE}))\b"
ROLE_THEN_NAME = rf"\b((?i:{ROLE}))\b\s*[:–—-]\s*({PERSON})"


def role_mentions(text: Column) -> Column:
    """Array of (name, role) that a text states as "Name, Role" or "Role: Name", without organisations."""
    pairs = lambda p, n, r: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(n)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(r)).alias("said"))
    roles = F.create_map(*[F.lit(x) for kv in K.ROLES.items() for x in kv])
    both = F.concat(pairs(NAME_THEN_ROLE, 1, 2), pairs(ROLE_THEN_NAME, 2, 1))
    named = F.transform(both, lambda x: F.struct(T.collapse(x["name"]).alias("name"), F.try_element_at(roles, F.lower(x["said"])).alias("role")))
    return F.array_distinct(F.filter(named, lambda x: ~T.is_company_shaped(x["name"]) & x["role"].isNotNull()))


def same_person(a: Column, b: Column) -> Column:
    """Whether the words of one name all stand in the other, either way."""
    return (F.size(a) > 0) & ((F.size(F.array_except(a, b)) == 0) | ((F.size(b) > 0) & (F.size(F.array_except(b, a)) == 0)))


def party_queries(owner: Column, entity: Column, applicant: Column, address: Column, number: Column, municipality: Column) -> Column:
    """The queries that would look for the party behind a lead, in order; an empty array where nobody is named."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    party = F.coalesce(entity, owner, applicant)
    both = lambda a, b: F.concat(q(a), F.lit(" "), q(b))
    said = F.array(
        q(party), both(owner, entity), both(party, address), F.concat(q(party), F.lit(" contact")), F.concat(q(party), F.lit(" email phone")), F.concat(q(entity), F.lit(" website")), q(number),
        F.concat(q(address), F.lit(" development")), both(party, municipality),
    )
    return F.when(party.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(said))
