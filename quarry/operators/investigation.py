"""Evidence about leads from search results and pages: each generator gives none to many rows per input row.

Leads (app, owner_name, owner_entity, applicant_name, address, neighborhood, municipality, state) are
joined with results (link, title, snippet) or pages (url, text) beforehand; nothing here fetches. Every
generator returns EVIDENCE, deduplicated once per (app, field, value without case, source_url).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import text as T

EVIDENCE = ("app", "field", "value", "source_url", "source_type", "source_domain", "confidence_score", "confidence", "evidence_text")


def primary(owner_entity: Column, owner_name: Column, applicant_name: Column) -> Column:
    """Whom a search is about: the owning entity, else the owner, else the applicant."""
    return T.first_stated(owner_entity, owner_name, applicant_name)


def surrounding(text: Column, value: Column, radius: int = 120) -> Column:
    """The text around the first place of a value, compared without case; null where it does not stand."""
    at = F.position(F.lower(value), F.lower(text))
    begin = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at + F.length(value) + radius - begin))


def combined(title: Column, snippet: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit("")))


def evidence_rows(df: DataFrame, field: Column | str, value: Column, url: Column, source_type: Column | str, score: Column | float, said: Column) -> DataFrame:
    """df's rows as EVIDENCE, the first of equal ones kept. The values of equal rows differ in case at most, so the least text stands for all."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = df.select("app", as_col(field).alias("field"), value.alias("value"), url.alias("source_url"), as_col(source_type).alias("source_type"), T.host(url).alias("source_domain"), as_col(score).cast("double").alias("confidence_score"), said.alias("evidence_text"))
    return unique_evidence(rows.withColumn("confidence", C.label(F.col("confidence_score"))).select(*EVIDENCE).where("value is not null"))


def unique_evidence(rows: DataFrame) -> DataFrame:
    """One row per (app, field, value without case, source_url): the surest, then the least value."""
    rest = [c for c in EVIDENCE if c not in ("app", "field", "source_url")]
    key = F.struct(-F.coalesce("confidence_score", F.lit(0.0)), "value", "source_type", "evidence_text")
    return rows.groupBy("app", "field", F.lower("value").alias("_v"), "source_url").agg(F.min_by(F.struct(*rest), key).alias("_r")).select("app", "field", "_r.value", "source_url", *[f"_r.{c}" for c in rest[1:]])


def contacts_in(df: DataFrame, text: Column, url: Column, source_type: str, email: Column | float, phone: Column | float) -> DataFrame:
    """E-mail addresses that are no placeholder's or government's, and phone numbers, that a text gives."""
    marked = df.withColumn("_text", text)
    kept = F.filter(T.emails(F.col("_text")), lambda e: C.is_valid(e) & ~C.is_government_email(e))
    pick = lambda field, values, score: evidence_rows(marked.withColumn("_v", F.explode(values)), field, F.col("_v"), url, source_type, score, surrounding(F.col("_text"), F.col("_v")))
    digits = T.phones(F.col("_text"))
    return pick("email", kept, email).union(pick("phone", digits, phone))


def web(results: DataFrame) -> DataFrame:
    """What search results themselves give: addresses .55, phones .50, and links that may be a company's site .45."""
    link, host = F.col("link"), T.host(F.col("link"))
    sites = results.where(C.is_probable_website(host) & ~C.is_social(host) & ~C.is_map(host) & ~C.is_directory(host))
    return contacts_in(results, combined(F.col("title"), F.col("snippet")), link, "search_result", 0.55, 0.50).union(evidence_rows(sites, "website", link, link, "search_result", 0.45, F.col("title")))


def web_status(results: DataFrame, found: DataFrame) -> DataFrame:
    """(app, status): ENRICHED with evidence, PARTIAL with results alone."""
    return results.select("app").distinct().join(found.select("app", F.lit(True).alias("any")).distinct(), "app", "left").select("app", F.when(F.col("any"), "ENRICHED").otherwise("PARTIAL").alias("status"))


def search_rows(results: DataFrame) -> DataFrame:
    """Every result that is no social network's as evidence of its own, .30, and what its title and snippet give, .55 and .65."""
    link, host = F.col("link"), T.host(F.col("link"))
    kept = results.where(~C.is_social(host))
    return evidence_rows(kept.where("link is not null"), "search_result", link, link, "search_result", 0.30, F.col("snippet")).union(contacts_in(results, F.concat_ws(" ", "title", "snippet"), link, "search_result", 0.55, 0.65))


def parsed_results(results: DataFrame, name: Column) -> DataFrame:
    """Each result's text with .35 and .15 more per word of the name it holds, .30 of those and .90 in all at most."""
    text = T.collapse(F.concat_ws(" ", T.collapse(F.col("title")), T.collapse(F.col("snippet"))))
    bonus = F.least(C.any_within(C.name_tokens(name), F.lower(text)) * 15, F.lit(30))
    return evidence_rows(results.where(text != ""), "search_result", F.left(text, F.lit(500)), F.col("link"), "search_result", F.least((35 + bonus) / 100, F.lit(0.90)), F.left(F.col("snippet"), F.lit(500)))


def official_sites(found: DataFrame) -> DataFrame:
    """(app, site): the first website that the web source gave each lead, by confidence, then by address."""
    sites = found.where("field = 'website'")
    return sites.groupBy("app").agg(F.min_by("value", F.struct(-F.col("confidence_score"), "value")).alias("site"))


def website(leads: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """What the root page and five fixed paths of each lead's site give: addresses by how well they fit, phones .70, the site .75.

    pages: (url, text). The addresses to look up are generated and equi-joined; a subpage of a hundred
    characters or fewer gives nothing. A site whose root page is not there gives nothing at all.
    """
    url = F.regexp_replace("site", r"/+$", "")
    base = F.regexp_extract("site", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+)", 1)
    wanted = sites.select("app", "site", F.explode(F.array(F.struct(T.normal_url(url).alias("url"), F.lit(True).alias("root")), *[F.struct(T.normal_url(F.concat(base, F.lit(p))).alias("url"), F.lit(False).alias("root")) for p in K.CONTACT_PATHS])).alias("w"))
    wanted = wanted.select("app", "site", "w.url", "w.root").join(leads.select("app", "owner_name"), "app", "left")
    fetched = wanted.join(pages.select(T.normal_url(F.col("url")).alias("url"), "text"), "url")
    have = fetched.where("root").select("app").distinct()
    read = fetched.join(have, "app", "left_semi").where("root or length(text) > 100")
    score = C.email_confidence(F.col("_v"), T.host(F.col("url")), F.lit("official_website"), F.col("owner_name"))
    own = have.join(sites, "app")
    return contacts_in(read, F.col("text"), F.col("url"), "official_website", score, 0.70).union(evidence_rows(own, "website", F.col("site"), F.col("site"), "official_website", 0.75, F.col("site")))


def directories(results: DataFrame, listed: Callable[[Column], Column] = C.is_directory) -> DataFrame:
    """What business directories list: the listing .55, addresses .50, phones .45. listed tells a directory's host."""
    link = F.col("link")
    rows = results.where(listed(T.host(link)))
    return evidence_rows(rows, "business_listing", F.col("primary"), link, "business_directory", 0.55, F.col("snippet")).union(contacts_in(rows, combined(F.col("title"), F.col("snippet")), link, "business_directory", 0.50, 0.45))


def profiles(results: DataFrame, network: str = K.PROFILE_HOST) -> DataFrame:
    """Links into a professional network, .60."""
    return evidence_rows(results.where(F.contains(T.host(F.col("link")), F.lit(network))), "linkedin_profile", F.col("link"), F.col("link"), "professional_profile", 0.60, F.coalesce(T.blank_to_null(F.col("snippet")), F.col("title")))


def looks_like_company(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(K.COMPANY_WORDS)), F.lit(False))


def public_records(results: DataFrame) -> DataFrame:
    """Results that speak of a registered company, for searches about one, .50."""
    said = F.lower(combined(F.col("title"), F.col("snippet"))).rlike("|".join(K.RECORD_WORDS))
    return evidence_rows(results.where(T.host(F.col("link")).isNotNull() & looks_like_company(F.col("primary")) & said), "business_record", F.col("primary"), F.col("link"), "public_record", 0.50, F.col("snippet"))


def projects(results: DataFrame) -> DataFrame:
    """Results that name two words of the project's address and one of the entity, .60."""
    low = F.lower(combined(F.col("title"), F.col("snippet")))
    longer = lambda c, n: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), " +"), lambda t: F.length(t) > n)
    both = (C.any_within(longer(F.col("address"), 1), low) >= 2) & (C.any_within(longer(F.col("primary"), 2), low) >= 1)
    return evidence_rows(results.where(both), "project_relationship", F.concat_ws(" -> ", "primary", "address"), F.col("link"), "public_web", 0.60, F.col("snippet"))


def contacts(results: DataFrame, existing: DataFrame, enough: int = 3) -> tuple[DataFrame, DataFrame]:
    """(evidence, status) of the contact source: leads with enough contact rows already are ENRICHED without being searched.

    existing: evidence so far. Others get addresses .50 and phones .45 from their results.
    """
    have = existing.where(F.col("field").isin("email", "phone", "website")).groupBy("app").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("app")
    found = contacts_in(results.join(have, "app", "left_anti"), combined(F.col("title"), F.col("snippet")), F.col("link"), "public_web", 0.50, 0.45)
    apps = results.select("app").distinct().join(have.withColumn("had", F.lit(True)), "app", "left").join(found.select("app").distinct().withColumn("got", F.lit(True)), "app", "left")
    return found, apps.select("app", F.when(F.col("had") | F.col("got"), "ENRICHED").otherwise("NOT_FOUND").alias("status"))


def page_evidence(pages: DataFrame, source_type: str, home: tuple[str, ...] = ()) -> DataFrame:
    """What fetched pages (app, url, text, title, is_pdf, with the lead's columns) give.

    A PDF is read only where it concerns the lead; other pages are always read. Addresses count by
    email_confidence; phones .10 more than the source, .95 at most, and none from a government's page.
    home: root labels of bodies that count as government. Titles are evidence of their own, .35.
    """
    host, url = T.host(F.col("url")), F.col("url")
    fits = C.relevance(F.col("text"), F.col("applicant_name"), F.col("address"), F.col("neighborhood"), F.col("owner_entity"), F.lit(source_type)) >= C.ACCEPTED
    read = pages.where(~F.col("is_pdf") | fits)
    official = C.is_government_host(host) | C.false_if_null(C.root_label(url).isin(*home) if home else F.lit(False))
    ours = lambda e: C.is_government_email(e) | C.false_if_null(C.root_label(e).isin(*home) if home else F.lit(False))
    base = C.source_confidence(host, F.lit(source_type))
    found = contacts_in(read.withColumn("_gov", official), F.col("text"), url, source_type, C.email_confidence(F.col("_v"), host, F.lit(source_type), F.col("applicant_name")), F.least(F.round(base + 0.10, 2), F.lit(0.95)))
    found = found.where(~((F.col("field") == "phone") & (C.is_government_host(F.col("source_domain")) | (C.root_label(F.col("source_url")).isin(*home) if home else F.lit(False)))) & ~((F.col("field") == "email") & ours(F.col("value"))))
    titles = pages.where(~F.col("is_pdf") & (F.col("title") != ""))
    return found.union(evidence_rows(titles, "page_title", F.col("title"), url, source_type, 0.35, F.col("title")))


#: Elements small enough to be the context of a link inside them, and how long they may be.
CONTEXT_TAGS, LONGEST_CONTEXT = ("p", "li", "td", "th", "span", "dd", "dt", "figcaption", "blockquote"), 400
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Anchors(HTMLParser):
    """The links of a page in order: address, own text, and the text of the element they lie in directly if that is a small one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.links: list[tuple[str, list[str], list[str] | None]] = []
        self.now: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if tag == "a" and (href := dict(attrs).get("href")):
            around = self.open[-1] if self.open else None
            self.now = []
            self.links.append((href, self.now, around[1] if around and around[0] in CONTEXT_TAGS else None))
        self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag == "a":
            self.now = None

    def handle_data(self, data: str) -> None:
        for _, said in self.open:
            said.append(data)
        if self.now is not None:
            self.now.append(data)


def anchors(pages: DataFrame) -> DataFrame:
    """pages (url, html, …) with one row per link: href, anchor, context. Markup is read in Arrow batches; null and broken pages give what can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda parts: " ".join(" ".join(parts).split())
        for b in batches:
            out = []
            for i, html in zip(b["_id"], b["html"], strict=True):
                p = Anchors()
                p.feed(html or "")
                for n, (href, own, around) in enumerate(p.links):
                    said, wider = flat(own), flat(around) if around is not None else ""
                    out.append((i, n, href, said, wider if 0 < len(wider) <= LONGEST_CONTEXT else said))
            yield pd.DataFrame(out, columns=["_id", "ordinal", "href", "anchor", "context"])

    keyed = pages.withColumn("_id", F.xxhash64(*pages.columns))
    links = keyed.select("_id", "html").distinct().mapInPandas(run, "_id long, ordinal int, href string, anchor string, context string")
    return keyed.drop("html").join(links, "_id").drop("_id")


def absolute(href: Column, page: Column) -> Column:
    """A link as an absolute http address without trailing punctuation; null for other schemes."""
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    h = F.trim(href)
    full = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), h))
    return F.when(full.rlike("(?i)^https?://"), F.regexp_replace(full, r"[.,);\]]+$", ""))


def company_links(pages: DataFrame, source_type: str, home: tuple[str, ...] = ()) -> DataFrame:
    """(app, url, website) of links that may be the lead's own site: the page and the link's own context both concern the lead.

    pages: (app, url, html, text and the lead's columns). Social, government, map and address-bearing links fall away.
    """
    of = lambda c: C.relevance(c, F.col("applicant_name"), F.col("address"), F.col("neighborhood"), F.col("owner_entity"), F.lit(source_type)) >= C.ACCEPTED
    rows = anchors(pages.where(of(F.col("text")))).where(of(F.col("context")))
    site = F.transform(F.array(absolute(F.col("href"), F.col("url"))), lambda w: F.struct(w.alias("w"), T.host(w).alias("h"), C.root_label(w).alias("r"), F.lower(T.blank_to_null(F.col("address"))).alias("a")))

    def own(x: Column) -> Column:
        mine = C.false_if_null(x["r"].isin(*home)) if home else F.lit(False)
        directions = C.false_if_null(F.contains(F.lower(x["w"]), x["a"]))
        return x["w"].isNotNull() & ~C.is_social(x["h"]) & ~C.is_government_host(x["h"]) & ~mine & ~C.is_map(x["h"]) & ~directions & C.is_probable_website(x["h"])

    # an array of one is filtered in place, so the address and its host are worked out once
    return rows.select("app", "url", F.explode_outer(F.filter(site, own)).alias("x")).where("x is not null").select("app", "url", F.col("x.w").alias("website")).distinct()


def role_candidates(pages: DataFrame, source_type: str = "public_web") -> DataFrame:
    """(app, url, name, role, same_person, score) of the persons with roles that pages name.

    A mention of the applicant only tells the role and is kept anyway; another person needs a page that
    concerns the lead and must not be the company, and counts .10 less than the source, .30 at least.
    """
    host = T.host(F.col("url"))
    rows = pages.where(~C.is_government_host(host)).withColumn("_m", F.explode(C.role_mentions(F.col("text"))))
    same = C.same_person(C.name_tokens(F.col("applicant_name")), C.name_tokens(F.col("_m.name"), 1))
    fits = C.relevance(F.col("text"), F.col("applicant_name"), F.col("address"), F.col("neighborhood"), F.col("owner_entity"), F.lit(source_type)) >= C.ACCEPTED
    company = C.false_if_null(F.lower(F.trim("_m.name")) == F.lower(F.trim("owner_entity")))
    base = C.source_confidence(host, F.lit(source_type))
    score = F.when(F.col("same"), base).otherwise(F.greatest(F.lit(0.30), F.round(base - 0.10, 2)))
    marked = rows.select("*", same.alias("same"), fits.alias("fits"), company.alias("company"))
    return marked.where("same or (fits and not company)").select("app", "url", F.col("_m.name").alias("name"), F.col("_m.role").alias("role"), F.col("same").alias("same_person"), score.alias("score")).distinct()


def identity_scores(rows: DataFrame, listed: Callable[[Column], Column] = C.is_directory, network: str = K.PROFILE_HOST) -> DataFrame:
    """rows of e-mail and phone evidence with the lead's names -> score and signals that they are the lead's.

    Owner's name .25, entity in the domain .30, two words of the address .20, government .15, directory
    .10, network .15; whole hundredths, 1 at most.
    """
    text, domain = F.lower(F.coalesce("evidence_text", F.lit(""))), F.coalesce("source_domain", F.lit(""))
    longer = lambda c, n: F.filter(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+"), lambda t: F.length(t) > n)
    signals = {
        "owner_name": (25, C.any_within(longer(F.col("owner_name"), 2), text) >= 1), "entity_domain": (30, (domain != "") & (C.any_within(longer(F.col("owner_entity"), 2), F.lower(domain)) >= 1)),
        "address": (20, C.any_within(longer(F.col("address"), 3), text) >= 2), "government": (15, domain.contains(".gov")), "directory": (10, listed(domain)), "network": (15, F.contains(domain, F.lit(network))),
    }
    points = sum((F.when(ok, n).otherwise(0) for n, ok in signals.values()), F.lit(0))
    named = F.array_compact(F.array(*[F.when(ok, F.lit(k)) for k, (_, ok) in signals.items()]))
    out = rows.where(F.col("field").isin("email", "phone")).select("*", (F.least(points, F.lit(100)) / 100).alias("match_score"), named.alias("signals"))
    return out.withColumn("label", C.label(F.col("match_score")))


def identity(leads: DataFrame) -> DataFrame:
    """leads with their normalised identity: name, e-mail of record, score, label, status and the queries that would look for them.

    The name counts .25, a valid e-mail .35, a site .20. A lead without a name has no identity.
    """
    name = T.blank_to_null(T.collapse(F.col("applicant_name")))
    email = F.when(C.is_valid(F.col("applicant_email")), C.email_of(F.col("applicant_email")))
    site = T.blank_to_null(F.col("company_website")) if "company_website" in leads.columns else F.lit(None).cast("string")
    points = F.lit(25) + F.when(email.isNotNull(), 35).otherwise(0) + F.when(site.isNotNull(), 20).otherwise(0)
    return leads.withColumns({
        "normalized_name": name, "email": F.when(name.isNotNull(), email), "email_domain": F.when(name.isNotNull(), C.email_domain(email)),
        "identity_confidence": F.when(name.isNull(), "LOW").otherwise(C.label(points / 100)), "identity_status": F.when(name.isNull(), "missing_applicant_name").otherwise("identity_only"),
        "search_queries": C.search_queries(name, F.col("address"), F.col("municipality"), F.col("state")),
    })


def run_sources(leads: DataFrame, done: DataFrame, sources: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], forced: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(evidence, states) of a resumable run: each source in the given order, over the leads it has not ENRICHED yet.

    done: (app, source, status) of earlier runs. A source is a function of the leads still open for it
    and of all evidence found before it, so one can build on another; a forced source runs over all.
    Evidence is deduplicated once, after the union of all sources. A source that fails while it is built
    becomes ERROR for its leads; the others go on.
    """
    found: DataFrame | None = None
    states = done
    for name, source in sources.items():
        settled = done.where((F.col("source") == name) & (F.col("status") == "ENRICHED")).select("app")
        todo = leads if name in forced else leads.join(settled, "app", "left_anti")
        try:
            got = source(todo, found if found is not None else empty_evidence(leads))
            state = todo.select("app").join(got.select("app").distinct().withColumn("_got", F.lit(True)), "app", "left").select("app", F.lit(name).alias("source"), F.when(F.col("_got"), "ENRICHED").otherwise("NOT_FOUND").alias("status"))
            found = got if found is None else found.union(got)
        except Exception:  # a broken source must not stop the others
            state = todo.select("app", F.lit(name).alias("source"), F.lit("ERROR").alias("status"))
        states = states.join(state.select("app", "source"), ["app", "source"], "left_anti").unionByName(state)
    return unique_evidence(found if found is not None else empty_evidence(leads)), states


def empty_evidence(leads: DataFrame) -> DataFrame:
    text = lambda n: F.lit(None).cast("string").alias(n)
    return leads.limit(0).select("app", *[F.lit(None).cast("double").alias(n) if n == "confidence_score" else text(n) for n in EVIDENCE[1:]])


def overall_status(states: DataFrame) -> DataFrame:
    """(app, status) over all sources of a lead: ENRICHED needs three enriched ones once all are settled."""
    s = states.groupBy("app").agg(F.map_from_entries(F.collect_list(F.struct("source", "status"))).alias("m"))
    all_of = F.map_values("m")
    n = F.size(F.filter(all_of, lambda x: x == "ENRICHED"))
    settled = F.forall(all_of, lambda x: x.isin("ENRICHED", "NOT_FOUND"))
    status = (
        F.when(F.forall(all_of, lambda x: x == "NOT_STARTED"), "NOT_STARTED").when(settled, F.when(n >= 3, "ENRICHED").when(n >= 1, "PARTIAL").otherwise("NOT_FOUND"))
        .when(F.exists(all_of, lambda x: x == "ERROR"), F.when(n >= 1, "PARTIAL").otherwise("ERROR")).when(F.exists(all_of, lambda x: x == "IN_PROGRESS"), "IN_PROGRESS").when(n >= 1, "PARTIAL").otherwise("NOT_FOUND")
    )
    return s.select("app", status.alias("status"))
