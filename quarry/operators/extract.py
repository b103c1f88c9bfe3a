"""Fields of applications from packet texts: labelled tables, owners, parties, contacts, types, addresses, event dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import contact as C
from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import evidence as E
from quarry.operators import rows as R

# Labels of parties and the role each stands for, labels that end a value, types by pattern in order of precedence.
PARTY_LABELS = (
    ("Engineer of Record", "Engineer"), ("Architect of Record", "Architect"), ("Surveyor of Record", "Surveyor"), ("Landscape Architect", "Landscape Architect"), ("General Contractor", "Contractor"),
    ("Contractor of Record", "Contractor"), ("Attorney of Record", "Attorney"), ("Developer of Record", "Developer"), ("Representative of Record", "Representative"), ("Agent of Record", "Representative"),
)
OTHER_LABELS = (
    "Applicant", "Agent", "Representative", "Property Owner", "Owner", "Engineer", "Architect", "Surveyor of Record", "Landscape Architect", "General Contractor", "Contractor", "Attorney", "Developer", "Zoning",
    "Property Location", "Tract Size", "Total Area", "Acreage", "Parcel", "Staff Contact", "Prepared by",
)
TYPES = (
    ("Ordinance Text Amendment", "ordinance text amendment"), ("Zone Map Amendment", "zone map amendment"), ("Concept Plan", "concept plan"), ("Project Plan", "project plan"), ("Variance", r"\bvariance\b"),
    ("Conditional Use", "conditional use"), ("Subdivision", r"\bsubdivision\b"), ("General Plan Amendment", "general plan amendment"), ("General Plan Amendment", "general plan map amendment"),
    ("General Plan Amendment", "amendment to the general plan map"),
)
#: How far a table of labels reaches where no first section begins, how far a report follows a number, how far a contact follows a name.
REGION, REPORT, NEARBY = 4000, 3000, 300
STREETS = "Road|Rd|Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Circle|Cir|Lane|Ln|Way|Court|Ct|Place|Pl|Parkway|Pkwy|Highway|Hwy"
ADDRESS = rf"(?i)\b[0-9]{{1,6}}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){{0,6}}\s+(?:{STREETS})\b"
SPECIAL_ADDRESS = rf"(?i)\b[0-9]+(?:/[0-9]+)?\s+(?:N|S|E|W|North|South|East|West)?\s*[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){{0,5}}\s+(?:{STREETS}|North|South|East|West)\b"


def stated(c: Column) -> Column:
    return T.blank_to_null(T.collapse(c))


def region(text: Column) -> Column:
    """The table of labels of a packet: what stands before its first section, else its first characters."""
    opens = r"(?is)\bSECTION\s+1\b.*$"
    return F.when(text.rlike(opens), F.regexp_replace(text, opens, "")).otherwise(F.left(text, F.lit(REGION)))


def value(text: Column, label: str) -> Column:
    """What follows a label on its line. This and the readers of tables below take the table of labels, as region gives it."""
    return stated(F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*[:-]?[ \t]+(\S.*?)[ \t]*$", 1))


KNOWN = r"(?i)^\s*(?:" + "|".join(OTHER_LABELS) + r")\b"


def value_lines(text: Column, label: str, most: int = 3) -> Column:
    """The value of a label on its own line, or the lines below a bare label up to an empty line or the next label."""
    below = F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*[:-]?[ \t]*$([\s\S]*)", 1)
    block = F.get(F.split(F.regexp_replace(below, r"^\s+", ""), r"\n[ \t]*(?:\n|$)"), 0)
    lines = F.slice(F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != ""), 1, most)

    def up_to_label(found: Column) -> Column:
        at = F.array_position(F.transform(found, lambda x: x.rlike(KNOWN)), F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(found, F.lit(1), at - 1)).otherwise(found)

    return T.let(value(text, label), lambda same: F.when(same.isNotNull(), F.array(same)).otherwise(T.let(lines, up_to_label)))


def split_contact(cell: Column) -> Column:
    """(name, email, phone) of a cell such as "Name | mail, phone"; without a bar and a contact the whole cell is the name."""

    def parts(x: Column) -> Column:
        name = stated(F.regexp_extract(x, r"^\s*([^|]+?)\s*\|\s*.+$", 1))
        return F.struct(name.alias("name"), F.coalesce(F.when(name.isNotNull(), F.regexp_extract(x, r"^\s*[^|]+?\s*\|\s*(.+)$", 1)), x).alias("rest"), x.alias("cell"))

    def contacts(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), x["cell"].alias("cell"), F.get(T.emails(x["rest"]), 0).alias("email"), F.get(T.phones(x["rest"]), 0).alias("phone"))

    def whole(x: Column) -> Column:
        return F.struct(F.coalesce(x["name"], F.when(x["email"].isNull() & x["phone"].isNull(), stated(x["cell"]))).alias("name"), x["email"].alias("email"), x["phone"].alias("phone"))

    return T.let(T.let(T.let(cell, parts), contacts), whole)


def owner(text: Column) -> Column:
    """The owner of record: entity lines without a care-of line, the contact, and what kind of owner it is; nulls where nothing is labelled."""
    lines = T.let(value_lines(text, "Property Owner"), lambda first: F.when(F.size(first) > 0, first).otherwise(value_lines(text, "Owner of Record")))
    is_care = lambda x: x.rlike(r"(?i)^c/o\s+\S")

    def read(x: Column) -> Column:
        care = stated(F.regexp_replace(F.get(F.filter(x["lines"], is_care), 0), r"(?i)^c/o\s+", ""))
        entity = T.blank_to_null(F.array_join(F.transform(F.filter(x["lines"], lambda y: ~is_care(y)), lambda y: F.regexp_replace(y, ",+$", "")), " "))
        return F.struct(entity.alias("entity"), F.coalesce(x["cell"]["name"], care).alias("name"), x["cell"].alias("cell"))

    def stating(x: Column) -> Column:
        entity, name, cell = x["entity"], x["name"], x["cell"]
        some = entity.isNotNull() | name.isNotNull() | cell["email"].isNotNull()
        kind = F.when(entity.isNotNull(), "Entity").when(name.isNotNull(), "Individual")
        return F.struct(F.coalesce(name, entity).alias("owner_name"), entity.alias("owner_entity"), kind.alias("owner_type"), name.alias("contact_name"), cell["email"].alias("contact_email"), cell["phone"].alias("contact_phone"), F.when(some, "government_record").alias("source"))

    cell = split_contact(value(text, "Owner Contact"))
    return T.let(T.let(F.struct(lines.alias("lines"), cell.alias("cell")), read), stating)


def applicant_of_record(text: Column) -> Column:
    entity = F.coalesce(value(text, "Applicant of Record"), value(text, "Agent of Record"), value(text, "Applicant"))
    return T.let(split_contact(value(text, "Applicant Contact")), lambda cell: F.struct(entity.alias("entity"), cell["name"].alias("contact_name"), cell["email"].alias("contact_email"), cell["phone"].alias("contact_phone")))


def parties(text: Column) -> Column:
    """The licensed parties that labels name, in the order of the labels."""
    named = F.array(*[F.struct(F.lit(role).alias("role"), split_contact(value(text, label)).alias("c")) for label, role in PARTY_LABELS])
    stated_ones = F.filter(named, lambda x: x["c"]["name"].isNotNull() | x["c"]["email"].isNotNull())
    return F.transform(stated_ones, lambda x: F.struct(x["c"]["name"].alias("party_name"), x["role"].alias("party_role"), x["c"]["email"].alias("party_contact_email"), x["c"]["phone"].alias("party_contact_phone")))


def property_details(text: Column) -> Column:
    return F.struct(value(text, "Zoning").alias("zoning"), F.coalesce(value(text, "Total Area"), value(text, "Acreage")).alias("acreage"), F.coalesce(value(text, "Parcel Number"), value(text, "Parcel ID"), value(text, "Parcel")).alias("parcel"))


def applicant(block: Column) -> Column:
    """Who requests: up to six words before "request"."""
    return stated(F.regexp_extract(block, r"(?i)([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,5})\s+requests?\b", 1))


def application_number(block: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(block, rf"(?i)\b{K.APPLICATION_NUMBER}\b", 0)), F.lit(""))


def application_type(block: Column) -> Column:
    """The first type in order of precedence whose pattern the block has."""
    low = F.lower(block)
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in TYPES])


def address(block: Column) -> Column:
    """The address after "located at" in its special or plain form, else that whole phrase; without one the first special, then the first plain address."""
    said = stated(F.regexp_extract(block, r"(?is)located at\s+(.{5,220}?)(?:\.\s+|\bNeighborhood\b)", 1))
    hit = lambda c, p: stated(F.regexp_extract(c, p, 0))
    return F.coalesce(F.when(said.isNotNull(), F.coalesce(hit(said, SPECIAL_ADDRESS), hit(said, ADDRESS), said)), hit(block, SPECIAL_ADDRESS), hit(block, ADDRESS))


def neighborhood(block: Column) -> Column:
    said = F.regexp_extract(block, r"(?i)([A-Za-z0-9.' -]+?)\s+Neighborhood\b", 1)
    return stated(F.regexp_replace(F.trim(F.regexp_extract(said, r"([^.]*)$", 1)), r"(?i)^(?:located at|the)\s+", ""))


def description(block: Column) -> Column:
    """What is requested, up to the application number."""
    return stated(F.regexp_extract(block, rf"(?is)requests?\s+(.+?)\b{K.APPLICATION_NUMBER}\b", 1))


def applicant_contact(block: Column, name: Column, municipal: tuple[str, ...] = ()) -> Column:
    """(email, phone) right behind the applicant's name: the first address that is not the municipality's; a phone only with such an address."""
    at = F.position(F.lower(name), F.lower(block))
    near = F.when(at > 0, F.substring(block, at + F.length(name), F.lit(NEARBY)))
    own = F.filter(T.emails(near), lambda e: ~C.email_domain(e).isin(*municipal) if municipal else F.lit(True))
    return F.struct(F.get(own, 0).alias("email"), F.when(F.size(own) > 0, F.get(T.phones(near), 0)).alias("phone"))


def report_spans(texts: DataFrame, key: str = "doc_id", column: str = "text", longest: int = REPORT) -> DataFrame:
    """(key, number, start, span): the text from each mention of a number to the next different one, and no longer than a report.

    The next different number comes from one window per document over the mentions.
    """
    hits = E.hits(texts.select(key, column), column, rf"\b{K.APPLICATION_NUMBER}\b").withColumn("number", F.upper("hit"))
    spans = R.next_other(hits.select(key, "number", "start"), [key], ["start"], "number", "start")
    end = F.least(F.col("start") + longest, F.coalesce("next_other_at", F.lit(2**31 - 1)))
    return spans.join(texts.select(key, column), key).select(key, "number", "start", F.substring(column, F.col("start") + 1, end - F.col("start")).alias("span"))


def report_identity(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, number, owner, applicant, parties) of the first report of each number that says anything about them."""
    rows = report_spans(texts, key, column).where(F.upper("span").rlike("APPLICANT|PROPERTY OWNER")).select(key, "number", "start", region(F.col("span")).alias("table"))
    t = F.col("table")
    # an array of one is filtered in place: a filter after it, or an inner explode, would be given a copy of the work below
    some = lambda x: x["owner"]["owner_name"].isNotNull() | x["applicant"]["entity"].isNotNull() | x["applicant"]["contact_name"].isNotNull() | (F.size(x["parties"]) > 0)
    got = rows.select(key, "number", "start", F.explode_outer(F.filter(F.array(F.struct(owner(t).alias("owner"), applicant_of_record(t).alias("applicant"), parties(t).alias("parties"))), some)).alias("x")).where("x is not null")
    return R.first_wins(got.select(key, "number", "start", "x.*"), F.struct(key, "number"), F.col("start")).drop("start")


def items(texts: DataFrame, key: str = "doc_id", column: str = "text", heading: str = r"(?im)^\s*(?:\*+\s*)?-?\s*Item\s+([0-9]+)\b") -> DataFrame:
    """(key, item, start, body): the block under each printed item number; of several with one number the first."""
    found = E.item_blocks(texts.select(key, column), key, column, heading).join(texts.select(key, column), key)
    cut = found.select(key, "start", F.substring(column, F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))
    numbered = cut.select(key, F.regexp_extract("body", heading, 1).try_cast("int").alias("item"), "start", "body")
    return R.first_wins(numbered.where("item is not null"), F.struct(key, "item"), F.col("start"))


# -- events and dates --------------------------------------------------------------------------------

#: Wording that tells of a hypothetical or procedural text, and wording that an outcome needs.
BOILERPLATE = (
    r"decisions?.{0,100}\bmay be appealed\b", r"\badditional information can be found at\b", r"\bfor more information\b", r"\bpublic comments?\b", r"\bpossible motions and findings\b",
    r"\bthe planning commission may make any of the following findings\b", r"\b1\.\s*recommend approval.*?2\.\s*recommend denial\b", r"\b2\.\s*recommend denial.*?3\.\s*continue\b",
)
HYPOTHETICAL = ("possible motions and findings", "may make any of the following findings")
OUTCOME = {
    "recommended_denial": ("was recommended denial", "were recommended denial", "recommended denial by", "recommended denial on", "staff recommended denial of"),
    "denied": ("ultimately denied", "was denied by the municipal council", "denied by the municipal council", "application was denied", "request was denied"),
}
DATE = D.MONTH + r"\s+[0-9]{1,2},\s+[0-9]{4}"
EVENT_DATES = {
    "recommended_denial": (rf"recommended\s+(?:for\s+)?denial.{{0,180}}?\bon\s+({DATE})", rf"recommend(?:ed|s)?\s+denial.{{0,180}}?\b({DATE})"),
    "denied": (
        rf"recommended\s+(?:for\s+)?denial.{{0,180}}?\bon\s+{DATE}.{{0,220}}?(?:ultimately\s+)?denied.{{0,180}}?\bon\s+({DATE})", rf"ultimately\s+denied.{{0,180}}?\bon\s+({DATE})",
        rf"denied\s+by\s+(?:the\s+)?(?:municipal\s+)?council.{{0,180}}?\bon\s+({DATE})", rf"application\s+was\s+denied.{{0,180}}?\bon\s+({DATE})", rf"request\s+was\s+denied.{{0,180}}?\bon\s+({DATE})",
    ),
}


def is_boilerplate(window: Column) -> Column:
    return F.coalesce(window.rlike("(?is)" + "|".join(f"(?:{p})" for p in BOILERPLATE)), F.lit(False))


def is_outcome(kind: Column, window: Column) -> Column:
    """Whether the wording tells of what happened rather than of what may; kinds without markers need none."""
    low = F.lower(window)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    marked = F.lit(True)
    for k, words in OUTCOME.items():
        marked = F.when(kind == k, has(words)).otherwise(marked)
    return F.coalesce(~has(HYPOTHETICAL) & marked, F.lit(False))


def event_date(kind: Column, window: Column) -> Column:
    """The day of this very event: by the kind's own wording, else the window's date if it mentions exactly one."""
    own = F.lit(None).cast("date")
    for k, patterns in EVENT_DATES.items():
        found = F.coalesce(*[D.parse_date(F.nullif(F.regexp_extract(window, "(?is)" + p, 1), F.lit(""))) for p in patterns])
        own = F.when(kind == k, found).otherwise(own)
    said = D.mentions(window)
    return F.coalesce(own, F.when(F.size(said) == 1, F.get(said, 0)))


def near_time(text: Column, start: Column, length: Column, after: int = 160, before: int = 90) -> Column:
    """The first time of day behind a date, else the last one shortly before it."""
    ahead = F.substring(text, start + length + 1, F.lit(after))
    head = F.greatest(start - before, F.lit(0))
    behind = F.substring(text, head + 1, start - head)
    times = F.regexp_extract_all(behind, F.lit(r"(?i)\b[0-9]{1,2}:[0-9]{2}\s*[AP]M\b"), F.lit(0))
    return F.coalesce(D.clock(F.nullif(F.regexp_extract(ahead, r"(?i)\b[0-9]{1,2}:[0-9]{2}\s*[AP]M\b", 0), F.lit(""))), D.clock(F.get(times, F.size(times) - 1)))


def local_context(text: Column, start: Column, radius: int = 220) -> Column:
    """A position's sentence with so many characters more on either side."""
    head = F.substring(text, F.lit(1), start)
    begin = F.length(head) - F.length(F.regexp_extract(head, r"(?s)((?:(?!\n[ \t]*\n)[^.!?;])*)$", 1))
    tail = F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"(?s)^((?:(?!\n[ \t]*\n)[^.!?;])*[.!?;]?)", 1)
    first = F.greatest(begin - radius, F.lit(0))
    return T.collapse(F.substring(text, first + 1, start + F.length(tail) + radius - first))


#: Labels of dates by rank; how a sentence ("s") or its context ("c") labels a date, the first rule that fits counts.
LABEL_RANK = {
    "public_hearing": 100, "public_meeting": 95, "municipal_council_event": 90, "planning_commission_event": 80, "public_comment_deadline": 75, "appeal_deadline": 70, "deadline": 65, "approval_event": 60,
    "decision_event": 55, "future_project_event": 40, "historical_denial": 30, "historical_event": 10,
}
LABEL_RULES = (
    ("deadline", "s", "day before|day-before|prior to|deadline|must be submitted before|comments must be submitted"), ("public_hearing", "s", "public hearing"), ("public_meeting", "s", "public meeting"),
    ("municipal_council_event", "s", "municipal council|city council"), ("planning_commission_event", "s", "planning commission"), ("public_comment_deadline", "s", "public comment"), ("approval_event", "s", "approval"), ("decision_event", "s", "decision"),
    ("deadline", "c", "day before|day-before|prior to"), ("public_hearing", "c", "public hearing"), ("public_meeting", "c", "public meeting"), ("municipal_council_event", "c", "municipal council|city council"),
    ("planning_commission_event", "c", "planning commission"), ("public_comment_deadline", "c", "public comment"), ("appeal_deadline", "c", "appeal.*deadline|deadline.*appeal"), ("deadline", "c", "deadline"),
    ("approval_event", "f", "approval"), ("decision_event", "f", "decision"), ("historical_denial", "s", "recommended denial|ultimately denied|was denied|denied by"), ("historical_denial", "p", "recommended denial|ultimately denied|was denied|denied by"),
)
TERMS = {
    "public hearing": 30, "public meeting": 26, "municipal council": 28, "city council": 26, "planning commission": 24, "public comment": 20, "appeal": 18, "deadline": 18, "will hold": 16, "will consider": 16,
    "scheduled": 14, "approval": 12, "decision": 12, "recommended denial": 20, "ultimately denied": 25, "denied by": 25,
}


def date_label(sentence: Column, context: Column, future: Column) -> Column:
    """The label of a date by its sentence, then its context; "f" and "p" rules look at the context of future and past dates alone."""
    s, c = F.lower(sentence), F.lower(context)
    tests = {"s": lambda p: s.rlike(p), "c": lambda p: c.rlike(f"(?s){p}"), "f": lambda p: c.rlike(p) & future, "p": lambda p: c.rlike(p) & ~future}
    return F.coalesce(*[F.when(tests[scope](p), label) for label, scope, p in LABEL_RULES], F.when(future, "future_project_event").otherwise("historical_event"))


def date_score(sentence: Column, context: Column, future: Column, label: Column) -> Column:
    """How much evidence a date has: terms in its sentence count double those of its context."""
    s, c = F.lower(sentence), F.lower(context)
    terms = sum((F.when(F.contains(s, F.lit(t)), 2 * w).when(F.contains(c, F.lit(t)), w).otherwise(0) for t, w in TERMS.items()), F.lit(0))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_RANK.items() for x in kv]), label), F.lit(0))
    return F.when(future, 20).otherwise(0) + terms + F.floor(rank / 10).cast("int")


def hit_relevance(number: Column, applicant_: Column, address_: Column, window: Column) -> Column:
    """How far a window concerns an application: its number .60, applicant .25, address .25, one at most."""
    key = T.match_key(window)
    beside = lambda c: F.coalesce(F.contains(key, F.nullif(T.match_key(c), F.lit(""))), F.lit(False))
    points = F.when(F.coalesce(F.contains(F.upper(window), F.upper(number)), F.lit(False)), 60).otherwise(0) + F.when(beside(applicant_), 25).otherwise(0) + F.when(beside(address_), 25).otherwise(0)
    return F.least(points, F.lit(100)) / 100


def hit_confidence(number: Column, applicant_: Column, address_: Column, window: Column) -> Column:
    key = T.match_key(window)
    beside = lambda c: F.coalesce(F.contains(key, F.nullif(T.match_key(c), F.lit(""))), F.lit(False))
    points = 45 + F.when(F.coalesce(F.contains(F.upper(window), F.upper(number)), F.lit(False)), 35).otherwise(0) + F.when(beside(applicant_), 15).otherwise(0) + F.when(beside(address_), 10).otherwise(0)
    return F.least(points, F.lit(99)) / 100


def file_name(url: Column) -> Column:
    """The file name of a url's path, ending in .pdf."""
    return safe_name(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""))


def safe_name(name: Column) -> Column:
    """A file name without its folders, ending in .pdf; "government_document.pdf" where none is left."""
    kept = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1), F.lit("")), F.lit("government_document"))
    return F.when(F.lower(kept).endswith(".pdf"), kept).otherwise(F.concat(kept, F.lit(".pdf")))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
