"""Column functions over text: built-ins only, so they stay inside generated code. Null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as K


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column) -> Column:
    """Runs of white space and NUL as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x00]+", " "))


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null for blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_stated(*cs: Column) -> Column:
    """The first of several aliases that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def record_key(c: Column) -> Column:
    """A natural key: trimmed, upper case, null for blank."""
    return blank_to_null(F.upper(c))


def match_key(c: Column) -> Column:
    """Lower case with every run of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def slug(*cs: Column) -> Column:
    """A slug of the first stated alias."""
    return F.regexp_replace(F.lower(F.regexp_replace(first_stated(*cs), r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def unique(a: Column) -> Column:
    """Distinct elements in their first order."""
    return F.array_distinct(a)


def unique_ignoring_case(a: Column) -> Column:
    """The first writing of every element, compared without case; order kept, nulls and blanks dropped."""
    return F.aggregate(
        F.filter(a, lambda x: F.trim(x) != ""),
        F.array().cast("array<string>"),
        lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x))),
    )


def emails(c: Column) -> Column:
    """E-mail addresses in lower case, distinct, in order."""
    return unique(F.transform(all_matches(c, K.EMAIL), F.lower))


def mailbox(email: Column) -> Column:
    return F.split_part(F.lower(email), F.lit("@"), F.lit(1))


def is_generic(email: Column) -> Column:
    """Whether an address is a role's rather than a person's."""
    return mailbox(email).isin(*K.GENERIC_MAILBOXES)


def phone_digits(c: Column) -> Column:
    """The ten national digits of a phone number, null when it has fewer."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def phones(c: Column) -> Column:
    """Phone numbers as ten digits, distinct, in order."""
    return unique(F.transform(all_matches(c, K.PHONE), phone_digits))


def host(url: Column) -> Column:
    """The host of a URL in lower case without www and port."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", ""), F.lit(""))


def root_domain(host_: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host_, r"([^.]+\.[^.]+)$", 1)


def normal_url(url: Column) -> Column:
    """A URL without case in its host, fragment and trailing slash, for comparing."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.concat(F.lower(head), F.regexp_replace(F.regexp_replace(rest, r"#.*$", ""), r"/+$", ""))


def hosted_by(host_: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or lies below one."""
    below = host_.isin(*domains)
    for d in domains:
        below = below | host_.endswith("." + d)
    return F.coalesce(below, F.lit(False))


def positions(c: Column, pattern: str) -> Column:
    """Array of (start, hit) of all matches of a pattern, start 0-based: lengths of the pieces between are summed up."""
    hits = all_matches(c, pattern)
    gaps = F.transform(F.split(c, pattern), F.length)
    return F.transform(
        hits,
        lambda h, i: F.struct(
            (F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))).alias("start"),
            h.alias("hit"),
        ),
    )


def window_around(c: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The text around a match given by its 0-based start and length."""
    at = F.greatest(start - before, F.lit(0))
    return F.substring(c, at + 1, start + length + after - at)


def sentence_at(c: Column, start: Column) -> Column:
    """The sentence in which a 0-based position lies; sentences end at . ! ? ; or an empty line."""
    head = F.regexp_extract(F.substring(c, F.lit(1), start), r"(?s)((?:(?!\n\n)[^.!?;])*)$", 1)
    tail = F.regexp_extract(F.substring(c, start + 1, F.length(c)), r"(?s)^((?:(?!\n\n)[^.!?;])*[.!?;]?)", 1)
    return collapse(F.concat(head, tail))


def labelled(c: Column, label: str) -> Column:
    """The value behind "Label:" on a line of its own; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^[ \t]*{label}[ \t]*:[ \t]*(.*)$", 1)), F.lit(""))


def section(c: Column, begins: str, *ends: str, longest: int = 30_000) -> Column:
    """The text from a heading to the earliest of several end markers, or as long as allowed."""
    at = F.locate(begins, c)
    rest = F.substring(c, at, F.lit(longest))
    cuts = [F.nullif(F.locate(e, rest), F.lit(0)) for e in ends]
    stop = F.least(*cuts, F.length(rest) + 1) if len(cuts) else F.length(rest) + 1
    return F.when(at > 0, F.substring(rest, F.lit(1), stop - 1))


def words(c: Column, longer_than: int = 2) -> Column:
    """Distinct words of a match key longer than so many letters."""
    return F.array_distinct(F.filter(F.split(match_key(c), " "), lambda w: F.length(w) > longer_than))


def overlap(part: Column, whole: Column) -> Column:
    """The share of the words of part that whole has; null where part has none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def is_person_shaped(c: Column) -> Column:
    """Two to four capitalised words or initials and nothing else."""
    ws = F.split(F.trim(c), " +")
    return F.coalesce(F.size(ws).between(2, 4) & F.forall(ws, lambda w: w.rlike(r"^[A-Z](?:[a-z'’-]+|\.)$")), F.lit(False))


def is_company_shaped(c: Column) -> Column:
    """A legal form, an ampersand between names, or a word of business at the end."""
    return F.coalesce(c.rlike(r"(?i)\b(?:llc|l\.l\.c|inc|corp|corporation|company|lp|ltd|trust)\b|[a-z] & [A-Z]|\b(?:builders|holdings|homes|partners|properties|realty)$"), F.lit(False))


def without_markup(c: Column) -> Column:
    """The text of a page of markup."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapse(bare)


def money(c: Column) -> Column:
    """$1.2M, $34K or $560."""
    return F.when(c >= 1_000_000, F.concat(F.lit("$"), F.format_number(c / 1_000_000, 1), F.lit("M"))).when(c >= 1_000, F.concat(F.lit("$"), F.format_number(c / 1_000, 0), F.lit("K"))).when(c.isNotNull(), F.concat(F.lit("$"), F.format_number(c, 0)))


def currency(c: Column) -> Column:
    """An abbreviated amount: $2M, $1.5M, $34K, $560, $0; a dash for null. Halves are rounded up."""
    whole = lambda x: F.format_number(x, 0)
    millions = F.when(c % 1_000_000 == 0, whole(c / 1_000_000)).otherwise(F.format_number(c / 1_000_000, 1))
    return F.when(c >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M"))).when(c >= 1_000, F.concat(F.lit("$"), whole(c / 1_000), F.lit("K"))).when(c.isNotNull(), F.concat(F.lit("$"), whole(c))).otherwise("—")


def currency_range(low: Column, high: Column) -> Column:
    """Two amounts with a dash between; one where they are equal, a dash where either is missing."""
    return F.when(low.isNull() | high.isNull(), "—").when(low == high, currency(low)).otherwise(F.concat(currency(low), F.lit(" – "), currency(high)))


def days_text(days: Column) -> Column:
    return F.when(days.isNull(), "—").when(days == 0, "Today").when(days == 1, "Tomorrow").when(days < 0, F.concat(F.abs(days).cast("string"), F.lit("d ago"))).otherwise(F.concat(F.lit("In "), days.cast("string"), F.lit("d")))


def title_case(c: Column) -> Column:
    """Words parted by blanks or underscores, each with a capital first; a dash for null and blank."""
    words = F.filter(F.split(c, r"[_\s]+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " "), F.lit("")), F.lit("—"))


def hosted_by_column(host_: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies below it, where the domain is a column too."""
    return F.coalesce((host_ == domain) | F.endswith(host_, F.concat(F.lit("."), domain)), F.lit(False))
