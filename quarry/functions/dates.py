"""Column functions over dates written in several forms. A reference date is always a parameter, never today."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions.text import collapse

MONTH = "(?:" + "|".join(K.MONTHS) + ")"
#: Dates as they stand in running text.
MENTION = rf"{MONTH} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"


def parse_date(c: Column) -> Column:
    """A date from "March 5, 2024", "3/5/2024", "5 Mar 2024", "2024-03-05" or a timestamp; null for anything else and impossible days."""
    t = collapse(c)
    return F.coalesce(
        F.try_to_date(F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left(t, F.lit(10))), "yyyy-MM-dd"),
        F.try_to_date(F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), t), "M/d/yyyy"),
        F.try_to_date(F.when(t.rlike(r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}$"), t), "MMMM d, yyyy"),
        F.try_to_date(F.when(t.rlike(r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$"), t), "MMM d, yyyy"),
        F.try_to_date(F.when(t.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$"), t), "d MMM yyyy"),
    )


def iso_or_raw(c: Column) -> Column:
    """The ISO form of a date, or the text as it stands."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c)


def days_until(d: Column, reference: Column) -> Column:
    return F.datediff(d, reference).cast("bigint")


def is_future(d: Column, reference: Column) -> Column:
    """Strictly after the reference date; false for null."""
    return F.coalesce(d > reference, F.lit(False))


def only_future(d: Column, reference: Column) -> Column:
    """The date unless it has passed."""
    return F.when(d >= reference, d)


def url_date(url: Column) -> Column:
    """The date of a _MMDDYYYY- token in a file's name."""
    token = F.regexp_extract(url, r"_([0-9]{8})-", 1)
    return F.try_to_date(F.nullif(token, F.lit("")), "MMddyyyy")


def mentions(c: Column) -> Column:
    """All dates that a text mentions, parsed, distinct, in order; impossible ones are dropped."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(MENTION), F.lit(0)), parse_date), lambda d: d.isNotNull()))


def clock(c: Column) -> Column:
    """The first time of day as "H:MM AM"; null where there is none."""
    hit = F.regexp_extract(c, r"(?i)\b([0-9]{1,2}(?::[0-9]{2})?) ?([ap])\.?m\b", 0)
    h, m = F.regexp_extract(hit, r"^([0-9]{1,2})", 1), F.regexp_extract(hit, r":([0-9]{2})", 1)
    half = F.when(F.lower(hit).rlike("p\\.?m$"), "PM").otherwise("AM")
    return F.when(hit != "", F.concat(h, F.lit(":"), F.coalesce(F.nullif(m, F.lit("")), F.lit("00")), F.lit(" "), half))
