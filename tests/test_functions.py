from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_positions_are_where_the_hits_stand(spark):
    text = "ab12 x 7\ncd345"
    got = value(spark, T.positions(F.col("t"), "[0-9]+"), t=text)
    assert [(g["start"], g["hit"]) for g in got] == [(2, "12"), (7, "7"), (11, "345")]
    assert value(spark, T.positions(F.col("t"), "[0-9]+"), t="none") == []
    assert spark.sql("select cast(null as string) t").select(T.positions(F.col("t"), "x").alias("v")).first()["v"] is None


def test_window_is_cut_at_the_ends(spark):
    assert value(spark, T.window_around(F.col("t"), F.lit(2), F.lit(2), 10, 3), t="abcdefgh") == "abcdefg"


def test_sentence_bounds(spark):
    text = "One. Two is here; three\n\nfour"
    assert value(spark, T.sentence_at(F.col("t"), F.lit(6)), t=text) == "Two is here;"
    assert value(spark, T.sentence_at(F.col("t"), F.lit(len(text) - 2)), t=text) == "four"


def test_keys(spark):
    assert value(spark, T.record_key(F.col("t")), t="  pl1 ") == "PL1"
    assert value(spark, T.record_key(F.col("t")), t="   ") is None
    assert value(spark, T.slug(F.col("a"), F.col("b")), a=" ", b="Big & Bold, Inc.") == "big-bold-inc"
    assert value(spark, T.unique_ignoring_case(F.array(*[F.lit(x) for x in ("A", "b", "a", " ", "B", "c")]))) == ["A", "b", "c"]


def test_contacts(spark):
    t = "Mail Info@Site.example or bob@x.co; call (801) 555-0101, 801.555.0101 or +1 802 555 0199."
    assert value(spark, T.emails(F.col("t")), t=t) == ["info@site.example", "bob@x.co"]
    assert value(spark, T.phones(F.col("t")), t=t) == ["8015550101", "8025550199"]
    assert value(spark, T.is_generic(F.col("t")), t="info@site.example") is True
    assert value(spark, T.host(F.col("t")), t="HTTPS://www.Site.example:80/a?b") == "site.example"
    assert value(spark, T.normal_url(F.col("t")), t="HTTP://Site.example/a/#x") == "http://site.example/a"


def test_markup(spark):
    assert value(spark, T.without_markup(F.col("t")), t="<p>A&amp;B <script>x()</script><b>c</b></p>") == "A&B c"


def test_section_stops_at_the_earliest_end(spark):
    assert value(spark, T.section(F.col("t"), "Hearings", "END", "Adjourn"), t="x Hearings one Adjourn two END") == "Hearings one "
    assert value(spark, T.section(F.col("t"), "Hearings", "END"), t="nothing") is None


def test_dates_in_every_form(spark):
    for text, day in (("March 5, 2024", "2024-03-05"), ("3/5/2024", "2024-03-05"), ("2024-03-05T10:00:00+00:00", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("February 30, 2024", None), ("soon", None), ("", None)):
        got = value(spark, D.parse_date(F.col("t")), t=text)
        assert (str(got) if got else None) == day, text


def test_future_is_strict_and_scrub_is_not(spark):
    ref = F.lit("2026-08-01").cast("date")
    for text, future, kept in (("2026-07-31", False, None), ("2026-08-01", False, "2026-08-01"), ("2026-08-02", True, "2026-08-02")):
        assert value(spark, D.is_future(F.to_date("t"), ref), t=text) is future
        assert value(spark, D.only_future(F.to_date("t"), ref).cast("string"), t=text) == kept
    assert value(spark, D.url_date(F.col("t")), t="https://x.example/a_08122026-final.pdf").isoformat() == "2026-08-12"
    assert value(spark, D.clock(F.col("t")), t="at 6 p.m. or so") == "6:00 PM"
