"""Readers of packet tables and dates on texts written by hand."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import extract as X

TABLE = """Case PLRZ20230001
Property Owner:
HERON FIELD HOLDINGS LLC,
c/o Ida Marsh

Owner Contact: Paul Ferrow | PF@quill.test, (801) 555-0101
Applicant of Record: Kestrel Design
Engineer of Record: Nell Otway, P.E. | nell@kestrel.test
Zoning: R-1
SECTION 1
Property Owner: Somebody Else
"""


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(X.region(F.col("t")).alias("r"), "t").select(*cols).first()


def test_tables_of_labels(spark):
    r = one(spark, TABLE, X.owner(F.col("r")).alias("o"), X.parties(F.col("r")).alias("p"), X.applicant_of_record(F.col("r")).alias("a"), X.property_details(F.col("r")).alias("d"))
    assert (r["o"]["owner_entity"], r["o"]["contact_name"], r["o"]["contact_email"], r["o"]["contact_phone"], r["o"]["owner_type"]) == ("HERON FIELD HOLDINGS LLC", "Paul Ferrow", "pf@quill.test", "8015550101", "Entity")
    assert [(p["party_name"], p["party_role"]) for p in r["p"]] == [("Nell Otway, P.E.", "Engineer")] and r["a"]["entity"] == "Kestrel Design" and r["d"]["zoning"] == "R-1"
    for text in ("", "nothing here", None):
        r = one(spark, text, X.owner(F.col("r")).alias("o"), X.parties(F.col("r")).alias("p"))
        assert r["o"]["owner_name"] is None and r["o"]["owner_type"] is None and not r["p"]


def test_reports_end_where_the_next_number_begins(spark):
    text = "PLRZ20230001\nAPPLICANT\nProperty Owner: Ann\nPLRZ20230001 again\nPLSUB20240002\nAPPLICANT\nApplicant of Record: Bob\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["number"]: (r["owner"]["owner_name"], r["applicant"]["entity"]) for r in X.report_identity(df).collect()}
    assert got == {"PLRZ20230001": ("Ann", None), "PLSUB20240002": (None, "Bob")}


def test_days_of_decisions(spark):
    text = "was recommended denial by the Planning Commission on November 12, 2025, and ultimately denied by the Municipal Council on December 2, 2025."
    r = one(spark, text, X.event_date(F.lit("recommended_denial"), F.col("t")), X.event_date(F.lit("denied"), F.col("t")), X.event_date(F.lit("appeal"), F.col("t")))
    assert list(r) == [dt.date(2025, 11, 12), dt.date(2025, 12, 2), None]
    assert one(spark, "An appeal of May 1, 2024.", X.event_date(F.lit("appeal"), F.col("t")))[0] == dt.date(2024, 5, 1)


def test_times_beside_a_date(spark):
    text = "At 5:00 PM staff met. August 12, 2026 at 6:30 pm"
    at = text.index("August")
    assert one(spark, text, X.near_time(F.col("t"), F.lit(at), F.lit(15)))[0] == "6:30 PM"
    assert one(spark, text[: at + 15], X.near_time(F.col("t"), F.lit(at), F.lit(15)))[0] == "5:00 PM"
    assert one(spark, "none", X.near_time(F.col("t"), F.lit(0), F.lit(4)))[0] is None


def test_addresses_and_types(spark):
    block = "Marta Quill requests approval of a Concept Plan located at 113/191 N Hollow Road. Linden Park Neighborhood. PLCP20250001"
    c = F.col("t")
    r = one(spark, block, X.address(c), X.applicant(c), X.application_type(c), X.neighborhood(c), X.application_number(c), X.description(c))
    assert list(r) == ["113/191 N Hollow Road", "Marta Quill", "Concept Plan", "Linden Park", "PLCP20250001", "approval of a Concept Plan located at 113/191 N Hollow Road. Linden Park Neighborhood."]
    assert list(one(spark, None, X.address(c), X.applicant(c), X.application_type(c))) == [None, None, None]


def test_file_names(spark):
    names = ["https://a.test/x/y.PDF?q=1", "https://a.test/view/12", "https://a.test/", "https://a.test", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(X.file_name(F.col("t"))).collect()]
    assert got == ["y.PDF", "12.pdf", "government_document.pdf", "government_document.pdf", "government_document.pdf"]
