"""Evidence generators on rows written by hand, with nulls, empty tables and sources that fail."""

from pyspark.sql import functions as F

from quarry.functions import contact as C
from quarry.operators import investigation as I

RESULT = "app string, primary string, owner_name string, owner_entity string, applicant_name string, address string, neighborhood string, link string, title string, snippet string"


def result(app="A", primary="Acme Builders LLC", link="https://acme.test/x", title="", snippet="", address="12 Oak Street", name="Ann Smith"):
    return (app, primary, None, None, name, address, None, link, title, snippet)


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_web_results(spark):
    df = spark.createDataFrame([result(snippet="Mail Bob@Acme.test or x@city.gov, call (801) 555-0101"), result(link="https://m.facebook.com/a", snippet="bob@acme.test"), result(link=None, title=None, snippet=None)], RESULT)
    got = rows(I.web(df), "field", "value", "source_url", "confidence_score")
    assert got == {("email", "bob@acme.test", "https://acme.test/x", 0.55), ("phone", "8015550101", "https://acme.test/x", 0.5), ("website", "https://acme.test/x", "https://acme.test/x", 0.45), ("email", "bob@acme.test", "https://m.facebook.com/a", 0.55)}
    assert I.web(df.limit(0)).count() == 0


def test_kinds_of_sources(spark):
    df = spark.createDataFrame([result(link="https://www.yelp.com/a", title="Acme Builders", snippet="a registered corporation"), result(link="https://linkedin.com/in/x", title="Ann"), result(link="https://n.test", snippet="Acme at 12 Oak Street")], RESULT)
    assert rows(I.directories(df), "field", "value", "confidence_score") == {("business_listing", "Acme Builders LLC", 0.55)}
    assert rows(I.profiles(df), "field", "value") == {("linkedin_profile", "https://linkedin.com/in/x")}
    assert rows(I.public_records(df), "source_url") == {("https://www.yelp.com/a",)}
    assert rows(I.projects(df), "value", "source_url") == {("Acme Builders LLC -> 12 Oak Street", "https://n.test")}


def test_contact_source_stops_at_enough(spark):
    df = spark.createDataFrame([result("A", snippet="a@x.test"), result("B", snippet="b@x.test"), result("C", snippet="nothing")], RESULT)
    have = spark.createDataFrame([("A", "email"), ("A", "phone"), ("A", "website"), ("B", "email")], "app string, field string")
    found, status = I.contacts(df, have)
    assert rows(found, "app", "value") == {("B", "b@x.test")} and rows(status, "app", "status") == {("A", "ENRICHED"), ("B", "ENRICHED"), ("C", "NOT_FOUND")}


def test_roles_and_links(spark):
    html = '<p>Ann Smith <a href="/site">Visit</a></p><div><a href="https://other.test">x</a></div><p>Ann Smith <a href="https://maps.google.com/1">map</a><br><a>no</a></p>'
    text = "Ann Smith. Jane Doe, Architect. Owner: Ann Smith. Acme Builders LLC, Owner."
    cols = "app string, url string, html string, text string, applicant_name string, owner_entity string, address string, neighborhood string"
    p = spark.createDataFrame([("A", "https://p.test/a/b", html, text, "Ann Smith", "Acme", None, None), ("B", "https://q.test", None, None, None, None, None, None)], cols)
    assert rows(I.role_candidates(p), "name", "role", "same_person") == {("Jane Doe", "Architect", False), ("Ann Smith", "Owner", True)}
    assert rows(I.company_links(p, "public_web"), "app", "website") == {("A", "https://p.test/site")}
    assert [r["context"] for r in I.anchors(p).orderBy("ordinal").collect()] == ["Ann Smith Visit", "x", "Ann Smith map no"]


def test_resumed_run_isolates_what_fails(spark):
    leads = spark.createDataFrame([("A",), ("B",)], "app string")
    done = spark.createDataFrame([("A", "web", "ENRICHED")], "app string, source string, status string")
    df = spark.createDataFrame([result("A", snippet="a@x.test"), result("B", snippet="b@x.test")], RESULT)

    def broken(todo, found):
        raise ValueError("no")

    web = lambda todo, found: I.web(df.join(todo, "app", "left_semi"))
    seen = lambda todo, found: found.where("field = 'email'")
    found, states = I.run_sources(leads, done, {"web": web, "project": broken, "contact": seen})
    assert {r["app"] for r in found.collect()} == {"B"}
    assert rows(states, "app", "source", "status") == {("A", "web", "ENRICHED"), ("B", "web", "ENRICHED"), ("A", "project", "ERROR"), ("B", "project", "ERROR"), ("A", "contact", "NOT_FOUND"), ("B", "contact", "ENRICHED")}
    again, _ = I.run_sources(leads, done, {"web": web}, forced=("web",))
    assert {r["app"] for r in again.collect()} == {"A", "B"}
    assert rows(I.overall_status(states), "app", "status") == {("A", "PARTIAL"), ("B", "PARTIAL")}


def test_scores_of_addresses(spark):
    df = spark.createDataFrame([("ann@acme.test", "Ann Smith", "acme.test", "official_site"), ("info@gmail.com", None, None, None), ("x@example.com", "X Y", None, None), (None, None, None, None)], "e string, n string, h string, t string")
    got = [r[0] for r in df.select(C.email_score(F.col("e"), F.col("n"), F.col("h"), F.col("t"))).collect()]
    assert got == [0.9, 0.3, 0.0, 0.0]
    text = spark.createDataFrame([("Ann Smith of Acme Land at 12 Oak", "Ann Smith"), ("ann was here", "Ann Smith"), ("nobody", "Ann Smith"), (None, "Ann"), ("Ann", None)], "t string, n string")
    assert [r[0] for r in text.select(C.relevance(F.col("t"), F.col("n"), F.lit("12 Oak St"), None, F.lit("Acme Land"))).collect()] == [1.0, 0.15, 0.0, 0.0, 0.0]
