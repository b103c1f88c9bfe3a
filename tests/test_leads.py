"""Filters, merges and carried state on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import leads as L

LEAD = "application_number string, priority string, priority_score int, lead_status string, is_contactable boolean, application_type string, has_future_opportunity boolean, next_project_date date, friction_score int, commercial_readiness string, outreach_status string, approval_status string, created_at timestamp_ntz"


def lead(n, priority="HIGH", status=None, contactable=None, future=None, day=None, friction=None, created=None):
    return (n, priority, 10, status, contactable, "Variance", future, day, friction, None, None, None, created)


def numbers(df):
    return sorted(r["application_number"] for r in df.collect())


def test_filters(spark):
    df = spark.createDataFrame([lead("a", contactable=True, future=True, day=dt.date(2024, 1, 1), friction=3), lead("b", "LOW", "CONTACTABLE", created=dt.datetime(2024, 1, 1)), lead("c", None, "NO_CONTACT"), lead("d", status="ARCHIVED")], LEAD)
    assert numbers(L.filtered(df, L.Filters())) == ["a", "b", "c", "d"] and numbers(L.filtered(df, L.Filters(contactability="contactable"))) == ["a", "b"]
    assert numbers(L.filtered(df, L.Filters(contactability="needs_discovery"))) == ["c"] and numbers(L.filtered(df, L.Filters(upcoming=True))) == ["a"]
    assert numbers(L.filtered(df, L.Filters(friction=False))) == ["b", "c", "d"] and numbers(L.filtered(df, L.Filters(recent=True), F.lit("2024-01-31").cast("timestamp_ntz"))) == ["b"]
    assert numbers(L.served(df, [F.col("application_number")], 1, priority="high")) == ["a"] and numbers(L.served(df, [F.col("application_number")], -1)) == []
    with pytest.raises(ValueError):
        L.filtered(df, L.Filters(recent=True))
    assert numbers(L.lookup(df, " B ")) == ["b"] and L.lookup(df, "zz").count() == 0 and numbers(L.lookup(df.limit(0), "c", "application_number", df)) == ["c"]
    assert L.stats(df.limit(0).withColumns({"owner_name": F.lit(None).cast("string"), "owner_entity": F.lit(None).cast("string"), "estimated_value_mid": F.lit(1.0), "public_spend_mid": F.lit(1.0)})).first()["total"] == 0


def test_merges(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("l", 2, None), (None, 3, "z")], "key string, n int, s string")
    b = spark.createDataFrame([("k", None, True)], "key string, n int, extra boolean")
    assert {tuple(r) for r in L.later_wins(a, b, "key").collect()} == {("k", None, "x", True), ("l", 2, None, None), (None, 3, "z", None)}
    assert {tuple(r) for r in L.fill_nulls(a, spark.createDataFrame([("l", "w"), ("k", "v")], "key string, s string"), "key", ["s"]).collect()} == {("k", 1, "x"), ("l", 2, "w"), (None, 3, "z")}
    parties = "a array<struct<party_name:string,party_role:string>>, b array<struct<party_name:string,party_role:string>>"
    df = spark.createDataFrame([([("Ann", "Owner")], [("Ann", "Owner"), ("Ann", None), ("Ann", None), ("Bob", "Engineer of record")])], parties)
    j = df.select(L.joined_parties(F.col("a"), F.col("b")).alias("p"))
    assert [tuple(p) for p in j.first()["p"]] == [("Ann", "Owner"), ("Ann", None), ("Bob", "Engineer of record")]
    assert j.select(L.party_of(F.col("p"), "engineer")["party_name"], F.size(L.other_parties(F.col("p"), "engineer"))).first()[:] == ("Bob", 2)


def test_state_is_frozen_from_contact_on(spark):
    states = [("CONTACTED", "NEW"), ("READY", "NEW"), ("nonsense", "READY"), (None, "QUALIFIED")]
    df = spark.createDataFrame(states, "p string, n string")
    known = ("NEW", "QUALIFIED", "READY", "CONTACTED", "WON")
    assert [r[0] for r in df.select(L.carried_status(F.col("p"), F.col("n"), ("NEW", "QUALIFIED", "READY"), known)).collect()] == ["CONTACTED", "NEW", "READY", "QUALIFIED"]


def test_stages_and_providers(spark):
    df = spark.createDataFrame([("hello",)], "prompt string")
    assert L.TextProviders().generate(df, "none").first()["output"] == "hello"

    def broken(p):
        raise RuntimeError("down")

    assert "down" in L.TextProviders(x=broken).generate(df, "x").first()["output"]
    with pytest.raises(KeyError):
        L.Stages().run(df, "missing")


def test_values_and_dates(spark):
    df = spark.createDataFrame([(" 12.7 ", "Yes", " a "), ("x", "no", ""), (None, None, None)], "n string, b string, l string")
    assert [tuple(r) for r in df.select(L.to_int(F.col("n")), L.to_bool(F.col("b")), F.size(L.to_list(F.col("l")))).collect()] == [(12, True, 1), (None, False, 0), (None, None, 0)]
    d = spark.createDataFrame([([(dt.date(2024, 1, 1), "x", False), (dt.date(2025, 1, 1), "deadline", True), (dt.date(2024, 9, 1), "y", True)],)], "d array<struct<day:date,label:string,is_future:boolean>>")
    r = d.select(L.ordered_dates(F.col("d")).alias("o"), L.future_dates(F.col("d")).alias("f"), L.historical_dates(F.col("d")).alias("h")).first()
    assert [x["label"] for x in r["o"]] == ["y", "deadline", "x"] and [x["label"] for x in r["f"]] == ["y"] and [x["label"] for x in r["h"]] == ["x"]
    assert L.canonical(spark.createDataFrame([("n", None)], "applicant_name string, address string"), F.lit("2024-01-01").cast("date")).first()["priority"] == "ARCHIVED"
