import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import name_variants as V
from quarry.llm import names as N

ROWS = "id long, name string, place string, company string"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Clay Cross Tailrace Mgmt, L.L.C.", "Claycross Tailrace Management LLC", True),
        ("Contractors, Shalerise Grouse", "Shalerise Grouse Contractors Inc", True),
        ("Yarangham & Heskellvane Associates LLC", "Heskellvane-Yarangham Assoc. Llc", True),
        ("Bob Dunostridge", "DUNOSTRIDGE, ROBERT J", True),
        ("Vincent Mesklelwell", "Vincent Meskellwell", True),
        ("Vincent Meskellwell", "Theodore Meskellwell", False),
        ("Claycross Tailrace", "Claycross Wren", False),
    ],
)
def test_alignment(a, b, same):
    x, y = N.parse(a), N.parse(b)
    assert N.aligned(x["core"], y["core"]) is same


def test_fillers_and_nulls():
    for f in (None, "", "  ", "N/A", "TBD", "See application", "-", "Various owners", "unknown"):
        assert N.parse(f) is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_parse_takes_any_text(t):
    r = N.parse(t)
    assert r is None or r["core"]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_is_symmetric_and_bounded(a, b):
    d = N.osa(a, b, 2)
    assert d == N.osa(b, a, 2) and (d == 0) == (a == b) and d <= 3


def pairs(spark, rows):
    return {(r["left_id"], r["right_id"]) for r in V.found(spark.createDataFrame(rows, ROWS)).collect()}


def test_links(spark):
    rows = [
        (1, "Claycross Tailrace Management LLC", "Saltmere", None), (2, "Clay Cross Tailrace Mgmt", None, None), (3, "claycross tailrace", None, None),
        (4, "Claycross Tailrace Bakery", None, None), (5, "Robert Delilvrand", "Ostley", None), (6, "R. Delilvrand", "Ostley", None), (7, "Rebecca Delilvrand", "Tarnwick", None),
        (8, "N/A", None, None), (9, None, None, None), (10, "Robert Delilvrand", "Ostley", None), (10, "Robert Delilvrand", "Ostley", None), (11, "", None, None),
    ]
    got = pairs(spark, rows)
    assert (1, 2) in got and (5, 6) in got and (6, 10) in got
    assert (5, 10) not in got, "equal as stored"
    assert not any(7 in p for p in got) and not any({8, 9, 11} & set(p) for p in got)
    assert (1, 4) not in got and all(a < b for a, b in got)


def test_empty(spark):
    assert V.found(spark.createDataFrame([], ROWS)).count() == 0


def test_short_and_long_names_meet(spark):
    long = "Grace Harvest Mission Fellowship of Upper Stone Valley Ridge"
    rows = [(1, "Acme Builders LLC", None, None), (2, "ACME BUILDERS, L.L.C.", None, None), (3, "An Li", None, None), (4, "AN LI", None, None), (5, long, None, None), (6, long.replace("Harvest", "Harvset"), None, None), (7, "Acne Builders LLC", None, None)]
    got = {(r["left_id"], r["right_id"]) for r in V.found(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {(1, 2), (3, 4), (5, 6)}
    parsed = V.signatures(V.parse_names(spark.createDataFrame([("Acme Builders LLC",), ("Acme Builders",)], "name string"))).drop("name")
    keys = {r["key"] for r in V.name_keys(parsed, V.word_candidates(parsed)).collect()}
    assert keys == {"acme"}
    assert N.aligned(["acme"], ["acme"]) and not N.aligned(["acme"], ["acne"])
    words = long.lower().split()
    assert N.aligned(words, words[::-1]) and not N.aligned(words, [*words[:-1], "quarry"])


def test_short_firm_is_matched(spark):
    from quarry.llm import entity_match as M

    leads = spark.createDataFrame([(1, "Acme Builders LLC", None, None), (2, "An Li", None, None), (3, "Zed Rolling Stock Homes LLC", None, None)], ROWS)
    findings = spark.createDataFrame([(10, None, "Acme Builders LLC", None), (20, "An Li", None, None)], "match_id long, name string, company string, place string")
    assert {(r["lead_id"], r["match_id"]) for r in M.matches(leads, findings).collect()} == {(1, 10), (2, 20)}
