import pytest
from pyspark.sql import functions as F

from quarry.operators import evidence as E
from quarry.operators import lifecycle as L
from quarry.operators import rows as R
from quarry.operators import signals as S
from quarry.operators.components import connected_components


def test_first_and_last_wins_with_ties_and_keyless_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "n int, k string")
    assert sorted(r["n"] for r in R.first_wins(df, F.col("k"), F.col("n")).collect()) == [1, 3, 4, 5]
    assert sorted(r["n"] for r in R.last_wins(df, F.col("k"), F.col("n"), keep_keyless=False).collect()) == [2, 5]
    assert R.first_wins(df.limit(0), F.col("k"), F.col("n")).count() == 0
    assert sorted(r["n"] for r in R.first_wins(df.repartition(3), F.col("k"), F.col("n")).collect()) == [1, 3, 4, 5]


def test_overlay_and_upsert(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, t string")
    over = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "k string, n int, t string")
    got = {r["k"]: (r["n"], r["t"]) for r in R.overlay(base, over, "k", ["n", "t"]).collect()}
    assert got == {"a": (1, None), "b": (2, "y"), "c": (3, None)}
    changes = spark.createDataFrame([("b", 7, "z"), (None, 9, "lost"), ("b", 8, "w")], "k string, n int, t string")
    up = {r["k"]: r["n"] for r in R.upsert(base, changes, "k", F.col("n")).collect()}
    assert up == {"a": 1, "b": 8}


def test_versions_go_on(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, at int")
    first = R.numbered_versions(None, new, "k", F.col("at"))
    more = R.numbered_versions(first, new.where("k = 'a'"), "k", F.col("at"))
    assert sorted(r["version"] for r in more.collect()) == [3, 4]


def test_next_other_skips_equal_neighbours(spark):
    df = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, "y"), ("u", 4, "x")], "k string, at int, what string")
    got = {r["at"]: r["next_other_at"] for r in R.next_other(df, ["k"], ["at"], "what", "at").collect()}
    assert got == {1: 3, 2: 3, 3: 4, 4: None}


def test_zero_fill_and_checks(spark):
    counts = spark.createDataFrame([("HIGH", 2)], "p string, n long")
    assert {r["p"]: r["n"] for r in R.zero_filled(counts, "p", "n", ["HIGH", "LOW"]).collect()} == {"HIGH": 2, "LOW": 0}
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, t string")
    assert [r["errors"] for r in R.checked(df, t=F.col("t") == "x").orderBy("n").collect()] == [["t"], []]


@pytest.mark.parametrize(
    ("events", "score"),
    [
        ([("denied", 0.80)], 48),
        ([("denied", 0.80), ("denied", 0.75)], 48),
        ([("denied", 0.80), ("recommended_denial", 0.80)], 100),
        ([("continued", 0.99)], 20),
        ([("denied", 0.55), ("continued", 0.99)], 63),
        ([("appeal", 0.70)], 24),
        ([("staff_concern", 0.75)], 22),
    ],
)
def test_scores_by_hand(spark, events, score):
    df = spark.createDataFrame([("k", *e) for e in events], "k string, kind string, c double")
    assert S.score_by_key(df, ["k"], "kind", F.col("c")).first()["score"] == score


@pytest.mark.parametrize(
    ("friction", "future", "days", "acts", "critical", "score", "level"),
    [
        (100, True, 11, True, True, 180, "HIGH"), (0, False, None, True, False, 15, "ARCHIVED"), (0, True, 31, False, False, 35, "LOW"), (0, True, 30, False, False, 45, "MEDIUM"),
        (20, True, 7, False, False, 80, "HIGH"), (19, True, 7, False, False, 79, "MEDIUM"), (69, True, 91, True, False, 109, "MEDIUM"), (70, True, 91, True, False, 110, "HIGH"), (0, True, None, True, True, 60, "HIGH"),
    ],
)
def test_queue_levels_by_hand(spark, friction, future, days, acts, critical, score, level):
    asks = (F.lit(friction), F.lit(future), F.lit(acts), F.lit(days).cast("int"), F.lit(critical))
    row = spark.range(1).select(S.queue_score(*asks).alias("s"), S.queue_level(*asks).alias("l")).first()
    assert (row["s"], row["l"]) == (score, level)


def test_queue_orders_differ_in_their_ties(spark):
    df = spark.createDataFrame([("a", "HIGH", 180, 50, 11, "2026-08-12"), ("b", "HIGH", 180, 90, 40, "2026-09-10"), ("c", "MEDIUM", 200, 0, 1, None), ("d", "?", 999, 0, 1, None)], "k string, p string, s int, f int, d int, n string")
    c = F.col
    assert [r["k"] for r in df.orderBy(*S.queue_order(c("p"), c("s"), c("f"), c("d"))).collect()] == ["b", "a", "c", "d"]
    assert [r["k"] for r in df.orderBy(*S.queue_order_by_date(c("p"), c("s"), c("n"))).collect()] == ["a", "b", "c", "d"]


def test_fold_equals_step_by_step(spark):
    runs = {1: ["sent", "prepared"], 2: ["won", "lost"], 3: ["lost", "won"], 4: ["engaged", "sent"], 5: [], 6: ["bogus"], 7: ["won", "engaged", "lost", "response"]}
    rows = [(k, i, e) for k, es in runs.items() for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "k int, at int, event string")
    got = {r["k"]: r["state"] for r in L.fold_states(df, "k", ["at"], "event").collect()}
    logged = {r["k"]: (r["state"], len(r["log"])) for r in L.history(df, "k", ["at"], "event").collect()}
    for k, es in runs.items():
        state = "NEW"
        for e in es:
            state = L.after(state, e)
        if es:
            assert got[k] == state and logged[k] == (state, len(es)), k
    assert got[1] == "CONTACTED" and got[2] == "LOST" and got[3] == "WON"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)], "src int, dst int")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert connected_components(edges.limit(0)).count() == 0


def test_chain_of_components(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    assert connected_components(edges).select("component").distinct().count() == 1


def test_candidates_and_scopes(spark):
    texts = spark.createDataFrame([(1, "government_record", "info@a.example and (801) 555-0101"), (2, None, None)], "id int, source_type string, text string")
    got = {(r["kind"], r["value"]): r["confidence"] for r in E.contact_candidates(texts).collect()}
    assert got == {("email", "info@a.example"): 0.7, ("phone", "8015550101"): 0.95}
    blocks = E.item_blocks(spark.createDataFrame([(1, "x ITEM 1 aa ITEM 2 b")], "doc_id int, text string"), "doc_id", "text", "ITEM [0-9]")
    assert [(r["item"], r["start"], r["end"]) for r in blocks.orderBy("item").collect()] == [(1, 2, 12), (2, 12, 20)]
    events = spark.createDataFrame([(1, 0), (1, 5), (1, 13), (2, 1)], "doc_id int, at int")
    assert sorted((r["doc_id"], r["at"], r["item"]) for r in E.scoped(events, blocks, "doc_id", "at").fillna(0).collect()) == [(1, 0, 0), (1, 5, 1), (1, 13, 2), (2, 1, 0)]


def test_split_join_and_numbering(spark):
    from quarry.operators import rows as R

    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 100), (None, 101)], "k string, x long")
    right = spark.createDataFrame([("hot", i) for i in range(7)] + [("cold", 8), ("other", 9)], "k string, y long")
    got = sorted(map(tuple, R.split_join(left, right, "k", rows=4).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect())) and len(got) == 351
    n = R.numbered(left.repartition(3), ["k"], ["x"], "n").orderBy("k", "x").collect()
    assert [r["n"] for r in n if r["k"] == "hot"] == list(range(1, 51)) and [r["n"] for r in n if r["k"] is None] == [1]
    up = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.7), ("a", 4, None), ("b", 1, None), ("b", 2, None), ("b", 3, 0.1)], "k string, i int, v double")
    assert sorted((r["k"], r["i"]) for r in R.rising(up, ["k"], ["i"], "v").collect()) == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
