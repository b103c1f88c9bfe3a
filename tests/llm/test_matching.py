import numpy as np
from pyspark.sql import functions as F

from quarry.llm import addresses as A
from quarry.llm import entity_match as M
from quarry.llm import survivors as S

CITIES = {"ostley": "ostley", "cold ferry": "cold ferry", "00471": "cold ferry"}
STATES = {"tk", "tamarack"}


def parsed(a, p=None):
    return A.parse(a, p, CITIES, STATES)


def test_addresses_are_read():
    a = parsed("2100 West 55th St., Cold Ferry, TK 00471")
    b = parsed("2100 W Fifty-Fifth Str", "Cold Ferry")
    assert a == b and a["number"] == "2100" and a["street"] == "55"
    assert parsed("Cold Ferry, TK - 488 S. OXMING ROAD #3")["street"] == "oxming"
    assert parsed("Vacant lot at 394 Limeell Str; COLD FERRY 00471")["number"] == "394"
    assert parsed("SW corner of Night Lane and Bull Court, Ostley")["corner"] == "sw"
    assert {k: parsed("Night Ln & Bull Ct, SW corner", "Ostley")[k] for k in ("street", "other")} == {"street": "bull", "other": "night"}
    for f in (None, "", "TBD", "Citywide", "-", "See attached map"):
        assert parsed(f) is None


ADDR = "id long, addr string, place string"


def test_site_links(spark):
    rows = [
        (1, "12 N Oakport Blvd, Ostley", "Ostley"), (2, "12 North Oakprot Boulevard Apt 2", "Ostley"), (3, "12 Oakport", "Ostley"), (4, "12 N Oakport Street", "Ostley"), (5, "14 N Oakport Blvd", "Ostley"),
        (6, "12 N Oakport Blvd", "Cold Ferry"), (7, "TBD", "Ostley"), (8, None, "Ostley"), (9, "12 N Oakport Blvd, Ostley", "Ostley"), (9, "12 N Oakport Blvd, Ostley", "Ostley"), (10, "", None),
    ]
    got = {(r["left_id"], r["right_id"]) for r in A.found(spark.createDataFrame(rows, ADDR)).collect()}
    assert {(1, 2), (1, 3), (1, 9), (2, 3), (2, 9)} <= got
    assert not any(p in got for p in ((1, 4), (1, 5), (1, 6), (5, 9))) and not any({7, 8, 10} & set(p) for p in got)
    assert A.found(spark.createDataFrame([], ADDR)).count() == 0


def test_deletion_keys_meet_for_every_single_edit():
    base = "hawkhall"
    edits = [base[:i] + base[i + 1 :] for i in range(len(base))] + [base[:i] + "x" + base[i:] for i in range(9)] + [base[:i] + base[i + 1] + base[i] + base[i + 2 :] for i in range(7)]
    for e in edits:
        assert set(A.block_keys("number", "1", base, None)) & set(A.block_keys("number", "1", e, None)), e


CAND = "candidate_id long, application_number string, value string, contact_type string, source_domain string, source_type string, confidence double, public_status string, associated_entity string, associated_person string, is_generic boolean, discovered_at timestamp_ntz, extra string"


def candidate(i, app, value, kind="email", domain=None, conf=None, at="2024-01-01"):
    import datetime as dt

    return (i, app, value, kind, domain, "public_web", conf, None, None, None, None, dt.datetime.fromisoformat(at), None)


def test_survivors(spark):
    rows = [
        candidate(1, " a1 ", "mailto:X@y.example", conf=0.5, at="2024-01-02"), candidate(2, "A1", "Bob <x@Y.example>", domain="d.example", conf=0.9), candidate(3, "A1", "x@y.example.", domain=" ", at="2025-01-01"),
        candidate(4, "A1", "(801) 555-0101 ext. 4", "phone", conf=0.5), candidate(5, "a1", "+1 801 555 0101", "phone", conf=0.5), candidate(6, None, "x@y.example"), candidate(7, "B", None), candidate(8, "B", "www.Z.example/p?q", "website"),
        candidate(9, "B", "https://z.example", "website"), candidate(2, "A1", "Bob <x@Y.example>", domain="d.example", conf=0.9),
    ]
    df = spark.createDataFrame(rows, CAND)
    assert {(r["value_from"], r["domain_from"]) for r in S.found(df).collect()} == {(2, 2), (4, 0), (8, 0)}
    assert S.survivors(df.limit(0)).count() == 0
    assert S.survivors(df).where("app = 'A1' and kind = 'email'").first()["candidates"] == 3


def test_survivors_agree_with_brute_force(spark, small):
    """The voted fields of every contact, by truth discovery written out over dictionaries."""
    from collections import defaultdict

    from quarry.session import load

    table = load(spark, small, "contact_candidate")
    weight = {}
    for r in S.keyed(table).collect():
        for f in S.VOTED:
            if r[f] is not None:
                claim = str(r[f]).lower() if isinstance(r[f], bool) else r[f]
                at = (r["app"], r["kind"], r["contact"], f, claim, r["source"])
                weight[at] = max(weight.get(at, 0), (0.5 if r["confidence"] is None else r["confidence"]) + 0.05)
    sources = defaultdict(set)
    for a, k, c, f, _, s in weight:
        sources[a, k, c, f].add(s)
    told = {at: w for at, w in weight.items() if len(sources[at[:4]]) > 1}
    trust = {at[5]: 0.8 for at in told}

    def support(of):
        out = defaultdict(float)
        for at, w in of.items():
            out[at[:5]] += w * trust.get(at[5], 0.8)
        return out

    for _ in range(S.ROUNDS):
        got, total, num, den = support(told), defaultdict(float), defaultdict(float), defaultdict(float)
        for at, v in got.items():
            total[at[:4]] += v
        for at, w in told.items():
            num[at[5]] += w * got[at[:5]] / total[at[:4]]
            den[at[5]] += w
        new = {s: (num[s] + 0.8) / (den[s] + 1.0) for s in trust}
        moved = max(abs(new[s] - trust[s]) for s in trust)
        trust = new
        if moved < S.SETTLED:
            break
    best = {}
    for at, v in support(weight).items():
        best[at[:4]] = min(best.get(at[:4], (1, "")), (-round(v, 9), at[4]))
    rows = S.survivors(table).collect()
    assert len(rows) > 40
    for r in rows:
        for f in S.VOTED:
            assert r[f] == best.get((r["app"], r["kind"], r["contact"], f), (0, None))[1]


def test_trust_follows_agreement(spark):
    good = [("a", "k", str(c), "f", "right", s, 1.0) for c in range(6) for s in ("s1", "s2", "s3")]
    bad = [("a", "k", str(c), "f", "wrong", "s4", 1.0) for c in range(6)]
    t = {r["source"]: r["trust"] for r in S.reliabilities(spark.createDataFrame(good + bad, "app string, kind string, contact string, field string, claim string, source string, weight double")).collect()}
    assert t["s1"] > 0.8 > t["s4"]


LEAD, FIND = "id long, name string, place string, company string", "match_id long, name string, company string, place string"


def test_matches(spark):
    leads = [
        (1, "Robert Delilvrand", "Ostley", "Aldercross Mallet Realty Corp"), (2, "DELILVRAND, ROBERT S", None, "Aldercross Mallet Rlty"), (3, "Claymoor Warbler Holdings LLC", "Dunfield", None), (4, "N/A", None, None), (5, None, None, None),
    ]
    finds = [
        (11, "Bob Delilvrand", "Alder Cross Mallet Realty", "Tarnwick"), (12, "Robert Delilvrand", "Basalt Granary Inc", "Tarnwick, TK"), (13, "Ann Other", "Claymoor Warbler Hldgs", None), (14, None, "Claymoor Warbler Bakery", None),
        (15, None, None, None), (16, "Robert Delilvrand", None, "Ostley, TK"), (16, "Robert Delilvrand", None, "Ostley, TK"), (17, "N/A", "", None),
    ]
    out = M.matches(spark.createDataFrame(leads, LEAD), spark.createDataFrame(finds, FIND)).collect()
    assert {(r["lead_id"], r["match_id"]) for r in out} == {(1, 11), (2, 11), (3, 13), (1, 16), (2, 16)}
    groups = M.findings_about(spark.createDataFrame(leads, LEAD), spark.createDataFrame(finds, FIND)).collect()
    assert {(r["match_id"], r["leads"]) for r in groups} == {(11, 2), (13, 1), (16, 2)}
    assert all(0 <= r["confidence"] <= 1 for r in out) and len(out) == 5


NAMES = [f"{a} {b}" for a in ("robert", "eleanor", "victor", "olympia", "benjamin", "ursula") for b in ("delilvrand", "munatchzard", "halambvane", "kolurnwick", "torardvers", "falemptnova")]


def typed(spark):
    """Signatures of names and of the same with a letter left out, and the words they may be written for."""
    wrong = [n[:-3] + n[-2:] for n in NAMES]
    rows = [(i, n.split(" "), [], None, None, False) for i, n in enumerate(NAMES + wrong)]
    sigs = spark.createDataFrame(rows, "sig long, core array<string>, initials array<string>, business string, legal string, joined boolean")
    return sigs, M.V.word_candidates(sigs), len(NAMES)


def test_hyperplane_tables_find_near_names(spark):
    """Recall of the blocking against brute force over all pairs of cosine .85 or more; the tables keep it at every size."""
    sigs, heads, n = typed(spark)
    model = M.blended(M.first_vectors()).tobytes()
    near = {r["word"]: r["heads"] for r in heads.collect()}
    vs = M.Vectors(model).names([[(w, near[w], M.GIVEN if i == 0 else 1.0) for i, w in enumerate(r["core"])] for r in sigs.orderBy("sig").collect()])
    got = {(r["a"], r["b"]) for r in M.blocked(sigs.select("sig"), sigs.select("sig"), sigs, heads, model).collect()}
    close = [(i, j) for i in range(2 * n) for j in range(2 * n) if float(vs[i] @ vs[j]) >= M.SURE_COSINE]
    assert len(close) > 3 * n and sum(p in got for p in close) / len(close) >= 0.9
    assert sum((i, i + n) in got for i in range(n)) >= 0.9 * n
    for size in (1_000, 100_000, 1_000_000, 10**9):
        assert M.meeting(M.SURE_COSINE, *M.shape_of(size)) >= M.RECALL


def test_blocking_rests_on_the_vectors(spark, monkeypatch):
    """With a random vector per word in place of its letters and neighbours, names with a typo no longer meet."""
    sigs, heads, n = typed(spark)
    model = M.blended(M.first_vectors()).tobytes()
    numbers = M.buckets(sigs, heads.select("word", F.array("word").alias("heads")).withColumn("word", F.col("word")), model, 8, 20)
    assert numbers.count() == 2 * n
    v = M.Vectors(model)
    monkeypatch.setattr(v, "word", lambda w, near: np.random.default_rng(abs(hash(w)) % 2**32).standard_normal(M.DIM).astype("float32"))
    x = v.names([[(w, [w], 1.0) for w in name.split(" ")] for name in ("robert delilvrand", "robert delilvrnd")])
    y = M.Vectors(model).names([[(w, [w], 1.0) for w in name.split(" ")] for name in ("robert delilvrand", "robert delilvrnd")])
    assert y[0] @ y[1] > M.SURE_COSINE > x[0] @ x[1]


def test_corners_meet_for_all_edits_that_are_compared(spark):
    rows = [(1, "Klhaugh Rd & Stenrise Ave", "Ostley"), (2, "Kelhaaugh Rd & Stenrise Ave", "Ostley"), (3, "Kelhaugh Rd & Stenrise Ave", "Ostley"), (4, "Kelhaugh Rd & Stenrisse Ave", "Ostley"), (5, "Brookmont Rd & Stenrise Ave", "Ostley")]
    got = {(r["left_id"], r["right_id"]) for r in A.found(spark.createDataFrame(rows, ADDR)).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_a_walk_starts_from_every_record_and_goes_on_to_any(spark):
    records = spark.range(20_500).select(F.col("id").alias("record"), F.array(F.lit("hub"), F.concat(F.lit("u"), "id")).alias("words"))
    got = M.walks(records).cache()
    assert got.count() == got.select("walk").distinct().count() == 20_500
    # two words and the one gone by for each record; a walk over the hub may come to any record
    second = got.where("words[2] = 'hub'").select(F.explode(F.slice("words", 4, 3)).alias("w")).where("w <> 'hub'")
    assert second.distinct().count() > 5_000


def test_all_walks_train_whatever_the_tasks(spark, monkeypatch):
    said = spark.range(6_000).select("id", F.array(F.concat(F.lit("a"), F.expr("id % 60")), F.concat(F.lit("b"), F.expr("id % 60")), F.lit("hub")).alias("words")).toDF("walk", "words")
    monkeypatch.setattr(M, "SHARD", 1_500)
    model = M.train(said)
    learned = M.Vectors(model).learned
    assert model == M.train(said.repartition(3)) and all(np.linalg.norm(learned[M.bucket(f"{x}{i}")]) > 0.9 for x in "ab" for i in range(60))


def test_all_pairs_calibrate(spark):
    n = spark.range(30_000)
    pairs = n.select(F.col("id").alias("a"), (F.col("id") + 100_000).alias("b"), F.when(F.col("id") < 3_000, 0.7).otherwise(0.95).alias("cosine"))
    right = n.select((F.col("id") + 100_000).alias("b"), F.when(F.expr("id = 0 or (id >= 3000 and id % 2 = 0)"), "x").otherwise("y").alias("place"))
    slope, offset, base = M.calibration(pairs, n.select("id", F.lit("x").alias("place")), right)
    assert abs(base - 1 / 3_000) < 1e-9 and abs(1 / (1 + np.exp(-(0.95 * slope + offset))) - 0.5) < 0.01


def test_every_contact_of_several_sources_tells_of_their_trust(spark):
    # a sketch of distinct counts takes these two sources for one
    assert spark.createDataFrame([("s98",), ("s99",)], "s string").agg(F.approx_count_distinct("s")).first()[0] == 1
    said = lambda i, app, source, conf, status: (*candidate(i, app, "x@y.example", domain=source, conf=conf)[:7], status, *candidate(i, app, "")[8:])
    rows = [said(2 * i + k, f"A{i}", s, c, v) for i in range(6) for k, (s, c, v) in enumerate((("s98", 0.9, "open"), ("s99", 0.3, "closed")))]
    rows += [said(20, "B", "s98", 0.5, "open"), said(21, "B", "s99", 0.5, "closed")]
    got = S.survivors(spark.createDataFrame(rows, CAND)).where("app = 'B'").first()
    assert got["public_status"] == "open"  # the votes are equal but for the trust that the other contacts earn
