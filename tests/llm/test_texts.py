import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, mixing, ocr, pii, spam

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def library():
    lines = (Path(bpe.TOKENIZERS) / bpe.VOCABULARY).read_bytes().splitlines()
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


TEXTS = [
    None, "", " ", "  two  blanks  ", "Hello's world, it'll be 12345!", "<|endoftext|> is text", "tab\tand\nline\r\n", "naïve café — “quoted” 日本語テキスト", "🏗️👷 ok", "xyzzyplughquuxfrobnicate" * 30, "ещё немного слов", "a" * 5000, "  nbsp", "Zanilvane & Rudellvers"
]


def test_ids_and_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == library.encode_ordinary(t or ""), t
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeéß漢", min_size=1, max_size=80))
def test_heap_merges_as_the_library(word):
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=bpe.ranks(), special_tokens={})
    assert bpe.heap_merge(word.encode(), bpe.ranks()) == enc.encode_ordinary(word)


def test_every_token_that_is_a_word_merges_to_itself():
    ranks = bpe.ranks()
    some = sorted(ranks.items(), key=lambda x: x[1])[::7]
    assert sum(bpe.heap_merge(t, ranks) != [i] for t, i in some) == 0


def test_water_filling():
    s = {"a": (0.5, 100, 2), "b": (0.3, 1000, 1), "c": (0.2, 0, 5)}
    q = mixing.water_fill(s)
    assert q["c"] == 0 and abs(q["a"] / (q["a"] + q["b"]) - 0.5 / 0.8) < 1e-9 and q["a"] == pytest.approx(200)
    q = mixing.water_fill(s, 900)
    assert q["a"] == pytest.approx(200) and q["b"] == pytest.approx(700)
    q = mixing.water_fill(s, 10_000)
    assert q == {"a": 200.0, "b": 1000.0, "c": 0.0}
    assert mixing.water_fill({}) == {} and mixing.water_fill({"a": (0.0, 5, 1)}) == {"a": 0.0}


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), ("a", "b", None, " a ")[i % 4]) for i in range(200)] + [(900, None, "a"), (901, "", "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mixed(docs, targets)
    rows = uses.collect()
    caps = {"a": 2, "b": 3, None: 0}
    assert len(rows) == 202 and all(0 <= r["uses"] <= caps[r["source"]] for r in rows)
    got = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert got["none"] == 0 and abs(got["a"] - 2 / 3) < 0.03 and abs(sum(got.values()) - 1) < 1e-9
    again = sorted(map(tuple, mixing.mixed(docs.repartition(5), targets)[0].collect()), key=lambda r: r[0])
    assert again == sorted(map(tuple, rows), key=lambda r: r[0])


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Reach Lucinda Gleniskrino at (237) 555-0148 or k.caloak@postbox.example", [("name", "Lucinda Gleniskrino"), ("phone", "(237) 555-0148"), ("email", "k.caloak@postbox.example")]),
        ("write hud.h [at] pearl [dot] test now", [("email", "hud.h [at] pearl [dot] test")]),
        ("Notary checked DL no. R72066791 and Passport No. QZ 150182", [("id_number", "R72066791"), ("id_number", "QZ 150182")]),
        ("W-9 on file for Falemptnova, Bernard (SSN 909-12-1993).", [("name", "Falemptnova, Bernard"), ("id_number", "909-12-1993")]),
        ("Mx. Kestang moved to 7353 Bankrigg Lane, Millbrook Falls", [("name", "Kestang"), ("address", "7353 Bankrigg Lane, Millbrook Falls")]),
        ("forward to P. O. Box 9705", [("address", "P. O. Box 9705")]),
        ("hi its gwendolyn ingertley again", [("name", "gwendolyn ingertley")]),
        ("Rebecca Maringdom Memorial Library and Hudemptson Park", []),
        ("Invoice 813 8526 2702; meeting room 60, Hedgepool Road; Webinar ID 866 6076 8017; page 13", []),
        ("The site fronts Hedgepool Road between 400 West and 600 West.", []),
        (None, []),
        ("", []),
    ],
)
def test_detection(text, kinds):
    assert [(k, text[s:e]) for k, s, e in pii.detect(text)] == kinds


def test_surrogates_keep_form_and_distinctness():
    text = "Susan Kestangdom, 801-555-0101, met SUSAN KESTANGDOM and Robert Kestangdom; call 801-555-0102 or susan.k@x.example."
    a, b = pii.redact(text, "key")
    assert a.count("[NAME_1]") == 2 and "[NAME_2]" in a and "[PHONE_2]" in a
    names = [b[s:e] for k, s, e in pii.detect(b) if k == "name"]
    assert names[0].upper() == names[1] and names[0] != names[2] and names[0].split()[1] == names[2].split()[1]
    assert "Kestangdom" not in b and pii.redact(text, "key")[1] == b != pii.redact(text, "other")[1]
    seen = {pii.shuffled_digits("k", f"{i:04d}") for i in range(10_000)}
    assert len(seen) == 10_000
    assert pii.redact(None, "key") == (None, None)


def test_items_of_tables(spark):
    df = spark.createDataFrame([(1, "mail a@b.example"), (1, "mail a@b.example"), (2, None), (3, "")], "evidence_id long, text string")
    assert [tuple(r) for r in pii.items(df).collect()] == [(1, "email", 6, 11)]
    assert pii.redacted(df, "k").count() == 3 and pii.items(df.limit(0)).count() == 0


BODY = [
    "The commission discussed the draina-\nge report at length. The plan shows a self-\nstorage block near the building.\n\nA neighbor spoke about the trees{0}.\n",
    "A resident asked about the draina-\nge report again. The plan keeps the self-\nstorage block of the building.\n\nThe owner thanked the board{0}.\n",
    "The engineer described the drainage report.\nThe owner of the building agreed with the board.\n\nThe commission closed the hearing{0}.\n",
]


def pages(n, last=""):
    return "".join(f"\n--- PAGE {i + 1} ---\n\nCity of Oak - Staff Report\nPage {i + 1}\n\n" + BODY[i].format(last if i == n - 1 else "") for i in range(n))


def test_scanned_pages(spark):
    good = [(i, pages(3), None) for i in range(30)]
    bad = [(100, pages(2, " and the own^er of the bui1ding"), None), (101, None, None), (102, "", None), (100, pages(2, " and the own^er of the bui1ding"), None)]
    more = [(200 + i, "The owner of the building asked for a drainage report. The building has a self-storage block and an owner.", None) for i in range(40)]
    df = spark.createDataFrame(good + bad + more, "parsed_id long, text string, pages string")
    got = {(r["line_no"], r["kind"]) for r in ocr.defects(df).where("parsed_id = 100").collect()}
    lines = bad[0][1].split("\n")
    for n, k in got:
        assert {"furniture": lines[n - 1].startswith(("City", "Page")), "split": lines[n - 1].endswith("draina-"), "garbled": "own^er" in lines[n - 1]}[k]
    assert sum(k == "furniture" for _, k in got) == 4 and sum(k == "split" for _, k in got) == 2 and sum(k == "garbled" for _, k in got) == 1
    fixed = ocr.repaired(df).where("parsed_id = 100").first()["text"]
    assert "drainage report" in fixed and "self-storage" in fixed and "the owner of the building" in fixed and "Staff Report" not in fixed
    assert ocr.defects(df.limit(0)).count() == 0


SPAM = [
    "Tags: " + ", ".join(f"vinyl doors item B{i} $20{i}.99" for i in range(10, 40)),
    "Oak sheds Ostley is the best oak sheds for oak sheds. Call oak sheds for oak sheds today. Looking for oak sheds in Ostley? " * 6,
    "\n".join(f"https://deckhub{i}.test/vinyl-doors?p={i}" for i in range(30)),
    " ".join(f"#oaksheds{c}" for c in ("Ostley", "best", "near", "local") * 8),
]
HAM = [
    "The plan provides 64 studios and 13 bicycle racks. The applicant asked for a waiver, and the water district objected. Staff report: https://packets.example/1.pdf",
    "Roll call. Member Aldebbow: nay. Commissioner Jaskoltitt: aye. Member Branudbrook: absent. Member Umbilvcroft: aye. Commissioner Varethmez: aye.",
    "Legal description: beginning at a point; thence N 3°36'12\" E 637.71 feet; thence S 1°50'18\" W 507.11 feet; thence N 71°47'08\" E 51.78 feet; to the point of beginning.",
    "Fee schedule\nVariance: $1449 plus $30 per lot\nSubdivision: $3398 plus $58 per lot\nAnnexation: $542 plus $55 per lot",
    "", "   ", "x" * 300, None,
]


def test_sizes_count_the_ids(spark, small):
    from quarry.session import load

    docs = load(spark, small, "documents").select("doc_id", "text", "source")
    docs = docs.union(docs.limit(3))  # some delivered twice
    want = {r["doc_id"]: len(r["ids"]) for r in bpe.encode(docs).collect()}
    got = bpe.sizes(docs, keep=("source",)).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["tokens"] for r in got} == want


def test_spam(spark):
    # every page stands on two hosts, so its phrases are replicated elsewhere
    survey = "Legal description: beginning at a point on the section line; " + " ".join(f"thence {d} {i}°36'12\" E {37 * i}.71 feet;" for i, d in enumerate("NSSNNSNSNNSSNSNSNSSN")) + " to the point of beginning."
    ham = [*HAM, survey]
    rows = [(100 * h + i, t, f"https://h{h}.example/a") for h in range(2) for i, t in enumerate(SPAM + ham)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, url string")
    assert {r["doc_id"] % 100 for r in spam.found(docs).collect()} == set(range(len(SPAM))) and spam.found(docs).count() == 2 * len(SPAM)
    assert spam.scores(docs).count() == len(rows) and spam.found(docs.limit(0)).count() == 0


def test_spam_rests_on_other_hosts(spark):
    rows = [(1, SPAM[0], "https://a.example/1"), (2, SPAM[0], "https://a.example/2"), (3, SPAM[1], None), (4, SPAM[1], None), (5, None, None), (6, HAM[0], "https://a.example/3")]
    got = {r["doc_id"]: r for r in spam.scores(spark.createDataFrame(rows, "doc_id long, text string, url string")).collect()}
    assert got[1]["density"] > 0.9 and got[1]["replicated"] == 0 == got[2]["replicated"]  # one host alone replicates nothing
    assert got[3]["replicated"] > 0.9 and got[4]["replicated"] > 0.9  # pages without a url are hosts of their own
    assert got[5]["density"] == 0 and got[6]["density"] < 0.5


def test_vectors_come_from_all_documents(spark):
    from quarry.llm import ocr

    rows = [(i, "the council heard a plan for the road and the bridge today") for i in range(400)]
    rows += [(1000 + i, f"the {w} fires clay bricks slowly") for i, w in enumerate(["kiln", "oven"] * 4)]
    names, v = ocr.learn(spark.createDataFrame(rows, "parsed_id long, text string"))[3:]
    of = {w: v[i] for i, w in enumerate(names)}
    assert {"kiln", "oven", "bricks", "council"} <= set(of)
    assert of["kiln"] @ of["oven"] > 0.9 > 0.5 > abs(of["kiln"] @ of["bridge"])


def test_list_pieces_of_prose_pages_count_as_listed_elsewhere(spark):
    prose = "The council heard that the plan of the district was in the report and that the board had asked for a waiver. " * 20
    doors, sheds = ("Tags: " + ", ".join(f"{w} item B{i} $20{i}.99" for i in range(10, 40)) for w in ("vinyl doors", "cedar sheds"))
    some = prose + "\nFor sale: " + ", ".join(f"vinyl doors item C{i} $3{i}.50" for i in range(10, 18)) + "."
    few = prose + "\nFor sale: " + ", ".join(f"cedar sheds item C{i} $3{i}.50" for i in range(10, 13)) + "."
    rows = [(i, t, f"https://h{i}.example/a") for i, t in enumerate((doors, some, sheds, few, prose))]
    got = {r["doc_id"]: r for r in spam.scores(spark.createDataFrame(rows, "doc_id long, text string, url string")).collect()}
    assert got[0]["replicated"] > 0.9 < got[2]["replicated"]
    assert 0 < got[1]["replicated"] <= got[1]["density"] < 0.5  # a page of prose has its share too
    assert got[3]["density"] == got[3]["replicated"] == 0 == got[4]["density"]  # three pieces are no list, but repeat one
