"""Problem 1: findings of web searches and the leads whose applicant they are about, without a shared key.

Records, their attributes and the words in them form a graph, in which a word is also joined to the words
it may be another writing of. Random walks over it train skip-gram vectors; a word's vector is made of
its letters, of the words it is joined to and of what the walks taught. A name's vector is the sum of its
words'. Tables of random hyperplanes, as many as the wanted recall needs, block the names; pairs that meet
are reranked by their exact cosine and checked word by word. How often names of a cosine share a place
calibrates it, and company and place decide between namesakes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import name_variants as V
from quarry.llm import names as N
from quarry.operators import rows as R
from quarry.session import cut

#: The model's size is fixed: words and pieces of words are hashed into BUCKETS rows of DIM floats (6 MB), so it may be broadcast.
BUCKETS, DIM = 1 << 15, 48
#: A walk starts from every record and visits so many; a task trains on about SHARD walks. Counts of a word's records meet them over SALTS copies.
HOPS, SHARD, SALTS = 3, 20_000, 8
#: Rows of the model that are added up together.
BLOCK = 1 << 10
#: Pairs of this cosine meet in at least one table with this chance, whatever the number of names; bits of a bucket grow with its logarithm, tables with the bits.
SURE_COSINE, RECALL, LEAST_BITS = 0.85, 0.9, 8
#: What the walks add to a word's own direction, and the cosine that a compared pair has at least.
LEARNED, LEAST_COSINE = 0.3, 0.7
#: What the given name counts beside a surname: it may be an initial or a nickname.
GIVEN = 0.6
#: The calibration is fitted to all pairs, counted by cosine to so many decimals.
DECIMALS = 3


def walks(records: DataFrame) -> DataFrame:
    """(walk, words) of random walks over the record-attribute-word graph given as (record, words), one from every record.

    From a word a walk goes on to any of the records that hold it, each with the same chance. A word's
    records are numbered over many tasks, so a word that a third of all records hold is never gathered.
    """
    edges = records.select("record", F.explode("words").alias("word"))
    counts = edges.groupBy("word").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = edges.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).join(counts, ["word", "salt"])
    held = cut(sized.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("words")))
    fellows = cut(R.numbered(edges, ["word"], ["record"], "at").join(held, "record").select("word", "at", "words"))
    drawn = lambda i, n: F.pmod(F.xxhash64("walk", F.lit(i)), n) + 1
    # the words in an order that the walk and the hop decide, the same on every run
    mixed = lambda hop: F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64("walk", F.lit(hop), w["word"]).alias("h"), w["word"].alias("w")))), lambda x: x["w"])
    at = held.select(F.xxhash64("record", F.lit("start")).alias("walk"), "words", F.array().cast("array<string>").alias("said"))
    for hop in range(HOPS):
        here = at.withColumn("x", F.element_at("words", drawn(2 * hop, F.size("words")).cast("int")))
        said = here.select("walk", F.concat("said", mixed(hop), F.array("x.word")).alias("said"), F.col("x.word").alias("word"), drawn(2 * hop + 1, F.col("x.n")).alias("at"))
        if hop < HOPS - 1:
            at = said.join(fellows, ["word", "at"]).select("walk", "words", "said")
    return said.select("walk", F.col("said").alias("words"))


def bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


def first_vectors() -> np.ndarray:
    """Seeded starting vectors, nearly orthogonal, so words outside the sample tell names apart too."""
    return (np.random.default_rng(11).standard_normal((BUCKETS, DIM)) / np.sqrt(DIM)).astype("float32")


def skip_gram(sentences: list[list[int]], freq: np.ndarray, window: int = 3, negatives: int = 4, rate: float = 0.02) -> np.ndarray:
    """Word vectors by skip-gram with negative sampling, one pass in batches; the same sentences give the same vectors.

    freq: how often all sentences, not only these, say each word; negatives are drawn by it.
    """
    rng, inner, outer = np.random.default_rng(12), first_vectors(), np.zeros((BUCKETS, DIM), "float32")
    said = np.array([w for s in sentences for w in s], "int32")
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    near = [(said[:-d], said[d:], of[:-d] == of[d:]) for d in range(1, window + 1)]
    ahead = np.concatenate([np.stack([x, y], 1)[same & (x != y)] for x, y, same in near])
    pairs = np.concatenate([ahead, ahead[:, ::-1]])
    if not len(pairs):
        return inner
    rng.shuffle(pairs)
    chance = freq**0.75
    drawn = rng.choice(BUCKETS, size=(len(pairs), negatives), p=chance / chance.sum()).astype("int32")
    for a in range(0, len(pairs), 2048):
        c, o = pairs[a : a + 2048, 0], np.concatenate([pairs[a : a + 2048, 1:], drawn[a : a + 2048]], 1)
        v, u = inner[c], outer[o]
        g = 1 / (1 + np.exp(-np.einsum("bd,bnd->bn", v, u)))
        g[:, 0] -= 1
        g *= rate
        add(inner, c, -np.einsum("bn,bnd->bd", g, u))
        add(outer, o.ravel(), (-g[:, :, None] * v[:, None, :]).reshape(-1, DIM))
    return inner


def add(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    """Add the rows of what to the rows at of to; rows named several times get them all."""
    order = np.argsort(at, kind="stable")
    rows = at[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    to[rows[first]] += np.add.reduceat(what[order], first, axis=0)


def blended(trained: np.ndarray) -> np.ndarray:
    """What training taught of each word, as a unit vector without the drift that all words share; 0 for words the sample never showed.

    The drift would put every name into the same few buckets.
    """
    moved = trained - first_vectors()
    seen = np.abs(moved).sum(1) > 0
    if seen.any():
        moved[seen] -= moved[seen].mean(0)
        moved[seen] /= np.linalg.norm(moved[seen], axis=1, keepdims=True) + 1e-9
    moved[~seen] = 0
    return moved.astype("float32")


def train(said: DataFrame) -> bytes:
    """The model's bytes, fitted to all walks.

    Tasks train on about SHARD walks each, all from the same start and with the same chances of the
    negatives, and what each has moved is added up, so the model grows with neither walks nor tasks.
    """
    said = cut(said)
    numbers = F.transform("words", lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(BUCKETS)).cast("int"))
    freq = np.zeros(BUCKETS)
    for r in said.select(F.explode(numbers).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect():
        freq[r["word"]] = r["n"]
    shards = max(1, math.ceil(said.count() / SHARD))

    def moved(key: tuple, walks: pd.DataFrame) -> pd.DataFrame:
        rows = walks.sort_values("walk")
        by = skip_gram([list(ws) for ws in rows["words"]], freq) - first_vectors()
        seen = np.flatnonzero(np.abs(by).sum(1))
        parts = [(n, seen[seen // BLOCK == n]) for n in np.unique(seen // BLOCK)]
        return pd.DataFrame([(n, key[0], at.astype("int32").tobytes(), by[at].tobytes()) for n, at in parts], columns=["block", "shard", "at", "by"])

    def summed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((BLOCK, DIM), "float32")
        for at, by in parts.sort_values("shard")[["at", "by"]].itertuples(index=False):
            out[np.frombuffer(at, "int32") % BLOCK] += np.frombuffer(by, "float32").reshape(-1, DIM)
        return pd.DataFrame({"block": [key[0]], "by": [out.tobytes()]})

    sharded = said.select(F.pmod(F.xxhash64("walk"), F.lit(shards)).cast("int").alias("shard"), "walk", numbers.alias("words"))
    parts = sharded.groupBy("shard").applyInPandas(moved, "block int, shard int, at binary, by binary")
    model = first_vectors()
    for r in parts.groupBy("block").applyInPandas(summed, "block int, by binary").collect():
        model[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["by"], "float32").reshape(-1, DIM)
    return blended(model).tobytes()


class Vectors:
    """Vectors of words and names under one model; a word's is worked out once per batch of names."""

    def __init__(self, model: bytes) -> None:
        self.learned, self.pieces = np.frombuffer(model, "float32").reshape(BUCKETS, DIM), first_vectors()

    def letters(self, word: str) -> np.ndarray:
        """The direction of a word's pairs and triples of letters."""
        w = f"^{word}$"
        v = self.pieces[[bucket(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]].sum(0)
        return v / (np.linalg.norm(v) + 1e-9)

    def word(self, word: str, near: list[str]) -> np.ndarray:
        """Its letters, those of the words it may be another writing of, and what the walks taught of it."""
        v = self.letters(word) + sum((self.letters(h) for h in near if h != word), np.zeros(DIM, "float32"))
        v = v / (np.linalg.norm(v) + 1e-9) + LEARNED * self.learned[bucket(near[-1] if len(near) else word)]
        return v / (np.linalg.norm(v) + 1e-9)

    def names(self, parts: list[list[tuple[str, list[str], float]]]) -> np.ndarray:
        """Unit vectors of names given as (word, words near it, weight)."""
        known: dict[tuple, np.ndarray] = {}
        out = np.zeros((len(parts), DIM), "float32")
        for i, words in enumerate(parts):
            for w, near, weight in words:
                at = (w, tuple(near))
                if at not in known:
                    known[at] = self.word(w, list(near))
                out[i] += weight * known[at]
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


def meeting(cosine: float, bits: int, tables: int) -> float:
    """The chance that two vectors of a cosine share a bucket in one of the tables."""
    return 1 - (1 - (1 - math.acos(cosine) / math.pi) ** bits) ** tables


def shape_of(n: int) -> tuple[int, int]:
    """(bits, tables) for n names: about a name per bucket, and tables enough for the recall."""
    bits = max(LEAST_BITS, n.bit_length() - 2)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - math.acos(SURE_COSINE) / math.pi) ** bits))
    return bits, tables


def buckets(sigs: DataFrame, heads: DataFrame, model: bytes, bits: int, tables: int) -> DataFrame:
    """(sig, v, b): the name's vector in bytes and its bucket number in every table."""
    person = F.expr("size(core) = 2 and business is null and legal is null and not joined")
    words = sigs.select("sig", person.alias("person"), F.posexplode("core").alias("p", "word")).join(heads, "word")
    weight = F.when(F.col("person") & (F.col("p") == 0), GIVEN).otherwise(1.0)
    parts = words.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("p", "word", "heads", weight.alias("weight")))).alias("parts"))
    shared = sigs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, powers = Vectors(shared.value), 1 << np.arange(bits, dtype="int64")
        planes = np.random.default_rng(13).standard_normal((DIM, tables * bits)).astype("float32")
        for b in batches:
            v = vectors.names([[(x["word"], x["heads"], x["weight"]) for x in p] for p in b["parts"]])
            on = ((v @ planes) > 0).reshape(len(b), tables, bits)
            numbers = (on * powers).sum(2) * tables + np.arange(tables)
            yield pd.DataFrame({"sig": b["sig"], "v": [x.tobytes() for x in np.round(v * 127).astype("int8")], "b": list(numbers)})

    return parts.mapInPandas(run, "sig long, v binary, b array<long>")


def blocked(left: DataFrame, right: DataFrame, sigs: DataFrame, heads: DataFrame, model: bytes) -> DataFrame:
    """(a, b, cosine) of signatures of left and right that share a bucket in any table and have the least cosine.

    Vectors travel with the bucket numbers, in 48 bytes, so the cosine is taken where two names meet and
    only pairs that are near go on.
    """
    n = right.count()
    numbers = cut(buckets(sigs, heads, model, *shape_of(n)))
    side = lambda sides, k: sides.join(numbers, "sig").select(F.col("sig").alias(k), F.col("v").alias(f"v{k}"), F.explode("b").alias("n"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = np.frombuffer(b"".join(p["va"]), "int8").reshape(-1, DIM).astype("float32")
            y = np.frombuffer(b"".join(p["vb"]), "int8").reshape(-1, DIM).astype("float32")
            c = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1) + 1e-9)
            kept = c >= LEAST_COSINE
            yield pd.DataFrame({"a": p["a"][kept], "b": p["b"][kept], "cosine": np.minimum(c[kept], 1.0).astype("float64")})

    met = side(left, "a").join(side(right, "b"), "n").select("a", "va", "b", "vb")
    return met.mapInPandas(near, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def checked(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs with ok: whether the two names' words can be written for each other and their stated parts agree."""
    side = lambda x: sigs.select(F.col("sig").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("core", "initials", "business", "legal")])

    def fits(c: list[str], i: list[str], d: list[str], j: list[str], parts: bool) -> bool:
        short, other = len(c) == 1 and len(i) > 0, len(d) == 1 and len(j) > 0
        if short and len(d) == 2:
            return N.initials_fit(i, c[0], d, j)
        if other and len(c) == 2:
            return N.initials_fit(j, d[0], c, i)
        if short or other:
            return short and other and N.near(c[0], d[0]) and i[0] == j[0]
        return parts and N.aligned(c, d) and (not i or not j or i[-1] == j[-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [fits(list(c), list(i), list(d), list(j), s) for c, i, d, j, s in zip(p["a_core"], p["a_initials"], p["b_core"], p["b_initials"], p["parts"], strict=True)]
            yield p[["a", "b", "cosine"]].assign(ok=ok)

    agree = lambda c: F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull() | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("parts", agree("business") & agree("legal"))
    return both.mapInPandas(run, "a long, b long, cosine double, ok boolean")


def calibration(pairs: DataFrame, left: DataFrame, right: DataFrame) -> tuple[float, float, float]:
    """(slope, offset, base) of the chance that names of a cosine are the same, from how often such names share a place.

    left, right: (sig, place). Places take no part in the cosine. A logistic curve is fitted to all pairs
    whose both names have places, counted by their cosine to DECIMALS decimals; base is the rate at which
    mere neighbours share one. Without any such pair a curve through .5 at the cosine .75 stands in.
    """
    side = lambda t, k: t.toDF(k, "place").groupBy(k).agg(F.collect_set("place").alias(f"{k}_places"))
    both = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").select(F.round("cosine", DECIMALS).alias("x"), F.arrays_overlap("a_places", "b_places").cast("int").alias("same"))
    rows = sorted((r["x"], r["n"], r["same"]) for r in both.groupBy("x").agg(F.count("*").alias("n"), F.sum("same").alias("same")).collect())
    x, n, same = np.array(rows, "float64").reshape(-1, 3).T
    if not 0 < same.sum() < n.sum():
        return 12.0, -9.0, 0.0
    w, f = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-f @ w))
        h = (f * (n * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, f.T @ (n * p - same) + 1e-3 * w)
    low = np.cumsum(n) - n < 0.1 * n.sum()  # the tenth of the pairs of least cosine
    return float(w[0]), float(w[1]), float(same[low].sum() / n[low].sum())


def place_of(c):
    """A city without the state behind it."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r",\s*[a-z. ]+$", "")), F.lit(""))


def matches(leads: DataFrame, findings: DataFrame) -> DataFrame:
    """(lead_id, match_id, confidence) of findings about the applicants of leads. An applicant of many leads is paired in parts."""
    lone, rows = about(leads, findings)
    pairs = R.split_join(rows.select(F.col("id").alias("lead_id"), "entity"), lone, "entity")
    return pairs.groupBy("lead_id", "match_id").agg(F.round(F.max("confidence"), 4).alias("confidence"))


def findings_about(leads: DataFrame, findings: DataFrame) -> DataFrame:
    """(match_id, entity, leads, confidence): the applicants that a finding is about, as a person and as an organisation, and how many leads each has."""
    lone, rows = about(leads, findings)
    n = rows.groupBy("entity").agg(F.count("*").alias("leads"))
    return lone.groupBy("match_id", "entity").agg(F.round(F.max("confidence"), 4).alias("confidence")).join(n, "entity").select("match_id", "entity", "leads", "confidence")


def about(leads: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((match_id, entity, confidence), (id, entity)): what each finding is about, and the leads of each applicant.

    leads: (id, name, place, company); findings: (match_id, name, company, place). A person matches by
    discovered name unless company and place tell of a namesake; an organisation by discovered company
    alone. All leads of the applicant count. Null, blank and filler names match nothing; a name that can
    stand for several applicants goes to the one whose company or place it shares, and else to none.
    Rows delivered twice count once. Empty tables give an empty result.
    """
    found = cut(findings.groupBy("match_id").agg(F.min(F.struct("name", "company", "place")).alias("r")).select("match_id", "r.name", "r.company", place_of(F.col("r.place")).alias("place")).where("match_id is not null"))
    leads = leads.withColumn("place", place_of(F.col("place")))
    named = leads.select("name").union(leads.select("company")).union(found.select("name")).union(found.select("company"))
    parsed = cut(V.signatures(V.parse_names(named)))
    sigs = cut(parsed.dropDuplicates(["sig"]).drop("name"))
    heads = cut(V.word_candidates(sigs))
    rows = cut(V.classes(leads, (parsed, heads)).where("entity is not null"))

    head = heads.select("word", F.element_at("heads", -1).alias("head"))
    one = parsed.select(F.col("name").alias("said"), F.explode("core").alias("word")).join(head, "word").groupBy("said").agg(F.collect_list("head").alias("heads"))
    texts = rows.select(F.xxhash64(F.lit("l"), "id").alias("record"), "name", "company", "place").union(found.select(F.xxhash64(F.lit("f"), "match_id"), "name", "company", "place"))
    none = F.array().cast("array<string>")
    graph = (
        texts.join(one.toDF("name", "n"), "name", "left").join(one.toDF("company", "c"), "company", "left")
        .select("record", F.array_distinct(F.concat(F.coalesce("n", none), F.coalesce("c", none), F.coalesce(F.array(F.concat(F.lit("at:"), "place")), none))).alias("words"))
        .select("record", F.filter("words", lambda w: w.isNotNull()).alias("words"))
    )
    model = train(walks(cut(graph.where("size(words) > 0"))))

    # organisations carry a business, a legal form or an ampersand in any of their writings
    marked = sigs.select("sig", "joined", "business", "legal", F.expr("size(core) = 1 and size(initials) > 0").alias("short"))
    class_sigs = cut(rows.select("sig", "entity").distinct().join(marked, "sig"))
    kinds = class_sigs.groupBy("entity").agg(F.max(F.expr("joined or business is not null or legal is not null")).alias("org"), F.min("short").alias("only_short"))
    sides = cut(class_sigs.join(kinds, "entity").where("org or not short or only_short").select(F.col("sig").alias("a"), "entity", "org"))
    probe = found.select("match_id", "place", F.explode(F.array(F.struct(F.lit(False).alias("org"), F.col("name").alias("said")), F.struct(F.lit(True).alias("org"), F.col("company").alias("said")))).alias("p")).select("match_id", "place", "p.org", "p.said")
    probe = cut(probe.join(parsed.select(F.col("name").alias("said"), F.col("sig").alias("b")), "said").select("match_id", "place", "org", "b"))
    firms = cut(rows.join(parsed.select(F.col("name").alias("company"), F.col("sig").alias("a")), "company").select("entity", "a").distinct())
    left = sides.select(F.col("a").alias("sig")).union(firms.select("a")).distinct()
    judged = cut(checked(blocked(left, probe.select(F.col("b").alias("sig")).distinct(), sigs, heads, model), sigs))
    slope, offset, base = calibration(judged, rows.where("place is not null").select("sig", "place"), probe.where("place is not null").select("b", "place"))
    share = lambda c: 1 / (1 + F.exp(-(c * slope + offset)))
    p = F.greatest((share(F.col("cosine")) - base) / (share(F.lit(1.0)) - base), F.lit(0.01)) if slope > 0 else F.lit(1.0)
    good = judged.where("ok").select("a", "b", F.least(p, F.lit(1.0)).alias("p"))

    pairs = cut(probe.join(good, "b").join(sides, ["a", "org"]).groupBy("match_id", "entity", "org").agg(F.max("p").alias("p")))
    # context: the places and firms that an applicant's leads state, against those of the finding
    places = rows.where("place is not null").select("entity", "place", F.lit(1).alias("same_place")).distinct()
    has_place = places.select("entity", F.lit(1).alias("has_place")).distinct()
    has_firm = firms.select("entity", F.lit(1).alias("has_firm")).distinct()
    ctx = pairs.join(found.select("match_id", "place"), "match_id").join(places, ["entity", "place"], "left").join(has_place, "entity", "left").join(has_firm, "entity", "left")
    # the firm that a finding states, against those of the applicant's leads, by the same comparison
    stated = probe.where("org").select("match_id", "b")
    agree = pairs.where("not org").select("match_id", "entity").join(stated, "match_id").join(good.select("a", "b"), "b").join(firms, ["entity", "a"]).select("match_id", "entity", F.lit(1).alias("same_firm")).distinct()
    says_firm = stated.select("match_id", F.lit(1).alias("says_firm")).distinct()
    ctx = ctx.join(agree, ["match_id", "entity"], "left").join(says_firm, "match_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    place_no = F.col("place").isNotNull() & flag("has_place") & ~flag("same_place")
    firm_no = flag("says_firm") & flag("has_firm") & ~flag("same_firm")
    ok = F.col("org") | flag("same_firm") | flag("same_place") | ~(firm_no | place_no)
    hits = F.when(flag("same_firm"), 2).otherwise(0) + F.when(flag("same_place"), 1).otherwise(0)
    weight = F.when(flag("same_firm"), 1.0).when(flag("same_place"), 0.97).when(F.col("org"), F.when(place_no, 0.9).otherwise(0.95)).otherwise(0.8)
    kept = cut(ctx.where(ok).select("match_id", "entity", "org", hits.alias("hits"), (F.col("p") * weight).alias("confidence")))
    # a finding is about one person and one organisation: the one whose context it shares, if that is one
    best = kept.groupBy("match_id", "org").agg(F.max("hits").alias("top"))
    top = kept.join(best, ["match_id", "org"]).where("hits = top")
    lone = top.groupBy("match_id", "org").agg(F.count("*").alias("n"), F.first("entity").alias("entity"), F.first("confidence").alias("confidence")).where("n = 1")
    return lone.drop("n", "org"), rows.select("id", "entity")


def leads_of(opportunity: DataFrame) -> DataFrame:
    return opportunity.select(F.col("lead_id").alias("id"), F.col("applicant_name").alias("name"), F.col("applicant_locality").alias("place"), F.col("applicant_entity").alias("company")).where("id is not null")


def findings_of(identity_match: DataFrame) -> DataFrame:
    return identity_match.select("match_id", F.col("discovered_name").alias("name"), F.col("discovered_company").alias("company"), F.col("discovered_locality").alias("place"))
