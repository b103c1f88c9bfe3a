"""Problem 5: rows whose project address denotes the same site.

Each distinct address is expanded into all normalised forms it may stand for, combinations of its
components are hashed, and two addresses that share any hash are compared in full; conflicting house
numbers, street types, directions or cities reject a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.names import osa, plain
from quarry.operators import rows as R
from quarry.session import cut

# Common writings of street types, directions, units, fillers and number words.
TYPES = {
    "street": "st", "st": "st", "str": "st", "avenue": "ave", "ave": "ave", "av": "ave", "aven": "ave", "road": "rd", "rd": "rd",
    "drive": "dr", "dr": "dr", "drv": "dr", "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct", "crt": "ct", "boulevard": "blvd",
    "blvd": "blvd", "boul": "blvd", "boulv": "blvd", "parkway": "pkwy", "pkwy": "pkwy", "pky": "pkwy", "pkway": "pkwy", "place": "pl",
    "pl": "pl", "circle": "cir", "cir": "cir", "way": "way", "wy": "way", "terrace": "ter", "ter": "ter", "trail": "trl", "trl": "trl",
    "highway": "hwy", "hwy": "hwy", "square": "sq", "sq": "sq", "loop": "loop", "alley": "aly", "aly": "aly", "plaza": "plz", "plz": "plz",
}
DIRECTIONS = {"n": "n", "north": "n", "no": "n", "s": "s", "south": "s", "so": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
CORNERS = {"ne", "nw", "se", "sw", "northeast", "northwest", "southeast", "southwest"}
UNITS = {"suite", "ste", "unit", "apt", "apartment", "bldg", "building", "lot", "lots", "floor", "fl", "room", "rm", "space", "spc", "#"}
NOISE = {"approx", "approximately", "address", "vicinity", "rear", "near", "about", "the", "of", "corner", "cor", "c", "intersection"}
FILLERS = {"", "-", "n/a", "na", "none", "tbd", "to be determined", "various", "various parcels", "various locations", "citywide", "city wide", "city-wide", "see attached", "see attached map", "see map", "unknown", "not assigned", "multiple", "multiple parcels"}
ONES = {w: i for i, w in enumerate("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split())}
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
TENTHS = {w: 10 * (i + 2) for i, w in enumerate("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split())}

#: Words before "at" or alone at the start that lead to a site and are no part of it.
LEAD = re.compile(r"^\s*(?:(?:the|vacant|located|lot|land|property|site|parcel|premises|address:?|approx\w*|situated|project)\s+)+at\s+")

#: A state word is one that ends addresses at least a fiftieth as often as the commonest; so many endings are looked at, an error if they do not reach down to that.
TAILS = 1000

FORM = "addr string, place string, form long, kind string, number string, street string, other string, type string, type2 string, direction string, city string, corner string"


def ordinal(token: str) -> str | None:
    """The number of a numbered street: 55th, 55, fifty-fifth."""
    if m := re.fullmatch(r"(\d{1,3})(?:st|nd|rd|th)?", token):
        return m[1]
    if token in ONES:
        return str(ONES[token])
    if token in TENTHS:
        return str(TENTHS[token])
    a, _, b = token.partition("-")
    return str(TENS[a] + ONES[b]) if a in TENS and 0 < ONES.get(b, 0) < 10 else None


def street_part(tokens: list[str]) -> tuple[str, str | None, str | None]:
    """(name, type, direction) of the words of one street."""
    way = next((DIRECTIONS[t] for t in (tokens[:1] + tokens[-1:]) if t in DIRECTIONS), None) if len(tokens) > 1 else None
    rest = tokens[1:] if len(tokens) > 1 and tokens[0] in DIRECTIONS else tokens
    rest = rest[:-1] if len(rest) > 1 and rest[-1] in DIRECTIONS else rest
    kind = None
    if len(rest) > 1 and rest[-1] in TYPES:
        kind, rest = TYPES[rest[-1]], rest[:-1]
        if len(rest) > 1 and rest[-1] in DIRECTIONS and way is None:
            way, rest = DIRECTIONS[rest[-1]], rest[:-1]
    words = [ordinal(t) or t for t in rest]
    return "".join(words), kind, way


class Places:
    """Cities, zip codes and state words, ready for looking an address's own words up in them."""

    def __init__(self, cities: dict[str, str], states: set[str]) -> None:
        self.cities, self.states = cities, states
        self.longest = max((len(c.split()) for c in cities), default=0)
        known = "|".join(map(re.escape, sorted(states)))
        self.after = rf"(?=\s*(?:[,;]|$|\s(?:{known})?\s*(?:vicinity|rear)?\s*$))"
        self.tail = re.compile(rf"[,;\s](?:{known})\s*(?:vicinity|rear|near)?\s*$") if states else None

    def named(self, text: str) -> list[str]:
        """The cities whose words stand in a row in a text, longer names first."""
        words = re.findall(r"[^\s,;]+", text)
        runs = {" ".join(words[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(words) - n + 1)}
        return sorted((r for r in runs if r in self.cities and not r[0].isdigit()), key=lambda r: (-len(r), r))


def parse(address: str | None, place: str | None, cities: dict[str, str], states: set[str], places: Places | None = None) -> dict | None:
    """Components of an address; None for a null, blank or filler text or one without a site.

    cities maps a city's plain name to itself and its zip codes to it, as learned from the rows.
    The place (municipality) stands in for a city that the address leaves out.
    """
    if address is None:
        return None
    places = places or Places(cities, states)
    text = plain(address).strip()
    if re.sub(r"\s+", " ", text) in FILLERS:
        return None
    text = re.sub(r"\([^)]*\)", lambda m: f" {m[0][1:-1]} " if re.sub(r"\W", "", m[0]) in CORNERS else " ", text)
    text = re.sub(r"#\s*", " # ", text)
    text = text.replace("n/a", " ").replace("/c", " ").replace(".", " ").replace("'", "")
    city = None
    flat = LEAD.sub(" ", re.sub(r"\s+", " ", text))
    if m := re.match(r"\s*(?:address:?|approx\w*)?\s*([a-z ]+),? ([a-z]{2,12}) - (?=.*[a-z0-9])", flat):  # "City, ST - street"
        if (name := m[1].strip()) in cities:
            city, flat = name, flat[m.end():]
    zipped = re.findall(r"\b(\d{5})\b", flat)
    for z in zipped:
        if z in cities and not re.match(rf"\s*{z}\b", flat):
            city, flat = city or cities[z], flat.replace(z, " ")
    for name in places.named(flat):
        if m := re.search(rf"(?:^|[,; ]){re.escape(name)}{places.after}", flat):
            city, flat = city or name, flat[: m.start()] + " , " + flat[m.end():]
            break
    flat = places.tail.sub(" ", flat) if places.tail else flat
    corner = next((c for c in re.findall(r"[a-z]+", flat) if c in CORNERS), None)
    corner = {"northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}.get(corner or "", corner)
    place = plain(place).strip() if place else None
    city = city or place or None
    if (m := re.search(r"\s(?:&|and|at|@)\s|/", flat)) and re.match(r"\s*\d+[a-z]? [a-z]", flat[m.end():]):
        flat, m = flat[m.end():], None  # words, then "at" and a numbered address
    if m:
        sides = []
        for part in (flat[: m.start()], flat[m.end():]):
            words = [t for t in re.findall(r"[a-z0-9]+(?:-[a-z]+)?", part) if t not in CORNERS and t not in NOISE]
            words = [t for t in words if t not in states]
            sides.append(street_part(words) if words else ("", None, None))
        if all(s[0] and not re.match(r"\d+[a-z]", s[0]) for s in sides):
            sides.sort(key=lambda s: s[0])
            return {"kind": "corner", "number": None, "street": sides[0][0], "other": sides[1][0], "type": sides[0][1], "type2": sides[1][1], "direction": None, "city": city, "corner": corner}
    words = re.findall(r"#|[a-z0-9]+(?:-[a-z]+)?", re.split(r"\bformerly\b", flat)[0])
    words = [t for t in words if t not in NOISE or len(t) == 1 and t != "c"]
    kept, i = [], 0
    while i < len(words):
        if words[i] in UNITS and i + 1 < len(words) and (kept and len(kept) > 1):
            i += 2
            continue
        kept.append(words[i])
        i += 1
    kept = [t for t in kept if t != "#"]
    if not kept:
        return None
    if re.fullmatch(r"\d+[a-z]?", kept[0]):
        number, rest = kept[0], kept[1:]
    elif len(kept) > 1 and (at := next((i for i in range(len(kept) - 1, 0, -1) if re.fullmatch(r"\d+[a-z]?", kept[i])), 0)):
        number, rest = kept[at], kept[:at]
    else:
        return None
    if not rest:
        return None
    cut_at = next((i + 1 for i, t in enumerate(rest) if i and t in TYPES), 0)  # what follows the type is a direction or no part of the street
    if cut_at:
        rest = rest[:cut_at] + [t for t in rest[cut_at : cut_at + 1] if t in DIRECTIONS]
    name, kind, way = street_part(rest)
    if not name:
        return None
    return {"kind": "number", "number": number.lstrip("0") or "0", "street": name, "other": None, "type": kind, "type2": None, "direction": way, "city": city, "corner": None}


def reach(name: str) -> int:
    """Edits allowed between two writings of a street name; none in numbers and very short names."""
    return 0 if name.isdigit() or len(name) < 4 else 1 if len(name) < 6 else 2


def deletions(name: str, most: int) -> set[str]:
    seen, level = {name}, {name}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        seen |= level
    return seen


def second_keys(other: str | None) -> set[str]:
    """What a corner's second street may be found under: at most one edit."""
    return deletions(other or "", min(1, reach(other or "")))


def block_keys(kind: str, number: str | None, street: str, other: str | None) -> list[str]:
    """Every combination of components under which a form of the same address may be found."""
    if kind == "corner":
        return [f"{x}|{y}" for x in deletions(street, reach(street)) for y in second_keys(other)]
    return [f"{number}|{x}" for x in deletions(street, reach(street))]


def agrees(a: str | None, b: str | None) -> bool:
    """Equal, or not stated on one side. Missing values arrive as None or NaN."""
    return not isinstance(a, str) or not isinstance(b, str) or a == b


def learned_places(rows: DataFrame) -> tuple[dict[str, str], set[str]]:
    """The cities, zip codes and state words that the rows' own addresses and places state.

    A city is a municipality named by rows; a zip code belongs to the city it stands beside most often.
    The number of cities of a register is bounded by the municipalities that exist, not by the rows;
    more than 50,000 raise an error instead of being broadcast.
    """
    known = rows.where("place is not null").groupBy(F.lower(F.trim("place")).alias("c")).count().where("c <> ''").limit(50_001).collect()
    if len(known) > 50_000:
        raise ValueError("more municipalities than a register can have; check the place column")
    cities = {plain(r["c"]): plain(r["c"]) for r in known}
    low = F.lower("addr")
    zips = (
        rows.where(low.rlike(r"[0-9]{5}\s*$") & F.col("place").isNotNull())
        .groupBy(F.regexp_extract(low, r"([0-9]{5})\s*$", 1).alias("z"), F.lower(F.trim("place")).alias("c")).count()
        .groupBy("z").agg(F.max_by("c", F.struct("count", "c")).alias("c")).limit(100_001).collect()
    )
    if len(zips) > 100_000:
        raise ValueError("more zip codes than there are; check the addresses")
    tails = rows.select(F.explode(F.regexp_extract_all(low, F.lit(r"[a-z]+,? ([a-z]{2,12}) ?(?:[0-9]{5})?$"), F.lit(1))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(TAILS).collect()
    states = {r["w"] for r in tails if r["w"] not in TYPES and r["w"] not in DIRECTIONS and r["w"] not in CORNERS and not any(r["w"] in c.split() for c in cities)}
    common = max((r["count"] for r in tails if r["w"] in states), default=0)
    if len(tails) == TAILS and tails[-1]["count"] * 50 > common:
        raise ValueError("no few words end the addresses; check the address column")
    return cities | {r["z"]: plain(r["c"]) for r in zips}, {r["w"] for r in tails if r["w"] in states and r["count"] * 50 > common}


def forms(rows: DataFrame) -> DataFrame:
    """Distinct (addr, place) with their components; fillers and texts without a site are left out."""
    cities, states = learned_places(rows)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(cities, states)
        for b in batches:
            out = []
            for a, p, f in zip(b["addr"], b["place"], b["form"], strict=True):
                if r := parse(a, p, cities, states, places):
                    out.append({"addr": a, "place": p, "form": f} | r)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FORM.split(", ")])

    # xxhash64 names a form wherever it is computed again; a repeated text has one form
    one = rows.select("addr", "place").where("addr is not null").distinct().withColumn("form", F.xxhash64("addr", F.coalesce("place", F.lit("\0"))))
    return one.mapInPandas(parsed, FORM)


def linked_forms(sites: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different forms of one site.

    Forms that agree in all components are one signature; only signatures are blocked and compared, so
    however many rows repeat an address, its bucket holds one entry. A signature whose street type,
    direction or city is missing joins any that states one, but not two that contradict each other
    in the same bucket unless another row already tells them apart: it links to each of them.
    """
    parts = ["kind", "number", "street", "other", "type", "type2", "direction", "city", "corner"]
    sig = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in parts])

    @F.pandas_udf("array<string>")
    def keys(kind: pd.Series, number: pd.Series, street: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([block_keys(*x) for x in zip(kind, number, street, other, strict=True)])

    signed = cut(sites.withColumn("sig", sig))
    sigs = cut(signed.select("sig", *parts).distinct())
    blocked = sigs.select("sig", F.explode(keys("kind", "number", "street", "other")).alias("k")).select("sig", F.xxhash64("k").alias("k"))
    left, right = blocked.withColumnRenamed("sig", "a"), blocked.withColumnRenamed("sig", "b")
    pairs = left.join(right, "k").where("a < b").select("a", "b").distinct()
    side = lambda x: sigs.select(*[F.col(c).alias(f"{x}_{c}" if c != "sig" else x) for c in ["sig", *parts]])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    for c in ("type", "type2", "direction", "city", "corner"):
        both = both.where(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull() | (F.col(f"a_{c}") == F.col(f"b_{c}")))
    both = both.where("a_kind = b_kind and a_number <=> b_number")

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [
                osa(s, t, min(reach(s), reach(t))) <= min(reach(s), reach(t)) and (k != "corner" or osa(o, q, 1) <= 1 and not second_keys(o).isdisjoint(second_keys(q)))
                for k, s, t, o, q in zip(p["a_kind"], p["a_street"], p["b_street"], p["a_other"], p["b_other"], strict=True)
            ]
            yield p.loc[ok, ["a", "b"]]

    close = cut(both.mapInPandas(same, "a long, b long"))
    links = close.union(close.select("b", "a")).union(sigs.select("sig", "sig")).toDF("a", "b")
    of = signed.select("form", "sig")
    return links.join(of.withColumnRenamed("form", "fa"), F.col("a") == F.col("sig")).drop("sig").join(of.withColumnRenamed("form", "fb"), F.col("b") == F.col("sig")).where("fa <= fb").select("fa", "fb").distinct()


def rows_of(opportunity: DataFrame, pud: DataFrame) -> DataFrame:
    """(id, addr, place) of both tables."""
    a = opportunity.select(F.col("lead_id").alias("id"), F.col("project_address").alias("addr"), F.col("municipality").alias("place"))
    return a.union(pud.select("pud_id", "project_address", "municipality")).where("id is not null")


def site_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links between address forms, and which row holds which form: (fa, fb) with fa <= fb, (id, form)."""
    sites = cut(forms(rows))
    held = rows.withColumn("form", F.xxhash64("addr", F.coalesce("place", F.lit("\0")))).join(sites.select("form"), "form", "left_semi").select("id", "form").distinct()
    return linked_forms(sites), held


def found(rows: DataFrame) -> DataFrame:
    """p5_found: (left_id, right_id) of rows at the same site, smaller id first; null and filler addresses are at none.

    A row repeated in the table counts once. Two rows with the very same text are a pair too.
    """
    links, held = site_links(rows)
    links = cut(links)
    a, b = held.select(F.col("id").alias("x"), F.col("form").alias("fa")), held.select(F.col("id").alias("y"), F.col("form").alias("fb"))
    pairs = R.split_join(links.join(a, "fa").select("x", "fb"), b, "fb")
    return pairs.where("x <> y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()


def link_counts(rows: DataFrame) -> DataFrame:
    """(id, links) of every row at a site: how many other rows share it. Rows are counted per form, so no pairs are made."""
    links, held = site_links(rows)
    held = cut(held)
    sizes = held.groupBy("form").agg(F.count("*").alias("n"))
    both = cut(links).select(F.explode(F.when(F.col("fa") == F.col("fb"), F.array(F.struct("fa", "fb"))).otherwise(F.array(F.struct("fa", "fb"), F.struct(F.col("fb").alias("fa"), F.col("fa").alias("fb"))))).alias("p")).select(F.col("p.fa").alias("form"), F.col("p.fb").alias("other")).distinct()
    reached = both.join(sizes.withColumnRenamed("form", "other"), "other").groupBy("form").agg((F.sum("n") - 1).alias("links"))
    return held.join(reached, "form").groupBy("id").agg(F.sum("links").alias("links"))
