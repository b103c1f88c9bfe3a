"""Problem 9: pages that are keyword-stuffed, link lists or product tags rather than sentences.

Pages are cut into pieces: links, tags, coded products, list items, stuffed sentences; their share of
the characters is the list density. The phrase shingles of the pieces are exploded and their distinct
hosts counted over the whole corpus; a page is flagged where most of its characters stand in list pieces
whose phrases are replicated on other hosts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, spread

# Function words of English and Spanish, without which a run of words is no sentence.
FUNCTION = set(
    "the a an of and or to in on at by with from as is are was were be been being that this these those it its not no has have had do does did will would can could"
    " may must should which who whom whose their his her they he she we you i but if than then there so such per plus means because while after before under over until"
    " between during through without within into about against among whether asked said found shown"
    " el la los las un una unos unas de del al y o en por para con sin es son fue ser se su sus que como más pero no lo le les ha han había".split()
)
ANCHOR = re.compile(r"<a\s[^>]*>[^<]*(?:</a>)?|\[[^\]\n]{0,80}\]\(\S+\)", re.I)
URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
#: Words that may link the others inside a phrase.
LINKING = {"de", "del", "of"}
#: What stands before a labelled link on its line.
LABEL = re.compile(r"[\w$ *+/-]{1,60}(?:->|:)\s*$")
HASHTAG = re.compile(r"#[^\s#]{2,}")
CODE = re.compile(r"\b(?:item|model|size|sku|art|ref|part)\s+[a-z]{1,3}-?\d{1,5}\b(?:\s*[$€£]\s?\d+(?:[.,]\d{2})?)?", re.I)
CODED = ("item ", "model ", "size ", "sku ", "art ", "ref ", "part ")
#: What stands before a product's code in its item.
PRODUCT = re.compile(r"[^\W\d_]+(?:[ -][^\W\d_]+){0,4}\s*$")
#: Separators between the items of a list; a full stop or colon separates sentences, not items.
ITEMS = re.compile(r"[,;|/>•·~!*\n\t]+|\s-\s")
CHUNKS = re.compile(r"[.,;:!?|/\n()\"*>]")
PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?|/\n()\"*><[]{}=+$€£%&#@_•·~“”"})
SENTENCES = re.compile(r"(?<=[.?!])\s+|\n")
WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|24/7|\d{4}")
#: A phrase is replicated elsewhere where this many distinct hosts list it: the page's own and another.
HOSTS = 2
#: A stuffed page repeats a pair of content words this often, and over this share of its words.
STUFFED_TIMES, STUFFED_SHARE = 5, 0.1
#: Fewer pieces than this are no list, whoever repeats them.
LEAST_PIECES = 5
#: Words that a page without separators repeats this often carry its soup.
TIMES = 3
DENSITY = 0.5
#: Copies of a replicated phrase that meet the pages, so a phrase of a third of all pages is met in several tasks.
SALTS = 8


def size(text: str) -> int:
    return len("".join(text.split()))


def without(text: str, pattern: re.Pattern, before: re.Pattern | None) -> tuple[str, list[str]]:
    """text with a line break in place of each match and of what leads to it, and the pieces taken."""
    kept, at, took = [], 0, []
    for m in pattern.finditer(text):
        start = m.start()
        if before:
            floor = max(at, text.rfind("\n", 0, start) + 1, start - 80)
            if lead := before.search(text, floor, start):
                start = lead.start()
        kept.append(text[at:start])
        took.append(text[start : m.end()])
        at = m.end()
    return "\n".join([*kept, text[at:]]), took


def items(text: str) -> list[str]:
    """The list items of a text without links: runs of up to six words without function words."""
    out = []
    for p in map(str.strip, ITEMS.split(text)):
        # what is long or ends as a sentence is no item
        if p and len(p) <= 70 and p[-1] not in ".:?":
            words = WORD.findall(p.lower())
            if 1 <= len(words) <= 6 and FUNCTION.isdisjoint(w for w in words if w not in LINKING or w in (words[0], words[-1])) and sum(map(str.isdigit, p)) <= 4:
                out.append(" ".join(words))
    return out


def pairs(words: list[str]) -> list[str]:
    """The phrase shingles of a run of words: its pairs of neighbours, or its only word."""
    return [f"{x} {y}" for x, y in zip(words, words[1:])] or words


def link_shingles(link: str) -> list[str]:
    """What a link says: the words around its address and of its path, else the letters of its host."""
    m = re.search(r"(?:https?://|www\.)([^/\s\"'>)\]]*)([^\s\"'>)\]]*)", link, re.I)
    if not m:
        return pairs(WORD.findall(link.lower()))
    path = re.sub(r"\?.*|\.html?$", "", m[2].lower())
    said = [w for w in WORD.findall(re.sub(r"<[^>]*>", " ", (link[: m.start()] + " " + link[m.end() :])).lower()) if not w.isdigit()]
    host = re.sub(r"^www\.", "", m[1].lower()).split(".")[0].rstrip("0123456789")
    return [*pairs(said), *pairs(re.findall(r"[^\W\d_]{2,}", path)), f"at {host}"]


def tag_shingles(tags: list[str]) -> list[list[str]]:
    """A hashtag's shingles: itself, what stands before its first inner capital or digit, and the shortest tag of the page that begins it."""
    have = {t.lower().lstrip("#") for t in tags}
    out = []
    for tag in tags:
        t = tag.lstrip("#")
        head = re.match(r"[^\W\d_](?:[^\W\d_A-Z]|[-'])*", t)
        stems = [t.lower(), *([head[0].lower()] if head and len(head[0]) >= 6 else [])]
        stems += [t.lower()[:n] for n in range(6, len(t)) if t.lower()[:n] in have][:1]
        out.append(sorted({"#" + x for x in stems}))
    return out


def evidence(text: str) -> tuple[int, int, list[tuple[tuple[str, ...], int]]]:
    """(characters, characters in list pieces, units): the pieces are links, tags, coded products, list items and stuffed
    sentences; equal ones are one unit, given as its phrase shingles and its characters. Fewer than LEAST_PIECES have
    units, for what they repeat of other pages, but no characters."""
    total, rest = size(text), text
    if not total:
        return 0, 0, []
    units: Counter = Counter()
    pieces = 0
    if "://" in rest or "www." in rest.lower():
        rest, a = without(rest, ANCHOR, None)
        rest, b = without(rest, URL, LABEL)
        pieces += len(a) + len(b)
        for x in a + b:
            units[tuple(sorted(set(link_shingles(x))))] += size(x)
    if "#" in rest:
        rest, tags = without(rest, HASHTAG, None)
        pieces += len(tags)
        for x, t in zip(tag_shingles(tags), tags, strict=True):
            units[tuple(x)] += size(t)
    if sum(map(rest.lower().count, CODED)) >= 3 and len(CODE.findall(rest)) >= 3:
        rest, sold = without(rest, CODE, PRODUCT)
        pieces += len(sold)
        for x in sold:
            units[tuple(pairs(WORD.findall(CODE.sub(" ", x).lower())))] += size(x)
    listed = Counter(items(rest))
    pieces += listed.total()
    count = Counter(rest.lower().translate(PUNCTUATION).split())
    number = sum(n for w, n in count.items() if w[0].isalpha() or (len(w) == 4 and w.isdigit()))  # of words
    grams: Counter = Counter()
    least = max(STUFFED_TIMES, STUFFED_SHARE * number / 2)
    often = {w for w, n in count.items() if n >= least and content(w)}
    function = sum(n for w, n in count.items() if w in FUNCTION)
    if often or function < 0.3 * number:  # else no pair can be stuffed
        for chunk in CHUNKS.split(rest.lower()):
            ws = WORD.findall(chunk)
            grams.update(g for g in zip(ws, ws[1:]) if content(g[0]) and content(g[1]))
    key = {g for g, n in grams.items() if n >= least}
    if key or function < 0.3 * number:
        for s in SENTENCES.split(rest):
            ws = WORD.findall(s.lower())
            if not ws or " ".join(ws) in listed:
                continue
            inside = sum(size(p) for p in ITEMS.split(s) if " ".join(WORD.findall(p.lower())) in listed)
            held = key.intersection(zip(ws, ws[1:]))
            if held:
                pieces += sum(g in key for g in zip(ws, ws[1:]))
                units[tuple(sorted(f"{a} {b}" for a, b in held))] += size(s) - inside
            elif len(ws) >= 10 and sum(map(str.isdigit, s)) < 0.15 * len(s) and sum(w in FUNCTION for w in ws) < 0.1 * len(ws) and sum(count[w] >= TIMES for w in ws) >= 0.6 * len(ws):
                cut_up = soup(ws, grams)
                pieces += len(cut_up)
                units.update(cut_up)  # a soup of repeated words without separators
    for p, n in listed.items():
        units[tuple(pairs(p.split(" ")))] += n * len(p.replace(" ", ""))
    kept = [(k, n) for k, n in units.items() if n > 0 and k]
    return total, min(sum(n for _, n in kept), total) if pieces >= LEAST_PIECES else 0, kept


def content(word: str) -> bool:
    """Whether a word can carry a stuffed phrase: three letters or more, no function word."""
    return len(word) > 2 and word not in FUNCTION


def soup(words: list[str], grams: Counter) -> Counter:
    """A run of words cut into the pairs that the page repeats and the single words between them."""
    out: Counter = Counter()
    i = 0
    while i < len(words):
        n = 2 if i + 1 < len(words) and grams[(words[i], words[i + 1])] > 1 else 1
        out[(" ".join(words[i : i + n]),)] += sum(map(len, words[i : i + n]))
        i += n
    return out


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, chars, density, replicated) of every document; both shares are 0 for null, empty and blank texts.

    density is the share of characters in list pieces. replicated is the share in those of them that carry
    a phrase which pages of HOSTS distinct hosts list. The list pieces of all pages count, also of those
    that are mostly prose. Phrases are deduplicated per host before they are counted, so one host's
    copies count once and a phrase of a third of all pages sends one row per host and task. A row
    delivered twice counts once; a null url is a host of its own.
    """
    host = F.coalesce(F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1), F.lit("")), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    docs = spread(documents.select("doc_id", "text", host.alias("host")).where("doc_id is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [evidence(t) if isinstance(t, str) else (0, 0, []) for t in b["text"]]
            kept = [[{"s": list(k), "n": n} for k, n in units] for _, _, units in rows]
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "chars": [r[0] for r in rows], "listed": [r[1] for r in rows], "units": kept})

    read = docs.mapInPandas(run, "doc_id long, host string, chars long, listed long, units array<struct<s:array<string>,n:long>>")
    seen = cut(read.select("doc_id", "host", "chars", "listed", F.transform("units", lambda u: F.struct(F.transform(u["s"], lambda s: F.xxhash64(s)).alias("s"), u["n"].alias("n"))).alias("units")).dropDuplicates(["doc_id"]))
    each = seen.where(F.size("units") > 0).select("doc_id", "host", F.posexplode("units").alias("unit", "x")).select("doc_id", "host", "unit", "x.n", F.explode("x.s").alias("s"))
    hosts = each.groupBy("s", "host").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= HOSTS)
    salted = hosts.select("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = each.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"], "left_semi")
    # a unit counts once however many of its shingles other hosts repeat
    copied = met.groupBy("doc_id", "unit").agg(F.max("n").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("copied"))
    total = F.greatest(F.col("chars"), F.lit(1))
    return seen.join(copied, "doc_id", "left").select("doc_id", "chars", (F.col("listed") / total).alias("density"), (F.least(F.coalesce("copied", F.lit(0)), "listed") / total).alias("replicated"))


def found(documents: DataFrame) -> DataFrame:
    """p9_found: the doc_ids of pages stitched mostly from list pieces whose phrases other hosts repeat."""
    return scores(documents).where(F.col("replicated") > DENSITY).select("doc_id")
