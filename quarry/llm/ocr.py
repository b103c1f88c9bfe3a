"""Problem 4: noise in text from scanned pages, found line by line and repaired.

The corpus gives the words and page-edge lines that are common; word vectors factorise how often
common words stand together in all of it. A rare word is linked to frequent words that a plausible misreading of glyphs
separates it from, and the context chooses among them. Words broken at line ends are rejoined, running
headers, footers and page numbers are removed, and the rest is set as paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, spread

#: Words and lines of at least this share of documents are the model. Their number is at most the mean
#: number of distinct words (lines) of a document divided by the share, however many documents there are.
COMMON, LEAST_DOCS = 0.001, 3
#: More common words than this are an error instead of being broadcast.
MOST_WORDS = 2_000_000
#: A word is a misreading of a neighbour that is this many times as frequent.
RATIO = 20
#: Of the vectors: dimensions, window, rounds of the factorisation.
DIM, WINDOW, ROUNDS = 24, 2, 4
EDGE_TOP, EDGE_BOTTOM, LONGEST_EDGE = 4, 3, 64
#: Furniture repeats on several pages in this share of the documents that have it at all.
REPEATED = 0.5
#: A page-edge line is furniture where at most this share of its occurrences stand inside pages.
INSIDE = 0.05

MARKER = re.compile(r"--- PAGE \d+ ---\s*")
NOISE = "|^~•*`´'¦"
#: What scanners read for what is printed, each as misread -> printed.
MISREAD = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("@", "a"), ("3", "e"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"),
    ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("f", "t"), ("t", "f"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("n", "m"), ("m", "n"), ("v", "y"), ("nn", "m"), ("tl", "d"), ("lc", "k"), ("lx", "k"), ("$", "s"), ("!", "l"), ("(", "c"), ("ni", "m"), ("in", "m"), ("iii", "m"),
    ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"),
]
STRIP = ".,;:()[]\"“”?!%"
MONTHS = re.compile(r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b")
SKELETON = str.maketrans({"0": "o", "1": "l", "5": "s", "@": "a", "6": "b"})


class Model(NamedTuple):
    words: dict[str, int]  # document counts of common words
    docs: int
    edges: set[str]  # keys of furniture lines
    ends: set[str]  # the first and last letters of those keys
    vectors: dict[str, np.ndarray]
    patterns: dict[str, list[str]]  # a word with one letter left out in place -> common words


def words_of(line: str) -> list[str]:
    """The words of a line in lower case without punctuation at their ends."""
    return [w for t in line.split() if (w := t.strip(STRIP).lower())]


def line_key(line: str) -> str:
    """A line without its numbers, dates and case, so that a header's line is the same on all pages."""
    text = " ".join(line.lower().split())
    text = MONTHS.sub("month", text)
    return re.sub(r"\d+", "9", re.sub(r"(?<=[a-z])[0156@](?=[a-z])", lambda m: m[0].translate(SKELETON), text))


def pages_of(lines: list[str]) -> list[list[int]]:
    """The line numbers (from 0) of each page's lines that are not blank, by the parser's markers."""
    pages: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if MARKER.fullmatch(line):
            pages.append([])
        elif line.strip():
            pages[-1].append(i)
    return [p for p in pages if p]


def edge_lines(page: list[int]) -> set[int]:
    return set(page[:EDGE_TOP]) | set(page[-EDGE_BOTTOM:])


def statistics(texts: DataFrame) -> DataFrame:
    """(kind, key, n): documents per word ("w"), per page-edge line ("e"), per line on the edges of several of its pages ("r"),
    per line standing alone inside a page ("i"), and their number ("d"). Counts are added up per batch before they travel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, e, r, i, d = Counter(), Counter(), Counter(), Counter(), 0
            for text in b["text"]:
                if not isinstance(text, str) or not text.strip():
                    continue
                d += 1
                w.update({x.strip(STRIP) for x in set(text.lower().split())})
                lines = text.split("\n")
                edge, inside = Counter(), set()
                for page in pages_of(lines):
                    at = edge_lines(page)
                    edge.update({line_key(lines[k]) for k in at if len(lines[k]) <= LONGEST_EDGE})
                    inside.update(line_key(lines[k]) for k in page if k not in at and len(lines[k]) <= LONGEST_EDGE and not lines[k - 1].strip() and not lines[k + 1].strip())
                e.update(edge.keys())
                r.update(k for k, n in edge.items() if n > 1)
                i.update(inside)
            rows = [("d", "", d)] + [("w", k, n) for k, n in w.items() if k and not k.isdigit()] + [(kind, k, n) for kind, c in (("e", e), ("r", r), ("i", i)) for k, n in c.items()]
            yield pd.DataFrame(rows, columns=["kind", "key", "n"])

    return spread(texts.select("text")).mapInPandas(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def together(texts: DataFrame, number: dict[str, int]) -> DataFrame:
    """(a, b, n): how often two different numbered words stand within the window of each other in a paragraph, in both orders, over all texts.

    Each word's rows lie in one partition in a fixed order, so sums over them repeat exactly.
    """
    size, gap = len(number), [-1] * WINDOW

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: list[int] = []
            for t in batch["text"]:
                for p in re.split(r"\n\s*\n", t):
                    ids += [number[w] for w in words_of(p) if w in number]
                    ids += gap
            x, keys = np.array(ids, "int64"), []
            for d in range(1, WINDOW + 1):
                p, q = x[:-d], x[d:]
                ok = (p >= 0) & (q >= 0) & (p != q)
                keys.append(np.minimum(p, q)[ok] * size + np.maximum(p, q)[ok])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})

    counted = spread(texts.where(F.length("text") > 0).select("text")).mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    low, high = F.expr(f"key div {size}"), F.col("key") % size
    both = counted.select(F.explode(F.array(F.struct(low.alias("a"), high.alias("b")), F.struct(high.alias("a"), low.alias("b")))).alias("p"), "n").select("p.a", "p.b", "n")
    return both.repartition("a").sortWithinPartitions("a", "b")


def factors(pairs: DataFrame, size: int) -> np.ndarray:
    """Unit vectors of the words from the positive mutual information of all pairs, the matrix that skip-gram factorises.

    Subspace iteration: each round multiplies the pairs, where they lie, with one column block; only
    the words' vectors travel. A word that stands beside no other keeps a vector of zeros.
    """
    pairs = cut(pairs)
    n = np.zeros(size)
    for r in pairs.groupBy("a").agg(F.sum("n").alias("n")).collect():
        n[r["a"]] = r["n"]
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((size, min(DIM, size))))[0]
    for _ in range(ROUNDS):
        shared = pairs.sparkSession.sparkContext.broadcast((n, basis))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            n, basis = shared.value
            out, seen = np.zeros_like(basis), np.zeros(len(n), bool)
            for p in batches:
                a, b = p["a"].to_numpy(), p["b"].to_numpy()
                value = np.maximum(np.log(p["n"].to_numpy() * n.sum() / (n[a] * n[b])), 0)
                seen[a] = True
                for k in range(basis.shape[1]):
                    out[:, k] += np.bincount(a, weights=value * basis[b, k], minlength=len(n))
            at = np.flatnonzero(seen)
            yield pd.DataFrame({"a": at, "v": [out[i].tobytes() for i in at]})

        product = np.zeros_like(basis)
        for r in pairs.mapInPandas(run, "a long, v binary").collect():
            product[r["a"]] = np.frombuffer(bytes(r["v"]))
        shared.destroy()
        before, basis = basis, np.linalg.qr(product)[0]
    small = before.T @ product
    values, turned = np.linalg.eigh((small + small.T) / 2)
    v = before @ turned * np.sqrt(np.abs(values))
    v[n == 0] = 0
    return (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype("float32")


def learn(texts: DataFrame, vectors: bool = True) -> tuple[dict, int, set, list, np.ndarray | None]:
    """The model's parts as plain values: word counts, documents, furniture keys, the vectors' words and the vectors."""
    stats = cut(statistics(texts))
    docs = stats.where("kind = 'd'").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_DOCS, int(COMMON * docs))
    rows = stats.where((F.col("kind") == "w") & (F.col("n") >= least)).select("key", "n").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words; raise COMMON")
    words = {r["key"]: r["n"] for r in rows}
    of = lambda kind, name: stats.where(F.col("kind") == kind).select("key", F.col("n").alias(name))
    edge = of("e", "n").where(F.col("n") >= least).join(of("r", "repeated"), "key").join(of("i", "inside"), "key", "left")
    edges = {r["key"] for r in edge.where((F.col("repeated") >= REPEATED * F.col("n")) & (F.coalesce("inside", F.lit(0)) <= INSIDE * F.col("n"))).collect()}
    names, trained = [], None
    if vectors and words:
        names = sorted(w for w in words if w.isalpha())
        number = {w: i for i, w in enumerate(names)}
        trained = factors(together(texts, number), len(names)) if names else None
    return words, docs, edges, names, trained


def model_of(parts: tuple) -> Model:
    words, docs, edges, names, vectors = parts
    patterns: dict[str, list[str]] = {}
    for w in words:
        if w.isalpha() and len(w) >= 3:
            for i in range(len(w)):
                patterns.setdefault(w[:i] + "\0" + w[i + 1 :], []).append(w)
    return Model(words, docs, edges, {k[:4] for k in edges} | {k[-4:] for k in edges}, {n: vectors[i] for i, n in enumerate(names)} if vectors is not None else {}, patterns)


def readings(word: str, model: Model) -> list[str]:
    """The common words that a plausible misreading separates the word from."""
    out: dict[str, int] = {}
    common = model.words
    marks = [i for i, c in enumerate(word) if c in NOISE]
    for i in marks:
        rest = word[:i] + word[i + 1 :]
        if rest in common:
            out[rest] = 1
        for v in model.patterns.get(word[:i] + "\0" + word[i + 1 :], ()):
            out[v] = 1
        if len(marks) > 1:
            for j in marks:
                if j > i and (w := word[:i] + word[i + 1 : j] + word[j + 1 :]) in common:
                    out[w] = 1
    once = set()
    for bad, good in MISREAD:
        i = word.find(bad)
        while i >= 0:
            v = word[:i] + good + word[i + len(bad) :]
            once.add(v)
            if v in common:
                out[v] = 1
            i = word.find(bad, i + 1)
    if not out and not word.isalpha() and len(word) >= 5:  # two misread glyphs, one of them no letter
        for x in once:
            for bad, good in MISREAD:
                i = x.find(bad)
                while i >= 0:
                    if (v := x[:i] + good + x[i + len(bad) :]) in common:
                        out[v] = 1
                    i = x.find(bad, i + 1)
    out.pop(word, None)
    return [v for v in out if v.isalpha() or "-" in v]


class Reader:
    """Corrections under one model; what a word can be is worked out once."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        #: Tokens as they stand in lines that were found sound, to pass over whole lines; only a cache.
        self.fine: set[str] = set()

    def options(self, word: str) -> list[str]:
        """Frequent words that a word may be a misreading of; none for a sound word."""
        if word not in self.known:
            if len(self.known) > FINE:
                self.known.clear()  # only a cache
            self.known[word] = self._options(word)
        return self.known[word]

    def _options(self, word: str) -> list[str]:
        letters = sum(c.isalpha() for c in word)
        if letters < 2 or letters * 2 < len(word):
            return []
        own = self.model.words.get(word, 0)
        if word.isalpha() and len(word) < 3:
            return []
        floor = max(own * RATIO, LEAST_DOCS) if not word.isalpha() or len(word) > 3 else max(own * 3 * RATIO, LEAST_DOCS * 3, 0.02 * self.model.docs)
        # a reading that is itself a misreading of something more frequent is none
        return [v for v in readings(word, self.model) if self.model.words[v] >= floor and not self.options(v)]

    def sound(self, word: str) -> bool:
        return word in self.model.words and not self.options(word)

    def best(self, word: str, around: list[str]) -> str | None:
        """The option that the words around it favour: its vector's cosine with theirs, and its frequency."""
        options = self.options(word)
        if len(options) < 2:
            return options[0] if options else None
        near = [self.model.vectors[w] for w in around if w in self.model.vectors]
        context = sum(near) / (np.linalg.norm(sum(near)) + 1e-9) if near else None

        def score(v: str) -> float:
            fit = float(self.model.vectors[v] @ context) if context is not None and v in self.model.vectors else 0.0
            return 2 * fit + 0.25 * float(np.log(self.model.words[v]))

        return max(sorted(options), key=score)

    def token(self, raw: str, around: list[str]) -> str | None:
        """A token with its misread word put right, or None where it is sound."""
        core = raw.strip(STRIP)
        low = core.lower()
        if not low or low in self.model.words and low in self.known and not self.known[low]:
            return None
        v = self.best(low, around)
        if v is None and "-" in low:
            parts = low.split("-")
            fixed = [p if len(p) < 4 or self.model.words.get(p) and not self.options(p) else self.best(p, around) or p for p in parts]
            v = "-".join(fixed) if fixed != parts else None
        if v is None:
            return None
        new = v.upper() if core.isupper() or sum(c.isupper() for c in core) > 1 and not any(c.islower() for c in core) else v[:1].upper() + v[1:] if core[:1].isupper() or core[:1] in "015|" and raw[:1] != core[:1] else v
        return raw.replace(core, new, 1)


FINE = 500_000
HYPHENS = ("-", "­", "¬")


def read(text: str, reader: Reader) -> tuple[list[tuple[int, str]], list[tuple[int, str, bool]]]:
    """(defects, lines): defects are (line number from 1, kind); lines are the body's (number, repaired text, joined on without a blank)."""
    lines = text.split("\n")
    model, furniture = reader.model, set()
    for page in pages_of(lines):
        for i in edge_lines(page):
            if len(lines[i]) <= LONGEST_EDGE and ((key := line_key(lines[i])) in model.edges or near_key(key, model)):
                furniture.add(i)
    body = [i for i, line in enumerate(lines) if line.strip() and i not in furniture and not MARKER.fullmatch(line)]
    defects = {(i + 1, "furniture") for i in furniture}
    out: list[tuple[int, str, bool]] = []
    held = ""  # the first part of a word that goes on in this line
    for k, i in enumerate(body):
        tokens = lines[i].split()
        if not held and reader.fine.issuperset(tokens):
            out.append((i, " ".join(tokens), False))
            continue
        around = [w for w in (t.strip(STRIP).lower() for t in tokens) if w in model.vectors]
        skip_first, carried = bool(held), held
        held = ""
        on = False
        new = []
        last = len(tokens) - 1
        for j, t in enumerate(tokens):
            if j == 0 and skip_first:
                whole = carried + t
                fixed = reader.token(whole, around)
                if fixed is not None:  # the misread glyph stands in this line or in the one before
                    v = fixed.strip(STRIP).lower()
                    first = body[k - 1] + 1 if not v.startswith(carried.lower()) else i + 1
                    defects.add((first, "garbled"))
                new.append(fixed or whole)
                continue
            if j == last and k + 1 < len(body) and t[-1] in HYPHENS and len(t) > 1 and any(c.isalpha() for c in t):
                following = lines[body[k + 1]].split()[0]
                if goes_on(t, following, reader):
                    defects.add((i + 1, "split"))
                    held, on = t[:-1], True
                    continue
            fixed = reader.token(t, around)
            if fixed is not None:
                defects.add((i + 1, "garbled"))
            elif t[-1] not in HYPHENS and len(reader.fine) < FINE:
                reader.fine.add(t)
            new.append(fixed or t)
        out.append((i, " ".join(new), on))
    return sorted(defects), out


def near_key(key: str, model: Model) -> bool:
    """Whether a page-edge line is a furniture key in which one glyph was misread."""
    if not 4 < len(key) or key[:4] not in model.ends and key[-4:] not in model.ends:
        return False
    for bad, good in (*MISREAD, ("9", "g"), ("9", "o"), ("9", "l"), ("9", "s"), ("9", "b"), ("9", "i")):
        i = key.find(bad)
        while i >= 0:
            if key[:i] + good + key[i + len(bad) :] in model.edges:
                return True
            i = key.find(bad, i + 1)
    for i, c in enumerate(key):
        if c in NOISE and (key[:i] + key[i + 1 :] in model.edges or any(key[:i] + x + key[i + 1 :] in model.edges for x in "abcdefghijklmnopqrstuvwxyz")):
            return True
    return False


def goes_on(token: str, following: str, reader: Reader) -> bool:
    """Whether a token at a line's end and the next line's first one are one word without the hyphen."""
    a, b = token[:-1].strip(STRIP).lower(), following.strip(STRIP).lower()
    if not b or not b[0].isalpha() and b[0] not in NOISE + "0156@9":
        return False
    if token[-1] != "-":
        return True
    whole, compound = reader.model.words.get(a + b, 0), reader.model.words.get(f"{a}-{b}", 0)
    if whole or compound:
        return whole >= compound
    if reader.options(a + b):
        return True
    if reader.options(f"{a}-{b}"):
        return False
    parts = b.split("-")
    if a in reader.model.words and (parts[0] in reader.model.words):
        return False
    return "-" not in a and a.isalpha()


def paragraphs(lines: list[str], body: list[tuple[int, str, bool]]) -> str:
    """The body's lines as paragraphs: a blank line parts them, unless a sentence runs on over it."""
    out: list[str] = []
    before, joined = -2, False
    for i, text, on in body:
        gap = any(not lines[j].strip() for j in range(before + 1, i)) if before >= 0 else True
        run_on = bool(out) and not re.search(r"[.!?:\"”)]$", out[-1]) and text[:1].islower()
        if out and (joined or not gap or run_on):
            kept = out[-1][-1:] == "-" and out[-1][-2:-1].isalpha() and text[:1].isalnum()  # a hyphen that belongs to the word
            out[-1] += text if kept or not out[-1] else f" {text}"
        elif text:
            out.append(text)
        before, joined = i, on
    return "\n\n".join(out)


def defects(documents: DataFrame) -> DataFrame:
    """p4_found: (parsed_id, line_no, kind) of every defect, distinct. Null and empty texts have none."""
    parts = learn(documents)
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model_of(shared.value))
        for b in batches:
            out = [(p, n, k) for p, t in zip(b["parsed_id"], b["text"], strict=True) for n, k in read(t, reader)[0]]
            yield pd.DataFrame(out, columns=["parsed_id", "line_no", "kind"])

    some = spread(documents.where(F.col("parsed_id").isNotNull() & (F.length("text") > 0)).select("parsed_id", "text"))
    return some.mapInPandas(run, "parsed_id long, line_no int, kind string").distinct()


def repaired(documents: DataFrame) -> DataFrame:
    """(parsed_id, text): continuous readable paragraphs, one row per distinct id and text; null and blank texts stay as they are."""
    parts = learn(documents)
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model_of(shared.value))
        for b in batches:
            fixed = [paragraphs(t.split("\n"), read(t, reader)[1]) if isinstance(t, str) and t.strip() else t for t in b["text"]]
            yield pd.DataFrame({"parsed_id": b["parsed_id"], "text": fixed})

    one = documents.select("parsed_id", "text", F.xxhash64("text").alias("h")).dropDuplicates(["parsed_id", "h"]).drop("h")
    return one.mapInPandas(run, "parsed_id long, text string")
