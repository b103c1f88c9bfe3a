"""Problem 3: rows whose typed names denote the same person or organisation.

A symmetric-delete index over the distinct words finds words within one edit of each other; names
that share the candidates of all their words meet under one key and are compared by optimal
assignment of words, with nicknames, initials, abbreviated lines of business and split words
permitted. Rows are then given a class; links are the pairs within a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import names as N
from quarry.operators import rows as R
from quarry.operators.components import connected_components
from quarry.session import cut

#: A word of this share of all names, four at least, is established: it is a misspelling only of one eight times as frequent.
ESTABLISHED, LEAST_ESTABLISHED, MORE = 5e-5, 4, 8

PARSED = "name string, core array<string>, initials array<string>, business string, legal string, joined boolean"


def parse_names(names: DataFrame) -> DataFrame:
    """The distinct names of a one-column table `name` with their parts; null, blank and filler names fall away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(n, r) for n in b["name"] if (r := N.parse(n))]
            yield pd.DataFrame([{"name": n} | r for n, r in got], columns=["name", "core", "initials", "business", "legal", "joined"])

    return names.select("name").where("name is not null").distinct().mapInPandas(run, PARSED)


def signatures(parsed: DataFrame) -> DataFrame:
    """parsed with sig: names that differ in case, blanks, accents, punctuation or a legal form's writing share one."""
    parts = [F.concat_ws(" ", "core"), F.concat_ws(" ", "initials"), F.coalesce("business", F.lit("")), F.coalesce("legal", F.lit(""))]
    return parsed.withColumn("sig", F.xxhash64(*parts))


def word_candidates(sigs: DataFrame) -> DataFrame:
    """(word, heads): the word itself, the given names it abbreviates and the more frequent words within one edit.

    The index holds each word under itself and under every text that one deletion leaves, so words one
    edit or one transposition apart share an entry. A word that is itself well established is no
    misspelling: it links to another only where that one is eight times as frequent.
    """
    # neighbouring words run together, as names.merged writes them
    run = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)))
    established = max(LEAST_ESTABLISHED, int(ESTABLISHED * sigs.count()))
    own = sigs.select(F.explode("core").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    run_together = sigs.where(F.size("core") > 1).select(F.explode(F.concat("core", run(F.col("core")))).alias("word")).distinct()
    words = cut(run_together.join(own, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    left_by = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    index = words.where(F.length("word") >= 4).select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), left_by(F.col("word"))))).alias("k")).select("word", "n", F.xxhash64("k").alias("k"))
    a, b = index.toDF("word", "n", "k"), index.where("n > 0").toDF("head", "m", "k")
    lev = F.levenshtein("word", "head")
    swapped = (F.length("word") == F.length("head")) & (lev == 2) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("head", "")))
    near = (
        a.join(b, "k").where(f"word <> head and m >= n and not (n >= {established} and m < {MORE} * n)").where((lev == 1) | swapped)
        .select("word", "head").distinct().groupBy("word").agg(F.array_sort(F.collect_list("head")).alias("near"))
    )
    return words.join(near, "word", "left").select("word", F.array_distinct(F.concat(written_for(F.col("word")), F.coalesce("near", F.array().cast("array<string>")))).alias("heads"))


def written_for(word: Column) -> Column:
    """The word and the given names it may abbreviate."""
    nick = F.create_map(*[x for k, v in N.NICK.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return F.concat(F.array(word), F.coalesce(F.try_element_at(nick, word), F.array().cast("array<string>")))


def name_keys(sigs: DataFrame, heads: DataFrame) -> DataFrame:
    """(sig, key): a key per choice of candidates for all words of a name, in any order; initials are keyed with the last word.

    The words as written are always a key. Another writing of a single word is one only from six letters on, as in aligned.
    """
    variants = F.udf(lambda core, initials: [list(v) for v in N.merged(list(core))] if len(core) > 1 or not initials else [], "array<array<string>>")
    words = sigs.select("sig", F.posexplode(variants("core", "initials")).alias("v", "ws")).select("sig", "v", F.posexplode("ws").alias("p", "word"))
    sets = words.join(heads, "word").groupBy("sig", "v").agg(F.collect_list("heads").alias("sets"))

    @F.pandas_udf("array<string>")
    def combined(sets: pd.Series) -> pd.Series:
        return pd.Series([sorted({" ".join(sorted(c)) for c in product(*s) if len(c) > 1 or len(c[0]) >= 6 or c[0] == s[0][0]}) for s in sets])

    return sets.select("sig", F.explode(combined("sets")).alias("key")).distinct()


def initial_keys(sigs: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, key) of names that give only initials with a last word, and of the two-word names they may stand for."""
    few = sigs.where("size(core) = 1 and size(initials) > 0").select("sig", F.col("core")[0].alias("word"), F.col("initials")[0].alias("i"))
    short = few.join(heads, "word").select("sig", F.explode("heads").alias("h"), "i").select("sig", F.concat_ws(" ", "i", "h").alias("key"))
    two = sigs.where("size(core) = 2 and business is null and legal is null and not joined")
    starts = lambda w: F.array_sort(F.array_distinct(F.transform(written_for(w), lambda x: F.left(x, F.lit(1)))))
    full = two.select("sig", F.col("core")[1].alias("word"), F.explode(starts(F.col("core")[0])).alias("i")).join(heads, "word").select("sig", F.explode("heads").alias("h"), "i")
    return short.distinct(), full.select("sig", F.concat_ws(" ", "i", "h").alias("key")).distinct()


def compared(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, weak) of the pairs whose words align and whose stated parts agree; weak where one leaves out its line of business."""
    side = lambda x: sigs.select(F.col("sig").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("core", "initials", "business", "legal")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [
                N.aligned(list(c), list(d)) and (not len(i) or not len(j) or i[-1] == j[-1])
                for c, d, i, j in zip(p["a_core"], p["b_core"], p["a_initials"], p["b_initials"], strict=True)
            ]
            yield p.loc[ok, ["a", "b", "weak"]]

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where("a_business is null or b_business is null or a_business = b_business").where("a_legal is null or b_legal is null or a_legal = b_legal")
    return both.withColumn("weak", F.expr("(a_business is null) <> (b_business is null)")).mapInPandas(run, "a long, b long, weak boolean")


def classes(rows: DataFrame, prepared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, name, place, sig, entity) of rows (id, name, place, company), one row per id; entity is null where nobody is named.

    Names that state all their parts are classed by connected components of compared pairs. A name that
    leaves out its line of business, or all but the initials, goes to the one class it can stand for;
    where there are several, to the one whose rows share its place or company, and else to a class of
    its own. Null, blank and filler names have no class. Repeated rows count once; rows are never paired
    here, so a name that a third of all rows bear costs one signature. prepared: signatures and word
    candidates that cover the rows' names and companies already.
    """
    rows = rows.groupBy("id").agg(F.min(F.struct("name", "place", "company")).alias("r")).select("id", "r.name", F.nullif(F.lower(F.trim("r.place")), F.lit("")).alias("place"), "r.company")
    all_parsed = prepared[0] if prepared else cut(signatures(parse_names(rows.select("name").union(rows.select("company")))))
    parsed = all_parsed.join(rows.select("name").distinct(), "name", "left_semi")
    sigs = cut(parsed.dropDuplicates(["sig"]).drop("name"))
    heads = prepared[1] if prepared else cut(word_candidates(sigs))
    keys = cut(name_keys(sigs, heads))
    b = keys.withColumnRenamed("sig", "b")
    pairs = keys.withColumnRenamed("sig", "a").join(b, "key").where("a < b").select("a", "b").distinct()
    links = cut(compared(pairs, sigs))
    strong = connected_components(links.where("not weak").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    base = cut(sigs.join(strong.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "core", "initials", "business", F.coalesce("component", "sig").alias("class")))

    # what a short form can stand for: classes that state the business it leaves out, full names its initials begin
    of = base.select("sig", "class", "business")
    weak = links.where("weak").select("a", "b").union(links.where("weak").select("b", "a")).toDF("sig", "to")
    fuller = weak.join(base.where("business is null").select("sig"), "sig", "left_semi").join(of.select(F.col("sig").alias("to"), "class"), "to").select("sig", "class")
    short, full = initial_keys(sigs, heads)
    named = short.join(full.withColumnRenamed("sig", "to"), "key").select("sig", "to").distinct()
    named = named.join(sigs.select("sig", F.col("core").alias("c"), F.col("initials").alias("i")), "sig").join(sigs.select(F.col("sig").alias("to"), F.col("core").alias("d"), F.col("initials").alias("j")), "to")
    fits = F.udf(lambda i, c, d, j: N.initials_fit(list(i), c[0], list(d), list(j)), "boolean")
    begun = named.where(fits("i", "c", "d", "j")).join(of.select(F.col("sig").alias("to"), "class"), "to").select("sig", "class")
    options = cut(fuller.union(begun).distinct())

    held = rows.join(parsed.select("name", "sig"), "name")
    firm = F.concat_ws(" ", F.when(F.col("joined"), F.array_sort("core")).otherwise(F.col("core")))
    company = all_parsed.select(F.col("name").alias("company"), firm.alias("firm"))
    held = cut(held.join(company, "company", "left").select("id", "name", "place", "firm", "company", "sig"))
    sure = held.join(options.select("sig").distinct(), "sig", "left_anti").join(of.select("sig", "class"), "sig")
    # a class is known by places and firms of its sure rows
    known = sure.select("class", F.explode(F.array(F.concat(F.lit("p:"), "place"), F.concat(F.lit("f:"), "firm"))).alias("mark")).where("mark is not null").distinct()
    unsure = held.join(options, "sig").select("id", "sig", "class", F.explode(F.array(F.lit(None).cast("string"), F.concat(F.lit("p:"), "place"), F.concat(F.lit("f:"), "firm"))).alias("mark"))
    hits = cut(unsure.join(known.withColumn("hit", F.lit(1)), ["class", "mark"], "left").groupBy("id", "sig", "class").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits")))
    best = hits.groupBy("id", "sig").agg(F.max(F.struct("hits", "class")).alias("top"), F.count("*").alias("n"), F.collect_list("hits").alias("all"))
    lone = F.size(F.filter("all", lambda h: h == F.col("top.hits"))) == 1
    chosen = best.select("id", F.when((F.col("n") == 1) | (lone & (F.col("top.hits") > 0)), F.col("top.class")).alias("choice"))
    own = of.select("sig", F.col("class").alias("own"))
    placed = held.join(chosen, "id", "left").join(own, "sig")
    # initials nobody completes: the same letters and last word at the same place
    alone = placed.join(sigs.where("size(core) = 1 and size(initials) > 0").select("sig", F.lit(True).alias("short")), "sig", "left")
    entity = F.coalesce("choice", F.when(F.col("short"), F.xxhash64("sig", F.coalesce("place", "firm", F.col("id").cast("string")))), "own")
    return alone.select("id", "name", "place", "firm", "company", "sig", entity.alias("entity"))


def rows_of(opportunity: DataFrame, pud: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(id, name, place, company) of the three tables' name fields."""
    none = F.lit(None).cast("string")
    a = opportunity.select(F.col("lead_id").alias("id"), F.col("applicant_name").alias("name"), F.col("applicant_locality").alias("place"), F.col("applicant_entity").alias("company"))
    return a.union(pud.select("pud_id", "owner_entity", none, none)).union(enrichment.select("enrichment_id", "company_name", none, none)).where("id is not null")


def found(rows: DataFrame) -> DataFrame:
    """p3_found: (left_id, right_id), smaller id first, of rows of one class whose stored names differ. A class of many rows is paired in parts."""
    c = cut(classes(rows).where("entity is not null").select("id", "name", "entity"))
    other = c.toDF("right_id", "other", "entity")
    return R.split_join(c.withColumnRenamed("id", "left_id"), other, "entity").where("left_id < right_id and name <> other").select("left_id", "right_id")


def members(rows: DataFrame) -> DataFrame:
    """(id, entity, links) of every row that names somebody: its class, and how many rows of it are written otherwise. No pairs are made."""
    c = cut(classes(rows).where("entity is not null").select("id", "name", "entity"))
    alike = c.groupBy("entity", "name").agg(F.count("*").alias("alike"))
    size = alike.groupBy("entity").agg(F.sum("alike").alias("size"))
    return c.join(alike.join(size, "entity"), ["entity", "name"]).select("id", "entity", (F.col("size") - F.col("alike")).alias("links"))
