"""Generators: a text gives none to many rows of evidence. Everything stays in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import text as T

#: Confidence of what a source of a type says.
BASE = {"government_record": 0.85, "public_web": 0.55}
OTHER = 0.5


def base_confidence(source_type: Column) -> Column:
    out = F.lit(OTHER)
    for k, v in BASE.items():
        out = F.when(source_type == k, v).otherwise(out)
    return out


def contact_candidates(texts: DataFrame) -> DataFrame:
    """texts (…, source_type, text) -> one row per distinct e-mail or phone of a text: kind, value, confidence.

    A role's mailbox counts .15 less; a phone number .10 more than its source, .95 at most. Null texts give none.
    """
    none = F.array().cast("array<string>")
    kinds = F.concat(
        F.transform(F.coalesce(T.emails(F.col("text")), none), lambda x: F.struct(F.lit("email").alias("kind"), x.alias("value"))),
        F.transform(F.coalesce(T.phones(F.col("text")), none), lambda x: F.struct(F.lit("phone").alias("kind"), x.alias("value"))),
    )
    rows = texts.select(*[c for c in texts.columns if c != "text"], F.explode(kinds).alias("_x")).select("*", "_x.kind", "_x.value").drop("_x")
    base = base_confidence(F.col("source_type"))
    sure = F.when(F.col("kind") == "email", base - F.when(T.is_generic(F.col("value")), 0.15).otherwise(0.0)).otherwise(F.least(base + 0.10, F.lit(0.95)))
    return rows.withColumn("confidence", F.round(sure, 2))


def hits(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """texts with one row per match: hit and its 0-based start. Texts without a match fall away before anything is exploded."""
    some = texts.where(F.col(column).rlike(pattern))
    return some.select("*", F.explode(T.positions(F.col(column), pattern)).alias("_h")).select("*", "_h.start", "_h.hit").drop("_h")


def agenda_items(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item, number, subject) of the numbered lines of agendas; number is '' where none is named."""
    lines = texts.where(F.col("text").startswith("AGENDA")).select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("^[0-9]+[.] "))
    return lines.select(key, F.regexp_extract("line", "^([0-9]+)[.] ", 1).cast("bigint").alias("item"), F.regexp_extract("line", K.APPLICATION_NUMBER, 0).alias("number"), F.trim(F.regexp_extract("line", " - (.*)$", 1)).alias("subject"))


def scoped(events: DataFrame, items: DataFrame, document: str, at: str) -> DataFrame:
    """events within the item block (start, end] of their document that holds their position; others keep a null item.

    The equi-join on the document comes first; a block's range is the residual condition.
    """
    e, i = events.alias("e"), items.alias("i")
    on = (F.col(f"e.{document}") == F.col(f"i.{document}")) & (F.col(f"e.{at}") >= F.col("i.start")) & (F.col(f"e.{at}") < F.col("i.end"))
    return e.join(i, on, "left").select("e.*", F.col("i.item").alias("item"))


def item_blocks(texts: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """(key, item, start, end): from one match of a heading pattern to the next, or the end of the text."""
    marked = texts.select(key, F.length(column).alias("_n"), T.positions(F.col(column), pattern).alias("_p"))
    ends = F.transform("_p", lambda x, i: F.struct((i + 1).cast("bigint").alias("item"), x["start"].cast("bigint").alias("start"), F.coalesce(F.get("_p", i + 1)["start"], F.col("_n")).cast("bigint").alias("end")))
    return marked.select(key, F.explode(ends).alias("_b")).select(key, "_b.*")


def merged_signals(*columns: Column) -> Column:
    """How many of several signals agree, as a share of those stated."""
    stated = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    agree = sum((F.when(c, 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(stated > 0, agree / stated)
