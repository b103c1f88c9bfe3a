"""Signal events: deduplication by evidence, scores per key, dominance, and the ranked queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as K


def literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def best_events(events: DataFrame, keys: list[str], quality: Column, *ties: Column) -> DataFrame:
    """One event per key: the one of greatest quality; ties go to the least of the tie columns, in their order."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in events.columns if c not in keys]), F.struct(quality, *[-t for t in ties])).alias("_e")).select(*keys, "_e.*")


def score_by_key(events: DataFrame, keys: list[str], kind: str, confidence: Column, weights: dict[str, int] = K.SIGNAL_WEIGHT, bonus=K.SIGNAL_BONUS, cap: int = 100) -> DataFrame:
    """keys, score, signals: the best confidence of every kind times its weight, with bonuses for pairs of kinds.

    Two aggregations, both combined before their shuffles: the first leaves at most one row per key and
    kind. Everything is decimal up to the half-even rounding, so engines agree on ties.
    """
    per_kind = events.groupBy(*keys, kind).agg(F.max(confidence.cast("decimal(6,4)")).alias("_c"))
    weight = literal_map(weights)
    has = lambda k: F.max(F.when(F.col(kind) == k, 1).otherwise(0))
    plus = sum((F.when((has(a) == 1) & (has(b) == 1), n).otherwise(0) for a, b, n in bonus), F.lit(0))
    total = F.sum(F.col("_c") * F.try_element_at(weight, F.col(kind)).cast("decimal(6,0)")) + plus
    return per_kind.groupBy(*keys).agg(F.least(F.bround(F.coalesce(total, F.lit(0)), 0), F.lit(cap)).cast("bigint").alias("score"), F.array_sort(F.collect_set(kind)).alias("signals"))


def dominant(signals: Column, order: tuple[str, ...] = K.SIGNALS) -> Column:
    """The first of an order of dominance that an array has; null when it has none."""
    return F.get(F.filter(F.array(*[F.lit(s) for s in order]), lambda s: F.array_contains(signals, s)), 0)


def urgency(days: Column, future: Column) -> Column:
    return F.when(~future, "HISTORICAL").when(days.isNull(), "UNKNOWN").when(days <= 7, "URGENT").when(days <= 30, "SOON").otherwise("UPCOMING")


def queue_score(score: Column, future: Column, actionable: Column, days: Column, critical: Column) -> Column:
    near = F.when(days <= 7, 35).when(days <= 30, 20).when(days <= 90, 10).otherwise(0)
    raw = F.least(F.greatest(score, F.lit(0)), F.lit(100)) + F.when(future, 25).otherwise(0) + F.when(actionable, 15).otherwise(0) + F.when(future & days.isNotNull(), near).otherwise(0) + F.when(critical, 20).otherwise(0)
    return F.least(raw, F.lit(250)).cast("bigint")


def queue_level(score: Column, future: Column, actionable: Column, days: Column, critical: Column) -> Column:
    high = ((score >= 70) & actionable) | (critical & actionable) | (F.coalesce(days <= 7, F.lit(False)) & ((score >= 20) | actionable))
    return F.when(~future, "ARCHIVED").when(high, "HIGH").when((score >= 20) | actionable | F.coalesce(days <= 30, F.lit(False)), "MEDIUM").otherwise("LOW")


def queue_order(priority: Column, score: Column, friction: Column, days: Column, *ties: Column) -> list[Column]:
    """Rank, score and friction descending, then the nearest; unknown levels last, unknown days last."""
    rank = F.coalesce(F.try_element_at(literal_map(K.PRIORITY_RANK), priority), F.lit(0))
    return [rank.desc(), F.coalesce(score, F.lit(0)).desc(), F.coalesce(friction, F.lit(0)).desc(), F.coalesce(days, F.lit(10**9)).asc(), *ties]


def queue_order_by_date(priority: Column, score: Column, date: Column, *ties: Column) -> list[Column]:
    """The other order of the same queue: rank and score descending, then the earliest date, none last."""
    rank = F.coalesce(F.try_element_at(literal_map(K.PRIORITY_RANK), priority), F.lit(0))
    return [rank.desc(), F.coalesce(score, F.lit(0)).desc(), date.asc_nulls_last(), *ties]


def resolve_groups(rows: DataFrame, keys: list[str], label: Column, label_rank: Column, score: Column, time: Column, context: Column, position: Column) -> DataFrame:
    """One row per group of mentions: label and time by rank, score and having a time; the longest context; the greatest score.

    Each field has its own order, so each is its own max_by over one pass; earlier positions win ties.
    """
    key = F.struct(label_rank, score, time.isNotNull(), -position)
    confidence = F.bround(F.least(F.greatest(F.lit(0.55) + F.max(score) / 250, F.lit(0.5)), F.lit(0.99)), 2)
    return rows.groupBy(*keys).agg(
        F.max_by(label, key).alias("label"), F.max_by(time, F.when(time.isNotNull(), key)).alias("time"), F.max_by(context, F.struct(F.length(context), -position)).alias("context"),
        F.max(score).alias("score"), confidence.alias("confidence"),
    )
