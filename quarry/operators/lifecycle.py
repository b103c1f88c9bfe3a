"""A keyed state machine over ordered events, the same transition for the batch fold and the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States by rank, the state that every event leads to, and those that close a key.
RANK = {"NEW": 0, "QUALIFIED": 1, "READY": 2, "CONTACTED": 3, "REPLIED": 4, "ENGAGED": 5, "OPPORTUNITY": 6, "WON": 7, "LOST": 7}
TARGET = {"prepared": "READY", "sent": "CONTACTED", "response": "REPLIED", "engaged": "ENGAGED", "opportunity": "OPPORTUNITY", "won": "WON", "lost": "LOST"}
#: How the driver's event types stand for events.
EVENTS_TO_STATES = ("signup", "response", "view", "prepared", "click", "sent", "purchase", "won", "error", "lost")


def after(state: str, event: str | None) -> str:
    """The state after one event: it never goes back in rank, but "lost" always counts; an unknown event changes nothing."""
    to = TARGET.get(event or "")
    return to if to and (to == "LOST" or RANK[to] >= RANK[state]) else state


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def step(state: Column, event: Column) -> Column:
    """The same transition as a column."""
    to = F.try_element_at(_map(TARGET), event)
    rank = lambda s: F.try_element_at(_map(RANK), s)
    return F.when(to.isNotNull() & ((to == "LOST") | (rank(to) >= rank(state))), to).otherwise(state)


def fold_states(events: DataFrame, key: str, order: list[str], event: str, start: str = "NEW") -> DataFrame:
    """(key, state, events) after all events of every key in order.

    The closing states end every later change but a later closing one, so the fold's result is an
    aggregate: the last closing event's state, or else the target of greatest rank. It combines before
    the shuffle; a key with a third of all events is no longer than any other.
    """
    to = F.try_element_at(_map(TARGET), F.col(event))
    rank = F.coalesce(F.try_element_at(_map(RANK), to), F.lit(-1))
    rows = events.select(key, F.struct(*order).alias("_o"), to.alias("_to"), rank.alias("_r"))
    closing = F.max(F.when(F.col("_r") == 7, F.struct("_o", "_to")))
    best = F.max(F.when(F.col("_r") >= RANK[start], F.struct("_r", "_to")))
    return rows.groupBy(key).agg(closing.alias("_c"), best.alias("_b"), F.count("*").alias("events")).select(key, F.coalesce("_c._to", "_b._to", F.lit(start)).alias("state"), "events")


def history(events: DataFrame, key: str, order: list[str], event: str, start: str = "NEW") -> DataFrame:
    """(key, log): every event with the state before and after it, by the real fold; for keys of bounded length.

    The log is one array per key by nature; states alone come from fold_states.
    """
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("event")))).alias("_l"))
    seed = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<event:string,previous:string,resulting:string>>").alias("log"))
    def one(acc: Column, x: Column) -> Column:
        new = step(acc["state"], x["event"])
        return F.struct(new.alias("state"), F.concat(acc["log"], F.array(F.struct(x["event"].alias("event"), acc["state"].alias("previous"), new.alias("resulting")))).alias("log"))
    return listed.select(key, F.aggregate("_l", seed, one).alias("_a")).select(key, "_a.state", "_a.log")
