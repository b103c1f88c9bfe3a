"""Problem 8: combine sources to target weights by size in tokens, repeating a document at most a capped number of times.

Quotas come from capped water-filling: a source that cannot fill its share is clamped at its maximum
epochs and the excess is shared among the others in proportion to their weights, until all fit. A
source's quota is whole repetitions of all its documents and a seeded fraction for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import bpe
from quarry.session import cut

SEED = 17
#: A source's documents are hashed into slices of about so many; the running sum of a quota goes over slices, then within one.
SLICE, LEAST_SLICES = 50_000, 4096
#: A mix names at most so many sources; their totals are the only thing the driver sees.
MOST_SOURCES = 10_000


def water_fill(sources: dict[str, tuple[float, int, float]], total: float | None = None) -> dict[str, float]:
    """Tokens per source from {source: (weight, tokens available, most repetitions)}.

    Without a total the largest one is taken at which every source with documents still reaches its
    share of the mix. A source without documents or weight gets nothing; its weight goes to the others
    in proportion. With a larger total, sources are clamped at what their repetitions can supply.
    """
    room = {s: a * m for s, (w, a, m) in sources.items() if w > 0 and a * m > 0}
    weight = {s: sources[s][0] for s in room}
    if not room:
        return dict.fromkeys(sources, 0.0)
    if total is None:
        total = min(room[s] / weight[s] for s in room) * sum(weight.values())
    quota: dict[str, float] = {}
    left, open_ = min(total, sum(room.values())), set(room)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= room[s] * (1 - 1e-12)}
        if not full:
            quota |= {s: weight[s] * unit for s in open_}
            break
        quota |= {s: float(room[s]) for s in full}
        left -= sum(room[s] for s in full)
        open_ -= full
        left = max(left, 0.0)
    return {s: quota.get(s, 0.0) for s in sources}


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), one row per document: sources without surrounding blanks, null for a blank one."""
    named = F.nullif(F.trim("source"), F.lit(""))
    rows = bpe.sizes(documents.where("doc_id is not null").select("doc_id", "text", named.alias("source")), keep=("source",))
    return rows.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.source", "r.tokens")


def quotas(docs: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple[str, float, int, int, float]]:
    """(source, target_share, available, max_repeats, quota) of every target, from documents of known sizes (doc_id, source, tokens).

    Only the totals of the sources, of which a mix has a bounded number, reach the driver.
    """
    named = F.nullif(F.trim("source"), F.lit(""))
    plan = targets.select(named.alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    rows = plan.join(docs.groupBy("source").agg(F.sum("tokens").alias("available")), "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix of more than {MOST_SOURCES} sources")
    quota = water_fill({r["source"]: (r["target_share"] or 0.0, r["available"] or 0, r["max_repeats"] or 0) for r in rows}, total)
    return [(r["source"], float(r["target_share"] or 0.0), int(r["available"] or 0), int(r["max_repeats"] or 0), quota[r["source"]]) for r in rows]


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mix of documents (doc_id, text, source) to targets (source, target_share, max_repeats), by size in tokens.

    uses: (doc_id, source, tokens, uses) of every document; 0 uses for a document without a source, of a
    source that has no target, or without tokens. shares: (source, target_share, max_repeats,
    available_tokens, used_tokens, actual_share) of every target, 0 where a source has no documents.
    Sources are compared without surrounding blanks. A document delivered twice counts once.
    """
    return mixed_sizes(cut(sized(documents)), targets, total, seed)


def mixed_sizes(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The same for documents of known sizes (doc_id, source, tokens), one row each."""
    spark = docs.sparkSession
    named = F.nullif(F.trim("source"), F.lit(""))
    plan = targets.select(named.alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    epochs = []
    for source, _, have, cap, quota in quotas(docs, targets, total):
        e = min(quota / have, cap) if have else 0.0
        whole = int(e + 1e-9)
        epochs.append((source, whole, max(0.0, (e - whole) * have) if whole < cap else 0.0))
    chosen = spark.createDataFrame(epochs, "source string, whole int, rest double")  # as many rows as targets
    slices, n = LEAST_SLICES, docs.count()
    while slices * SLICE < n:
        slices *= 2

    # the fraction: documents in hashed order up to the rest; whole slices first, then the one slice on the edge
    at = docs.where("tokens > 0").join(F.broadcast(chosen), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    at = at.withColumn("slice", F.pmod("h", F.lit(slices)))
    by_slice = at.groupBy("source", "slice").agg(F.sum("tokens").alias("t"))
    before = by_slice.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("slice")) - F.col("t"))
    placed = at.join(before.select("source", "slice", "before"), ["source", "slice"])
    within = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("h", "doc_id"))
    extra = F.when(F.col("before") + within <= F.col("rest"), 1).otherwise(0)
    drawn = placed.withColumn("uses", F.col("whole") + extra).select("doc_id", "uses")
    uses = cut(docs.join(drawn, "doc_id", "left").select("doc_id", "source", "tokens", F.coalesce("uses", F.lit(0)).alias("uses")))
    got = uses.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    shares = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"))
    all_used = F.greatest(F.sum("used_tokens").over(Window.partitionBy()), F.lit(1))  # over as many rows as there are targets
    return uses, shares.withColumn("actual_share", F.col("used_tokens") / all_used)
