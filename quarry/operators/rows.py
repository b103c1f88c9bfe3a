"""Deduplication, best-of, overlays, intervals and versions: the keyed relational idioms as DataFrame transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut


def first_wins(df: DataFrame, key: Column, *order: Column, keep_keyless: bool = True) -> DataFrame:
    """The first row of every key by an explicit order; rows without a key are all kept, or dropped.

    An aggregate by struct instead of a window: it combines before the shuffle, so a hot key costs one row per task.
    """
    return _best(df, key, order, F.min_by, keep_keyless)


def last_wins(df: DataFrame, key: Column, *order: Column, keep_keyless: bool = True) -> DataFrame:
    """The last row of every key by an explicit order."""
    return _best(df, key, order, F.max_by, keep_keyless)


def _best(df: DataFrame, key: Column, order: tuple[Column, ...], pick, keep_keyless: bool) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(key.alias("_key"), row.alias("_row"), F.struct(*order).alias("_order"))
    best = keyed.where("_key is not null").groupBy("_key").agg(pick("_row", "_order").alias("_row")).select("_row.*")
    return best.union(keyed.where("_key is null").select("_row.*")) if keep_keyless else best


def best_per(df: DataFrame, keys: list[str], order: Column, **fields: Column) -> DataFrame:
    """Per key the fields of the row of greatest order; order must be total over what is asked for."""
    return df.groupBy(*keys).agg(F.max(F.struct(order.alias("_o"), *[c.alias(n) for n, c in fields.items()])).alias("_b")).select(*keys, *[F.col(f"_b.{n}").alias(n) for n in fields])


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows per key. Spark limits each group before the shuffle, so a hot key moves n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def overlay(base: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both sides by key; a field of the overlay counts where it is not null. Keys are unique on each side."""
    b = base.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    o = over.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    return b.join(o, key, "full").select(key, *[F.coalesce(f"_o_{f}", f"_b_{f}").alias(f) for f in fields])


def upsert(current: DataFrame, changes: DataFrame, key: str, *order: Column) -> DataFrame:
    """current with the last change of every key put in its place; changes without a key are skipped.

    Both sides have the same columns. One aggregate over the union: no join, no second pass over current.
    """
    both = current.select("*", F.lit(0).alias("_side")).unionByName(changes.where(F.col(key).isNotNull()).select("*", F.lit(1).alias("_side")))
    return last_wins(both, F.col(key), F.col("_side"), *order, keep_keyless=False).drop("_side")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row in its keys' order, counted from 1; the order must be total within the keys.

    Rows are laid out in ranges of (keys, order), so a key with a tenth of all rows is spread over many
    tasks: each range numbers its own rows, and the counts of earlier ranges are added. The layout is
    written once, for the counts and the rows must see the same one.
    """
    laid = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("_part", *keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    b = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    same = reduce(lambda x, y: x & y, [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]])
    return laid.withColumn("_at", F.row_number().over(here)).join(b, same).select(*df.columns, (F.col("_before") + F.col("_at")).cast("bigint").alias(name))


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int = 5_000) -> DataFrame:
    """The equi-join of both sides on key, for results of many pairs per key: keys of more left rows than given are split.

    Each part of a hot key's left rows meets all its right rows in a task of its own, so no task makes more
    pairs than rows times the right rows of one key. Only hot keys pay: their right rows are copied once
    per part. Hot keys are few, one per so many rows at most.
    """
    hot = left.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), parts).cast("int")).drop("_parts")
    b = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [key, "_part"]).drop("_part")


def rising(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value is greater than all earlier ones of their keys; nulls count as least, the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    v = F.coalesce(F.col(value), F.lit(float("-inf")))
    return df.withColumn("_top", F.max(v).over(w)).where(F.col("_top").isNull() | (v > F.col("_top"))).drop("_top")


def numbered_versions(stored: DataFrame | None, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """new with a version per key that goes on from the greatest stored one, in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = new.withColumn("_n", F.row_number().over(w))
    if stored is None:
        return ranked.withColumn("version", F.col("_n").cast("bigint")).drop("_n")
    last = stored.groupBy(key).agg(F.max("version").alias("_v"))
    return ranked.join(last, key, "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + F.col("_n")).cast("bigint")).drop("_n", "_v")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union by column name; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def new_records(found: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    """Rows whose key is stated and not in the registry."""
    return found.where(F.col(on).isNotNull()).join(registry.select(on).distinct(), on, "left_anti")


def known_records(found: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    return found.join(registry.select(on).distinct(), on, "left_semi")


def next_other(df: DataFrame, keys: list[str], order: list[str], what: str, at: str) -> DataFrame:
    """df with next_other_at: where the next row of another `what` lies in its key's order; null when none follows.

    A run of equal values shares the start of the next run, which one window over the runs' starts gives.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.when(F.lag(what).over(w).isNull() | (F.lag(what).over(w) != F.col(what)), F.col(at))
    marked = df.withColumn("_start", starts)
    following = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return marked.withColumn("next_other_at", F.first("_start", ignorenulls=True).over(following)).drop("_start")


def blocks(df: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """df with block: how many opening rows of its key have come so far; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(w).cast("bigint"))


def sessions(df: DataFrame, keys: list[str], at: str, order: list[str], gap_seconds: int) -> DataFrame:
    """df with session: rows of a key without a longer gap between them share one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return blocks(df.withColumn("_gap", micros - F.lag(micros).over(w)), keys, order, F.col("_gap").isNull() | (F.col("_gap") > gap_seconds * 1_000_000)).withColumnRenamed("block", "session").drop("_gap")


def zero_filled(counts: DataFrame, key: str, count: str, levels: list[str]) -> DataFrame:
    """The counts of exactly the given levels, 0 where one has none."""
    spark = counts.sparkSession
    return spark.createDataFrame([(x,) for x in levels], f"{key} string").join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("bigint").alias(count))


def with_defaults(base: DataFrame, key: str, defaults: dict[str, Column], *sides: DataFrame) -> DataFrame:
    """base left-joined with sides that have one row per key; what is missing takes its default."""
    out = reduce(lambda a, b: a.join(b, key, "left"), sides, base)
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def once_per_distinct(df: DataFrame, keys: list[str], enrich) -> DataFrame:
    """df joined with what enrich makes of its distinct keys, so that equal keys are enriched once."""
    return df.join(enrich(df.select(*keys).distinct()), keys, "left")


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """df with errors: the names of the rules that a row breaks; a rule that is null counts as broken."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))
