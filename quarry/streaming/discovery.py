"""Micro-batch discovery: new documents are registered once, packets are ingested, outcomes recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import rows as R
from quarry.sources.store import Table

REGISTRY = "url string, title string, kind string, status string, error string"
PACKETS = ("agenda", "packet")


def register(registry: Table, found: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The rows of found that are new, registered as "discovered".

    A registered document is never registered again. One that failed stays so and is not retried,
    unless retry_failed asks for it.
    """
    known = registry.read()
    settled = known.where("status <> 'failed'") if retry_failed else known
    one = R.first_wins(found.select("url", "title", "kind"), F.col("url"), F.col("title"), keep_keyless=False)
    new = R.new_records(one, settled, "url").select("url", "title", "kind", F.lit("discovered").alias("status"), F.lit(None).cast("string").alias("error"))
    registry.upsert(new, "url", F.lit(1))
    return registry.read().where("status = 'discovered'")


def ingest(registry: Table, waiting: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run process over the waiting packets; it returns (url, error), and each outcome is recorded."""
    outcome = process(waiting.where(F.col("kind").isin(*PACKETS))).select("url", "error")
    done = waiting.drop("error", "status").join(outcome, "url").select("url", "title", "kind", F.when(F.col("error").isNull(), "ingested").otherwise("failed").alias("status"), "error")
    registry.upsert(done, "url", F.lit(2))
    return registry.read()


def discover(spark: SparkSession, pages: str, schema: str, registry: Table, process: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A query over listing files (url, title, kind) that registers and ingests what is new.

    It stops when all is read, or looks again at the given interval, such as "6 hours".
    """

    def batch(df: DataFrame, _: int) -> None:
        ingest(registry, register(registry, df), process)

    stream = spark.readStream.schema(schema).json(pages)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
