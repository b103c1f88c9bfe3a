"""Session helpers: table access, lineage cuts and the test session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there; survives the loss of executors.

    The result carries no size estimate: estimates made before the rows existed can be far too small, and
    the planner would broadcast by them. Without one, a side is broadcast only after its shuffle has
    shown its true size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    jdf = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the cluster runs at once.

    A table of one small file is read by one task, which would then do all the work on its texts; larger
    tables have more splits than that and are left as they lie.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def local_session(cores: int | None = None, name: str = "quarry") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
