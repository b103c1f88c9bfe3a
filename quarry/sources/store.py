"""Tables on a shared folder without a lakehouse format: written aside, then switched; versions are only appended."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import rows as R
from quarry.session import cut


@dataclass(frozen=True)
class Status:
    """What became of a write: synced with its counts, skipped, disabled or error."""

    status: str
    written: int = 0
    skipped: int = 0
    error: str | None = None


#: How many older versions of a table stay for readers that still hold them.
KEPT = 2


class Table:
    """A Parquet table whose versions are numbered folders, each with a marker that is written last.

    A reader takes the greatest number that has a marker, so there is always a whole version to read: a
    marker is created in one step and never replaced, and a failed write leaves no marker. Two writers of
    one number cannot both succeed, since creating a marker that exists fails. Older versions are removed
    after the switch, all but the last few.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str | None = None, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[tuple[int, str]]:
        """(number, folder) of the whole versions, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        marks = [n.removeprefix("_v").split("-", 1) for n in names if n.startswith("_v")]
        return sorted((int(number), f"{self.path}/{folder}") for number, folder in marks)

    def current(self) -> str | None:
        """The folder of the current version; None where nothing was written yet."""
        versions = self._versions()
        return versions[-1][1] if versions else None

    def read(self) -> DataFrame:
        """The current version, or an empty table of the schema."""
        at = self.current()
        if at is None:
            if self.schema is None:
                raise FileNotFoundError(f"{self.path} has no version and no schema was given")
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(at)

    def replace(self, df: DataFrame) -> None:
        """Make df the current version. df may read the table itself: its files are another folder."""
        before = self._versions()
        number, folder = (before[-1][0] if before else 0) + 1, f"d-{uuid.uuid4().hex}"
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        if any(n >= number for n, _ in self._versions()):
            fs.delete(path(f"{self.path}/{folder}"), True)
            raise OSError(f"{self.path} was switched to version {number} by another writer")
        fs.create(path(f"{self.path}/_v{number:012d}-{folder}"), False).close()
        for n, old in before[: -KEPT or None]:
            fs.delete(path(f"{self.path}/_v{n:012d}-{old.rsplit('/', 1)[1]}"), False)
            fs.delete(path(old), True)

    def upsert(self, changes: DataFrame, key: str, *order) -> Status:
        """Put the last change of every key in place; keyless changes are skipped and counted.

        The changes are written once before they are counted and merged, so whatever makes them runs once.
        """
        changes = cut(changes)
        got = changes.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("keyless")).first()
        base = self.read() if self.current() or self.schema is not None else changes.limit(0)
        self.replace(R.upsert(base, changes, key, *order))
        return Status("synced", got["n"] - got["keyless"], got["keyless"])

    def append_versions(self, new: DataFrame, key: str, *order) -> DataFrame:
        """Append rows with versions that go on from the stored ones; returns what was appended."""
        stored = self.read() if self.current() else None
        numbered = cut(R.numbered_versions(stored, new, key, *order))
        self.replace(numbered if stored is None else stored.unionByName(numbered))
        return numbered

    def latest(self, key: str) -> DataFrame:
        """The newest version of every key."""
        return R.last_wins(self.read(), F.col(key), F.col("version"), keep_keyless=False)


def best_effort(enabled: bool, write: Callable[[], Status]) -> Status:
    """A write whose failure is reported instead of raised."""
    if not enabled:
        return Status("disabled")
    try:
        return write()
    except Exception as e:  # the caller decides what a failed write means
        return Status("error", error=f"{type(e).__name__}: {e}"[:500])


def lead_rows(leads: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    """Typed columns with empty arrays for null ones, and the whole record as JSON beside them."""
    filled = leads.withColumns({a: F.coalesce(F.col(a), F.array().cast(leads.schema[a].dataType)) for a in arrays})
    return filled.withColumn("record", F.to_json(F.struct(*[F.col(f"`{c}`") for c in leads.columns])))


def read_json_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file as rows; a missing one is an empty table, a corrupt record is dropped with its line."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, with every type that JSON lacks as text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def primary_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows of the primary source, or of the fallback where it has none, with their source named."""
    return primary.withColumn("source", F.lit("store")) if not primary.isEmpty() else fallback.withColumn("source", F.lit("file"))


def metadata(**parts: DataFrame) -> str:
    """Counts of a run's tables as JSON."""
    return json.dumps({name: df.count() for name, df in parts.items()}, sort_keys=True)
