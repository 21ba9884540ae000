"""A table of documents by key: (key, payload, dt), one row per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.text import column
from keyweave.lineage import cut


def list_keys(store: DataFrame) -> DataFrame:
    """Keys with their time as text, newest first."""
    ordered = store.orderBy(F.desc("dt"), "key")
    return ordered.select("key", F.date_format("dt", "dd-MMMM-yyyy HH:mm").alias("saved_at"))


def load(store: DataFrame, key: str) -> DataFrame:
    """The document of a key; the comparison reaches the Parquet scan."""
    return store.where(F.col("key") == F.lit(key))


def latest(versions: DataFrame, *tie_break: str) -> DataFrame:
    """The newest version of each key by (dt, tie_break); versions collapse in the map tasks first."""
    newest = F.max_by(F.struct("payload", "dt"), F.struct("dt", *tie_break))
    return versions.groupBy("key").agg(newest.alias("_newest")).select("key", "_newest.payload", "_newest.dt")


def upsert(store: DataFrame, updates: DataFrame, *tie_break: str) -> DataFrame:
    """The store after the updates: new keys added, a present key replaced unless its own dt is later.

    NULL is the oldest dt.

    The store has one row per key already, so it is joined with the newest update of each key and never
    grouped: few updates are broadcast, and the store is then not shuffled at all.
    """
    new = latest(updates, *tie_break).select(
        "key", F.struct("payload", "dt").alias("_new")
    )
    old = store.select("key", F.struct("payload", "dt").alias("_old"))
    later = F.coalesce(F.col("_old.dt") > F.col("_new.dt"), F.col("_old.dt").isNotNull() & F.col("_new.dt").isNull())
    kept = old.join(new, "key", "left").select(
        "key",
        F.when(F.col("_new").isNotNull() & ~later, F.col("_new")).otherwise(F.col("_old")).alias("_row"),
    )
    added = new.join(store.select("key"), "key", "left_anti").select("key", F.col("_new").alias("_row"))
    return kept.unionByName(added).select("key", "_row.payload", "_row.dt")


@dataclass(frozen=True)
class PartitionedStore:
    """A store as files, dealt to `parts` folders by a hash of the key.

    An upsert reads and writes only the folders that its updates fall into; the files of all others stay as they are. The new
    rows of those are written in full to the shared folder first, so a lost executor costs a task.
    """

    path: str
    parts: int = 64

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.select("key", "payload", "dt", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(self.parts)).cast("int").alias("part"))

    def create(self, store: DataFrame) -> None:
        self._write(self._dealt(store), "errorifexists")

    def _write(self, dealt: DataFrame, mode: str) -> None:
        # One task for each folder, so that it holds one file.
        writer = dealt.repartition(self.parts, "part").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).select("key", "payload", "dt")

    def load(self, spark: SparkSession, key: str) -> DataFrame:
        """The document of a key, from its folder alone."""
        part = F.pmod(F.xxhash64(F.lit(key)), F.lit(self.parts)).cast("int")
        return spark.read.parquet(self.path).where((F.col("part") == part) & (F.col("key") == F.lit(key))).select("key", "payload", "dt")

    def upsert(self, updates: DataFrame, *tie_break: str) -> list[int]:
        """Bring `updates` (key, payload, dt, tie breaks) in, as `upsert` does; the parts that were written."""
        spark = updates.sparkSession
        new = cut(latest(updates, *tie_break), "updates")
        touched = sorted(r["part"] for r in self._dealt(new).select("part").distinct().collect())  # `parts` numbers at most
        if not touched:
            return []
        old = spark.read.parquet(self.path).where(F.col("part").isin(touched)).select(*[column(c) for c in ("key", "payload", "dt")])
        self._write(self._dealt(cut(upsert(old, new), "store-parts")), "overwrite")
        return touched
