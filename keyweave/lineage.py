"""Cutting lineage by writing a table to the folder all executors share.

A written table survives the loss of any executor, and its footer gives the planner true sizes, so the
joins that follow are broadcast only when Spark has measured the side to be small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyweave-"))
    return spark.sparkContext.getCheckpointDir()


_SCOPES: list[list[str]] = []  # of the scopes that are open, the innermost last: the folders named in each


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/keyweave/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that are written within, when the results that need them have been used.

    Without a scope they are left to the retention of the folder, because a DataFrame may be used at any time.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in _SCOPES.pop():
            place = hadoop.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back: later plans start from the written table."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """As `cut`, with aggregates of the rows taken while they are written: no further job is needed for them."""
    seen = Observation()
    written = cut(df.observe(seen, *[c.alias(name) for name, c in figures.items()]), label)
    return written, seen.get


BUCKET_ROWS = 500_000


def cut_bucketed(df: DataFrame, label: str, key: str, rows: int, distinct_rows: bool = False) -> DataFrame:
    """As `cut`, with all rows of a key in one bucket: what meets them by that key later is dealt to the buckets, they are not
    shuffled again. `rows` is about how many there are; `distinct_rows` writes each once. The name in the catalog is only needed to read the buckets as such."""
    spark, name, buckets = df.sparkSession, f"keyweave_{uuid.uuid4().hex}", rows // BUCKET_ROWS + 1
    path = new_folder(spark, label)
    dealt = df.repartition(buckets, key)
    (dealt.distinct() if distinct_rows else dealt).write.option("path", path).bucketBy(buckets, key).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return written
