"""Check declared rules on the data: primary key, unique, not null, foreign key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.text import column


def _any_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [column(n).isNull() for n in names])


def _has_text(df: DataFrame, key: Sequence[str]) -> bool:
    return any(isinstance(df.schema[k].dataType, (T.StringType, T.BinaryType)) for k in key)


def _maybe_repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key columns of the rows whose key may occur again.

    Keys of text are first counted by a hash, and the repeated hashes pick the rows. While they are few
    enough to be broadcast, no unique text is shuffled. The caller counts what is left by the texts themselves.
    """
    keys = df.select(*[column(k) for k in key])
    if not _has_text(df, key):
        return keys
    hashed = keys.withColumn("_hash", F.xxhash64(*[column(k) for k in key]))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    return hashed.join(again, "_hash", "left_semi").drop("_hash")


def _counted(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*[column(k) for k in key]).agg(F.count(F.lit(1)).alias("n"))


def check_primary_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or have a NULL part, with their number of rows.

    Copies of a key are counted before the shuffle, so a key that fills a third of the table costs one row
    per map task.
    """
    if not _has_text(df, key):
        return _counted(df, key).where((F.col("n") > 1) | _any_null(key))
    return check_unique(df, key).unionByName(_counted(df.where(_any_null(key)), key))


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys without NULL that occur more than once."""
    return _counted(_maybe_repeated(df.where(~_any_null(key)), key), key).where("n > 1")


def check_not_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, null_count) for all columns, in one scan."""
    counts = df.agg(*[F.count_if(column(n).isNull()).alias(n) for n in names])
    return counts.unpivot([], [column(n) for n in names], "column_name", "null_count")


def _known_keys(parent: DataFrame, parent_key: Sequence[str]) -> DataFrame:
    """The parent's distinct keys: in an anti join its side can't be split, so repeated keys collapse before it."""
    return parent.select(*[column(p).alias(f"_p{i}") for i, p in enumerate(parent_key)]).distinct()


def check_foreign_key(
    child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]
) -> DataFrame:
    """Child keys that no parent has, with their number of rows. A key with a NULL part passes.

    The child is reduced to its distinct keys first: hot keys collapse in the map tasks, and the anti join
    reuses the partitioning of that aggregate.
    """
    keys = child.where(~_any_null(child_key)).groupBy(*[column(k) for k in child_key]).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = _known_keys(parent, parent_key)
    same = [column(c) == F.col(f"_p{i}") for i, c in enumerate(child_key)]
    return keys.join(known, same, "left_anti")


def orphan_rows(
    child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]
) -> DataFrame:
    """Whole child rows whose key no parent has."""
    known = _known_keys(parent, parent_key)
    same = [column(c) == F.col(f"_p{i}") for i, c in enumerate(child_key)]
    return child.where(~_any_null(child_key)).join(known, same, "left_anti")


def unreferenced_parents(
    parent: DataFrame, child: DataFrame, parent_key: Sequence[str], child_key: Sequence[str]
) -> DataFrame:
    """Parent rows that no child refers to."""
    used = child.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(child_key)]).distinct()
    same = [column(p) == F.col(f"_c{i}") for i, p in enumerate(parent_key)]
    return parent.join(used, same, "left_anti")
