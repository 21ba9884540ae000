"""Bring a table into the shape a design declares: casts, lengths, defaults, generated keys."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.text import column
from keyweave.functions.types import UNSIZED_DECIMAL, known_type, spark_type
from keyweave.operators.numbering import number_rows


@dataclass(frozen=True)
class DeclaredColumn:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    autoincrement: bool = False

    @property
    def size(self) -> list[int]:
        """[length] or [precision, scale] of the declared type."""
        found = re.match(r"[^(]*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", self.type)
        return [int(n) for n in found.groups() if n] if found else []


@dataclass(frozen=True)
class Conformed:
    rows: DataFrame
    rejects: DataFrame


def conform(
    df: DataFrame, declared: Sequence[DeclaredColumn], dialect: str = "mysql", lossy: bool = False
) -> Conformed:
    """Cast to the declared types and put the columns in declared order.

    A row with a value that does not cast, that the cast changes or that is longer than declared is a reject; with
    `lossy`, casts may cut and round, and lengths aren't held. Rejects keep the row as it was, with the names of the
    columns that failed. A type the dialect doesn't know is an error. Both sides are projections of the same scan.
    """
    casts = {d.name: column(d.name).try_cast(known_type(dialect, d.type)) for d in declared}
    fails = {d.name: column(d.name).isNotNull() & casts[d.name].isNull() for d in declared}
    if not lossy:
        for d in declared:
            changed = _changed(df, d, casts[d.name], dialect)
            fails[d.name] = fails[d.name] | F.coalesce(changed, F.lit(False)) if changed is not None else fails[d.name]
    failed = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in fails.items()]))
    rows = df.where(F.size(failed) == 0).select(*[cast.alias(n) for n, cast in casts.items()])
    rejects = df.withColumn("failed_columns", failed).where(F.size("failed_columns") > 0)
    return Conformed(rows, rejects)


def _changed(df: DataFrame, declared: DeclaredColumn, cast: Column, dialect: str) -> Column | None:
    """Test for a value that the cast to a whole or decimal number changes, or that is too long; None if neither can be."""
    target = known_type(dialect, declared.type)
    if target in ("SMALLINT", "INT", "BIGINT") or target.startswith("DECIMAL"):
        if isinstance(df.schema[declared.name].dataType, (T.NumericType, T.StringType)):
            return ~cast.try_cast(UNSIZED_DECIMAL).eqNullSafe(column(declared.name).try_cast(UNSIZED_DECIMAL))
        return None
    return too_long(declared, dialect)


def too_long(declared: DeclaredColumn, dialect: str = "mysql") -> Column | None:
    """Test for a value that does not fit the declared size; None when no size is declared."""
    target = spark_type(dialect, declared.type)
    value = column(declared.name)
    if target == "STRING" and declared.size:
        return F.length(value) > declared.size[0]
    if target == "BINARY" and declared.size:
        return F.octet_length(value) > declared.size[0]
    if target.startswith("DECIMAL") and declared.size:
        # A cast rounds extra decimals silently, so its result is compared with the value at a wide scale.
        fits = value.try_cast(target)
        same = fits.try_cast(UNSIZED_DECIMAL).eqNullSafe(value.try_cast(UNSIZED_DECIMAL))
        return value.isNotNull() & (fits.isNull() | ~same)
    return None


def check_length(df: DataFrame, declared: Sequence[DeclaredColumn], dialect: str = "mysql") -> DataFrame:
    """(column_name, declared_type, violations) for each sized column, in one scan."""
    tests = {d: too_long(d, dialect) for d in declared}
    sized = {d: test for d, test in tests.items() if test is not None}
    if not sized:
        return df.sparkSession.createDataFrame([], "column_name string, declared_type string, violations bigint")
    counts = df.agg(*[F.count_if(test).alias(d.name) for d, test in sized.items()])
    long = counts.unpivot([], [column(d.name) for d in sized], "column_name", "violations")
    types = F.create_map(*[F.lit(x) for d in sized for x in (d.name, d.type)])
    return long.select("column_name", types[F.col("column_name")].alias("declared_type"), "violations")


def normalised_default(declared: DeclaredColumn) -> str | None:
    """NOT NULL without a default has the default `''`; the text `null` on a nullable column is NULL."""
    if declared.default is None:
        return None if declared.nullable else ""
    if declared.nullable and declared.default.lower() == "null":
        return None
    return declared.default


def fill_defaults(
    df: DataFrame,
    declared: Sequence[DeclaredColumn],
    dialect: str = "mysql",
    now: datetime.datetime | None = None,
) -> DataFrame:
    """A missing column gets its default; so does NULL in a NOT NULL column. `now` is CURRENT_TIMESTAMP."""
    out = []
    for d in declared:
        target = spark_type(dialect, d.type)
        default = normalised_default(d)
        if default is not None and default.upper() == "CURRENT_TIMESTAMP":
            if now is None:
                raise ValueError("CURRENT_TIMESTAMP needs the time of the run")
            fill = F.lit(now.isoformat(sep=" ")).try_cast(target)
        else:
            fill = F.lit(default).try_cast(target)
        if d.name not in df.columns:
            out.append(fill.alias(d.name))
        elif d.nullable or d.autoincrement:
            out.append(column(d.name))
        else:
            out.append(F.coalesce(column(d.name), fill.cast(df.schema[d.name].dataType)).alias(d.name))
    return df.select(*out)


def assign_ids(
    df: DataFrame,
    id_column: str,
    order_by: Sequence[Column],
    existing: DataFrame | None = None,
    distinct_rows: bool = False,
) -> DataFrame:
    """Dense ids in `order_by` order that continue after the largest id of `existing`, or start at 1."""
    start = 0
    if existing is not None:
        start = existing.agg(F.max(column(id_column))).first()[0] or 0
    numbered = number_rows(df, order_by, name=id_column, distinct_rows=distinct_rows)
    return numbered.withColumn(id_column, (column(id_column) + F.lit(start)).cast(T.LongType()))
