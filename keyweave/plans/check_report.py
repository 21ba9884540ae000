"""All declared rules of a design, one row per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import column
from keyweave.operators.checks import check_foreign_key, check_primary_key, check_unique
from keyweave.operators.conform import DeclaredColumn, too_long


@dataclass(frozen=True)
class ForeignKey:
    columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]


@dataclass(frozen=True)
class TableRules:
    primary_key: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    foreign_keys: Sequence[ForeignKey] = ()
    sized: Sequence[DeclaredColumn] = field(default_factory=tuple)


def check_all(tables: Mapping[str, DataFrame], design: Mapping[str, TableRules]) -> DataFrame:
    """(table_name, rule, columns, violations).

    Violations are keys for primary key and unique, rows for the other rules. The NOT NULL and length rules of
    a table share one scan; a key rule is one shuffle of that key's columns.
    """
    reports = []
    for name, rules in design.items():
        df = tables[name]
        if rules.primary_key:
            bad = check_primary_key(df, rules.primary_key).agg(F.count(F.lit(1)).alias("violations"))
            reports.append(_report(bad, name, "primary key", rules.primary_key))
        for key in rules.unique:
            bad = check_unique(df, key).agg(F.count(F.lit(1)).alias("violations"))
            reports.append(_report(bad, name, "unique", key))
        for fk in rules.foreign_keys:
            orphans = check_foreign_key(df, tables[fk.parent], fk.columns, fk.parent_columns)
            bad = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))
            reports.append(_report(bad, name, "foreign key", fk.columns))
        if rules.not_null or rules.sized:
            reports.append(_row_rules(df, name, rules))
    return reduce(DataFrame.unionByName, reports)


def _report(counted: DataFrame, table: str, rule: str, columns: Sequence[str]) -> DataFrame:
    return counted.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(",".join(columns)).alias("columns"),
        "violations",
    )


def _row_rules(df: DataFrame, table: str, rules: TableRules) -> DataFrame:
    tests = {("not null", n): column(n).isNull() for n in rules.not_null}
    for d in rules.sized:
        test = too_long(d)
        if test is not None:
            tests[("length", d.name)] = test
    counts = df.agg(*[F.count_if(test).alias(f"{rule}:{n}") for (rule, n), test in tests.items()])
    long = counts.unpivot([], [column(f"{rule}:{n}") for rule, n in tests], "_rule", "violations")
    return long.select(
        F.lit(table).alias("table_name"),
        F.substring_index("_rule", ":", 1).alias("rule"),
        F.expr("substring(_rule, instr(_rule, ':') + 1)").alias("columns"),
        "violations",
    )
