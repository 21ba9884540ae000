"""Relations of a design against its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.types import foreign_key_type

RELATION = ("child", "child_column", "parent", "parent_column")


def _scoped(relations: DataFrame, columns: DataFrame) -> bool:
    """Whether a table is its schema and its name on both sides."""
    return {"child_schema", "parent_schema"} <= set(relations.columns) and "table_schema" in columns.columns


def relation_ends(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relations with `child_type` and `parent_type`; NULL where the column does not exist.

    columns is (table_name, column_name, data_type), one row per column. If it has a `table_schema` and the relations have a
    `child_schema` and a `parent_schema`, tables of equal names in several schemas are several tables.
    """
    scoped = _scoped(relations, columns)

    def with_type(df: DataFrame, side: str) -> DataFrame:
        on = [*[f"{side}_schema"][: int(scoped)], side, f"{side}_column"]
        own = columns.select(*["table_schema"][: int(scoped)], "table_name", "column_name", "data_type").toDF(*on, f"{side}_type")
        return df.join(own, on, "left")

    return with_type(with_type(relations, "child"), "parent")


def resolved(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relations whose both columns exist."""
    return _with_end(_with_end(relations, columns, "child", "left_semi"), columns, "parent", "left_semi")


def dangling(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relations with an end that does not exist."""
    no_child = _with_end(relations, columns, "child", "left_anti")
    no_parent = _with_end(_with_end(relations, columns, "child", "left_semi"), columns, "parent", "left_anti")
    return no_child.unionByName(no_parent)


def foreign_key_mismatches(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relations whose child column has another declared type than its parent column calls for."""
    ends = relation_ends(relations, columns)
    expected = foreign_key_type(F.col("parent_type"))
    return ends.withColumn("expected_type", expected).where(F.upper("child_type") != F.col("expected_type"))


def _with_end(relations: DataFrame, columns: DataFrame, side: str, how: str) -> DataFrame:
    scope = [F.col("table_schema").alias("_schema")] if _scoped(relations, columns) else []
    ends = columns.select(*scope, F.col("table_name").alias("_table"), F.col("column_name").alias("_column"))
    on = (F.col(side) == F.col("_table")) & (F.col(f"{side}_column") == F.col("_column"))
    return relations.join(ends, on & (F.col(f"{side}_schema") == F.col("_schema")) if scope else on, how)


def table_id(schema: Column, table: Column) -> Column:
    """One text for a schema and a table of it: `schema.table`, a part with a dot or a backtick in it in backticks."""
    part = lambda c: F.when(c.rlike("[.`]"), F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(c)
    return F.concat(part(schema), F.lit("."), part(table))


def by_table_id(relations: DataFrame) -> DataFrame:
    """Relations whose tables are named by `table_id`, where they have schemas; others as they are."""
    if not {"child_schema", "parent_schema"} <= set(relations.columns):
        return relations
    named = {side: table_id(F.col(f"{side}_schema"), F.col(side)) for side in ("child", "parent")}
    return relations.withColumns(named).drop("child_schema", "parent_schema")
