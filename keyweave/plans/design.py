"""Designs assembled from key files or from the catalogue of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators import importing
from keyweave.operators.numbering import number_rows
from keyweave.sources.design_xml import Design


def design_from_keys(primary_keys: DataFrame, foreign_keys: DataFrame) -> Design:
    """The design that key files describe.

    primary_keys(table_name, column_name, key_order), foreign_keys(child, child_column, parent, parent_column).
    All columns named in a key exist, as nullable INTEGER with default NULL; those of a primary key come first, in
    key order, and count up by themselves; the others follow by name.
    """
    absent = F.lit(None).cast("int")
    named = (
        primary_keys.select("table_name", "column_name", "key_order")
        .union(foreign_keys.select("child", "child_column", absent))
        .union(foreign_keys.select("parent", "parent_column", absent))
    )
    distinct = named.groupBy("table_name", "column_name").agg(F.min("key_order").alias("key_order"))
    order = [F.asc_nulls_last("key_order"), F.col("column_name")]
    columns = number_rows(distinct, order, within=["table_name"], distinct_rows=True).select(
        "table_name",
        "position",
        "column_name",
        F.lit("INTEGER").alias("data_type"),
        F.lit(True).alias("nullable"),
        F.col("key_order").isNotNull().alias("autoincrement"),
        F.lit("NULL").alias("default"),
        F.lit(None).cast("string").alias("comment"),
    )
    keys = primary_keys.select(
        "table_name",
        F.lit(1).cast("bigint").alias("key_position"),
        F.lit("").alias("key_name"),
        F.lit("PRIMARY").alias("key_type"),
        F.col("key_order").cast("bigint").alias("part"),
        "column_name",
    )
    tables = named.select("table_name").distinct()
    relations = foreign_keys.select("child", "child_column", "parent", "parent_column")
    return Design(_tables(tables.withColumn("comment", F.lit(None).cast("string"))), columns, relations, keys)


def import_catalog(
    tables: DataFrame, columns: DataFrame, key_usage: DataFrame, constraints: DataFrame, statistics: DataFrame
) -> Design:
    """The design of a MySQL `information_schema`: TABLES, COLUMNS, KEY_COLUMN_USAGE, TABLE_CONSTRAINTS, STATISTICS.

    Extracts over several schemas have a `table_schema` (and key usage a `referenced_table_schema`); if all have, the design
    tells tables apart by it, otherwise they count as extracts of one schema.
    """
    tables, columns, statistics, key_usage = _of_one_kind("referenced_table_schema" in key_usage.columns, tables, columns, statistics, key_usage)
    return Design(
        _tables(tables.select(*_scope(tables), "table_name", F.nullif("table_comment", F.lit("")).alias("comment"))),
        _columns(columns),
        importing.import_relations(key_usage, constraints).drop("constraint_name"),
        _placed(importing.import_keys(statistics)),
    )


def import_catalog_pg(
    classes: DataFrame,
    comments: DataFrame,
    columns: DataFrame,
    constraints: DataFrame,
    key_usage: DataFrame,
    column_usage: DataFrame,
    indexes: DataFrame,
    attributes: DataFrame,
) -> Design:
    """The design of a PostgreSQL catalogue: `pg_class`, its comments, `information_schema`, `pg_index`, `pg_attribute`.

    Over several schemas, all but comments, indexes and attributes have a `table_schema`, and tables are told apart by it; if one
    has none, they count as extracts of one schema.
    """
    classes, columns, constraints, key_usage, column_usage = _of_one_kind(True, classes, columns, constraints, key_usage, column_usage)
    tables = importing.import_tables(classes, comments)
    own = _columns(columns.withColumns({"column_type": F.col("data_type"), "extra": F.lit("")}))
    keys = importing.import_keys_pg(constraints, key_usage).where("column_name IS NOT NULL")
    plain = importing.import_index_columns(indexes, classes, attributes)
    return Design(
        _tables(tables),
        own.join(tables.select(*_scope(tables), "table_name"), [*_scope(tables), "table_name"], "left_semi"),
        importing.import_relations_pg(constraints, key_usage, column_usage).drop("constraint_name"),
        _placed(keys.unionByName(plain)),
    )


def _of_one_kind(several: bool, *extracts: DataFrame) -> list[DataFrame]:
    """The extracts as they are if all know their schema, else all without it."""
    if several and all("table_schema" in df.columns for df in extracts):
        return list(extracts)
    kept_for_constraints = lambda df: "referenced_table_name" in df.columns
    return [df.drop("referenced_table_schema") if kept_for_constraints(df) else df.drop("table_schema") for df in extracts]


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("table_schema",) if c in df.columns]


def _tables(named: DataFrame) -> DataFrame:
    nowhere = F.lit(None).cast("double")
    return named.select(*_scope(named), "table_name", nowhere.alias("x"), nowhere.alias("y"), "comment")


def _columns(columns: DataFrame) -> DataFrame:
    comment = F.nullif("column_comment", F.lit("")) if "column_comment" in columns.columns else F.lit(None).cast("string")
    imported = importing.import_columns(columns, comment.alias("comment"))
    flags = {name: F.col(name) == 1 for name in ("nullable", "autoincrement")}
    return imported.withColumns(flags)


def _placed(keys: DataFrame) -> DataFrame:
    """Keys with their position in the table, by name."""
    table = [*_scope(keys), "table_name"]
    names = keys.select(*table, "key_name").distinct()
    positions = number_rows(names, [F.col("key_name")], within=table, name="key_position", distinct_rows=True)
    return keys.join(positions, [*table, "key_name"])
