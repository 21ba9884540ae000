"""Assemble tables, columns, relations and keys from the catalogue tables of a database.

Inputs are extracts of `information_schema`, `pg_catalog` or CUBRID catalogue tables as DataFrames with
lower-case column names, read by `spark.read.jdbc` or from files. An extract over several schemas has a `table_schema`
column; where it is there, a table is the pair of its schema and its name: tables, columns and keys are told apart by both and
carry the schema in front, relations carry `child_schema` and `parent_schema`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.numbering import number_rows


def _schema_of(df: DataFrame) -> list[str]:
    return [c for c in ("table_schema",) if c in df.columns]


def import_tables(classes: DataFrame, comments: DataFrame) -> DataFrame:
    """(table_name, comment) of ordinary, non-system tables.

    classes(oid, relname, relkind[, table_schema]), comments(oid, comment).
    """
    own = classes.where((F.col("relkind") == "r") & ~F.col("relname").rlike("^(pg_|sql_)"))
    return own.join(comments, "oid", "left").select(*_schema_of(classes), F.col("relname").alias("table_name"), "comment")


def import_class_names(classes: DataFrame) -> DataFrame:
    """CUBRID: names of non-system classes. classes(class_name, class_type, is_system_class)."""
    return classes.where("class_type = 'CLASS' AND is_system_class = 'NO'").select(F.col("class_name").alias("table_name"))


def default_text(column_type: Column, default: Column) -> Column:
    """The default as text: hex for binary types, '' for the text NULL."""
    hexed = F.when(column_type.rlike("(?i)binary"), F.lower(F.hex(default))).otherwise(default)
    return F.when(hexed == "NULL", F.lit("")).otherwise(hexed)


def import_columns(columns: DataFrame, *more: Column) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable, autoincrement, default) from COLUMNS, and `more`."""
    flag = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    declared = F.regexp_replace("column_type", r",0\)", ")")
    return columns.select(
        *_schema_of(columns),
        "table_name",
        F.col("ordinal_position").cast("bigint").alias("position"),
        "column_name",
        F.upper(declared).alias("data_type"),
        flag(F.col("is_nullable") == "YES").alias("nullable"),
        flag(F.coalesce("extra", F.lit("")).rlike("(?i)auto_increment")).alias("autoincrement"),
        default_text(F.col("column_type"), F.col("column_default")).alias("default"),
        *more,
    )


def import_relations(key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Foreign keys of KEY_COLUMN_USAGE; the constraint is found by schema, table and name.

    Usage with a `referenced_table_schema` keeps the schemas of both ends.
    """
    child_schema = parent_schema = []
    if "referenced_table_schema" in key_usage.columns:
        child_schema, parent_schema = [F.col("table_schema").alias("child_schema")], [F.col("referenced_table_schema").alias("parent_schema")]
    fk = constraints.where("constraint_type = 'FOREIGN KEY'").select("table_schema", "table_name", "constraint_name")
    return key_usage.join(fk, ["table_schema", "table_name", "constraint_name"], "left_semi").select(
        "constraint_name",
        *child_schema,
        F.col("table_name").alias("child"),
        F.col("column_name").alias("child_column"),
        *parent_schema,
        F.col("referenced_table_name").alias("parent"),
        F.col("referenced_column_name").alias("parent_column"),
    )


def import_relations_pg(constraints: DataFrame, key_usage: DataFrame, column_usage: DataFrame) -> DataFrame:
    """Foreign keys from key_column_usage (child) and constraint_column_usage (parent).

    The parts of a multi-column key are paired by ordinal, not crossed. The constraint is found by its schema and name, and by
    its table where both extracts have one schema for it; usages with a `table_schema` keep the schemas of both ends.
    """
    name = ["constraint_schema", "constraint_name"]
    by_table = ["table_schema", "table_name"] if all("table_schema" in df.columns for df in (constraints, key_usage)) else []
    fk = constraints.where("constraint_type = 'FOREIGN KEY'").select(*name, *by_table)

    def end(usage: DataFrame, side: str) -> DataFrame:
        schema = [F.col(c).alias(f"{side}_schema") for c in _schema_of(usage)]
        return usage.select(
            *name, F.col("ordinal_position").alias("_part"), *schema, F.col("table_name").alias(side), F.col("column_name").alias(f"{side}_column")
        )

    child = end(key_usage.join(fk, [*name, *by_table], "left_semi"), "child")
    parent = end(column_usage, "parent")
    schemas = [c for c in ("child_schema", "parent_schema") if c in [*child.columns, *parent.columns]]
    kept = ["constraint_name", *schemas[:1], "child", "child_column", *schemas[1:], "parent", "parent_column"]
    return child.join(parent, [*name, "_part"]).select(*kept)


def key_type(name: Column, non_unique: Column, index_type: Column) -> Column:
    return (
        F.when(name == "PRIMARY", "PRIMARY")
        .when(non_unique == 0, "UNIQUE")
        .when(index_type == "FULLTEXT", "FULLTEXT")
        .otherwise("INDEX")
    )


def import_keys(statistics: DataFrame) -> DataFrame:
    """(table_name, key_name, key_type, part, column_name) from STATISTICS: one row per key part, numbered from 1."""
    scope = _schema_of(statistics)
    parts = statistics.select(
        *scope,
        "table_name",
        F.col("index_name").alias("key_name"),
        key_type(F.col("index_name"), F.col("non_unique"), F.col("index_type")).alias("key_type"),
        F.col("seq_in_index").alias("_seq"),
        "column_name",
    )
    numbered = number_rows(parts, [F.col("_seq"), F.col("column_name")], within=[*scope, "table_name", "key_name"], name="part")
    return numbered.drop("_seq")


def import_keys_pg(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """(table_name, key_name, key_type, part, column_name); CHECK and FOREIGN KEY are no keys."""
    scope = _schema_of(constraints)
    kept = constraints.where("constraint_type NOT IN ('FOREIGN KEY', 'CHECK')").select(
        "constraint_schema",
        "constraint_name",
        *scope,
        "table_name",
        F.when(F.col("constraint_type") == "PRIMARY KEY", "PRIMARY").otherwise(F.col("constraint_type")).alias("key_type"),
    )
    by_table = [*scope, "table_name"] if scope and _schema_of(key_usage) else []
    on = ["constraint_schema", "constraint_name", *by_table]
    used = key_usage.select(*on, "ordinal_position", "column_name")
    return kept.join(used, on, "left").select(
        *scope,
        "table_name",
        F.col("constraint_name").alias("key_name"),
        "key_type",
        F.col("ordinal_position").cast("bigint").alias("part"),
        "column_name",
    )


def drop_not_null_checks(constraints: DataFrame) -> DataFrame:
    """Constraints without the CHECKs that only repeat NOT NULL."""
    return constraints.where(~F.col("constraint_name").endswith("_not_null"))


def import_index_columns(indexes: DataFrame, classes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_name, key_name, key_type, part, column_name) of plain indexes.

    indexes(indexrelid, indrelid, indkey array, indisunique, indisprimary), classes(oid, relname[, table_schema]),
    attributes(attrelid, attnum, attname). Unique and primary indexes are constraints already.
    """
    plain = indexes.where("NOT indisunique AND NOT indisprimary")
    parts = plain.select("indexrelid", "indrelid", F.posexplode("indkey").alias("_pos", "attnum"))
    name = classes.select(F.col("oid").alias("indexrelid"), F.col("relname").alias("key_name"))
    scope = _schema_of(classes)
    table = classes.select(F.col("oid").alias("indrelid"), *scope, F.col("relname").alias("table_name"))
    attribute = attributes.select(F.col("attrelid").alias("indrelid"), "attnum", F.col("attname").alias("column_name"))
    return (
        parts.join(attribute, ["indrelid", "attnum"])
        .join(name, "indexrelid")
        .join(table, "indrelid")
        .select(
            *scope,
            "table_name",
            "key_name",
            F.lit("INDEX").alias("key_type"),
            (F.col("_pos") + 1).cast("bigint").alias("part"),
            "column_name",
        )
    )


def import_keys_cubrid(indexes: DataFrame, index_keys: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_name, key_name, key_type, part, column_name) of CUBRID indexes that are no foreign keys.

    indexes(class_name, index_name, is_unique, is_primary_key, is_foreign_key),
    index_keys(class_name, index_name, key_order, key_attr_name), attributes(class_name, attr_name).
    """
    kind = F.when(F.col("is_primary_key") == "YES", "PRIMARY").when(F.col("is_unique") == "YES", "UNIQUE").otherwise("INDEX")
    kept = indexes.where("is_foreign_key = 'NO'").select("class_name", "index_name", kind.alias("key_type"))
    own = attributes.select("class_name", F.col("attr_name").alias("key_attr_name"))
    return (
        index_keys.join(kept, ["class_name", "index_name"])
        .join(own, ["class_name", "key_attr_name"], "left_semi")
        .select(
            F.col("class_name").alias("table_name"),
            F.col("index_name").alias("key_name"),
            "key_type",
            F.col("key_order").cast("bigint").alias("part"),
            F.col("key_attr_name").alias("column_name"),
        )
        .distinct()
    )
