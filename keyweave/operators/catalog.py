"""Search and summarise a catalogue of columns: (source_schema, table_schema, table_name, column_name, ...)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from keyweave.functions.text import qualified_name
from keyweave.operators.numbering import number_rows

INDEX_KEY = ("source_schema", "table_schema", "table_name", "column_name")
INDEX_COLUMNS = (*INDEX_KEY, "data_type", "character_maximum_length", "is_nullable")


def clean_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Trim all cells; rows with an absent or empty required cell are dropped. Lists of cells stay as they are."""
    is_list = {f.name: isinstance(f.dataType, ArrayType) for f in df.schema}
    trimmed = df.select(*[F.col(f"`{c}`") if is_list[c] else F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return trimmed.where(reduce(lambda a, b: a & b, [F.length(c) > 0 for c in required]))


def merge_catalogs(catalogs: Iterable[DataFrame]) -> DataFrame:
    """Distinct rows of several catalogues."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs).distinct()


def index_order(parts: Sequence[str] = INDEX_KEY) -> list[Column]:
    """Order by the lower-cased parts; parts that differ only in case follow their own order."""
    return [F.lower(p) for p in parts] + [F.col(p) for p in parts]


def find_columns(index: DataFrame, fragment: str, number: bool = True) -> DataFrame:
    """Columns whose name holds the fragment in any case, with their qualified name and position in index order."""
    found = index.select(*INDEX_KEY).where(F.lower("column_name").contains(F.lower(F.lit(fragment)))).distinct()
    named = found.withColumn("qualified_name", qualified_name(*[F.col(c) for c in INDEX_KEY]))
    return number_rows(named, index_order(), distinct_rows=True) if number else named


def refine(index: DataFrame, fragments: Sequence[str], parts: Sequence[str] = INDEX_KEY[1:]) -> DataFrame:
    """Rows whose full path holds every fragment, in any case."""
    path = F.lower(F.concat_ws("-", *parts))
    return reduce(lambda df, text: df.where(path.contains(F.lower(F.lit(text)))), fragments, index)


def find_tables(index: DataFrame, fragment: str) -> DataFrame:
    """Distinct tables whose `source.schema.table` holds the fragment, in any case."""
    parts = INDEX_KEY[:3]
    name = qualified_name(*[F.col(p) for p in parts])
    tables = index.where(F.lower(name).contains(F.lower(F.lit(fragment)))).select(*parts).distinct()
    return tables.withColumn("qualified_name", name)


def related_only(columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Columns of the tables that take part in a relation (child, parent)."""
    tables = relations.select(F.explode(F.array("child", "parent")).alias("_table")).distinct()
    return columns.join(tables, F.col("table_name") == F.col("_table"), "left_semi")


def columns_per_table(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, position, column_name): the columns of each table in scan order.

    One row per column instead of a list per table, so no table is ever held in one row or task.
    """
    parts = ["table_schema", "table_name"]
    rows = columns.select(*parts, "ordinal", "column_name")
    numbered = number_rows(rows, [F.col("ordinal"), F.col("column_name")], within=parts)
    return numbered.select(*parts, "position", "column_name")


def tables_per_column(columns: DataFrame) -> DataFrame:
    """(column_key, table_schema, table_name): distinct tables of each column name, in any case."""
    return columns.select(F.lower("column_name").alias("column_key"), "table_schema", "table_name").distinct()


def system_catalog(schemas: DataFrame, tables: DataFrame, columns: DataFrame, types: DataFrame) -> DataFrame:
    """Catalogue rows from system tables joined on their ids.

    schemas(schema_id, schema_name), tables(object_id, schema_id, table_name),
    columns(object_id, type_id, column_name, ordinal), types(type_id, type_name).
    """
    return (
        columns.join(tables, "object_id")
        .join(schemas, "schema_id")
        .join(types, "type_id")
        .select("schema_name", "table_name", "column_name", "type_name", "ordinal")
    )
