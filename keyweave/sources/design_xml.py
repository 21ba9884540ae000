"""Designs as XML: `sql > table > (row > datatype, default, relation, comment), key > part, comment`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.operators.graph import incoming_links
from keyweave.operators.keys import by_table_id, table_id

TABLE_SCHEMA = """
    _name STRING, _x DOUBLE, _y DOUBLE,
    comment ARRAY<STRING>,
    row ARRAY<STRUCT<
        _name: STRING, _null: STRING, _autoincrement: STRING,
        datatype: ARRAY<STRING>, default: ARRAY<STRING>, comment: ARRAY<STRING>,
        relation: ARRAY<STRUCT<_table: STRING, _row: STRING>>>>,
    key ARRAY<STRUCT<_type: STRING, _name: STRING, part: ARRAY<STRING>>>
"""


@dataclass(frozen=True)
class Design:
    """tables(table_name, x, y, comment),
    columns(table_name, position, column_name, data_type, nullable, autoincrement, default, comment),
    relations(child, child_column, parent, parent_column),
    keys(table_name, key_position, key_name, key_type, part, column_name).

    Over several schemas, tables, columns and keys have a `table_schema`, relations a `child_schema` and a `parent_schema`."""

    tables: DataFrame
    columns: DataFrame
    relations: DataFrame
    keys: DataFrame


def read_design(spark: SparkSession, paths: str | Sequence[str]) -> Design:
    """Read designs with a declared schema; nameless tables and rows are skipped, first child values win."""
    raw = spark.read.format("xml").option("rowTag", "table").schema(TABLE_SCHEMA).load(
        paths if isinstance(paths, str) else list(paths)
    ).where(F.length("_name") > 0)
    tables = raw.select(
        F.col("_name").alias("table_name"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.get("comment", 0).alias("comment")
    )
    rows = raw.select(
        F.col("_name").alias("table_name"), F.posexplode("row").alias("_pos", "_row")
    ).where(F.length("_row._name") > 0)
    columns = rows.select(
        "table_name",
        (F.col("_pos") + 1).cast("bigint").alias("position"),
        F.col("_row._name").alias("column_name"),
        F.get("_row.datatype", 0).alias("data_type"),
        (F.coalesce("_row._null", F.lit("0")) == "1").alias("nullable"),
        (F.coalesce("_row._autoincrement", F.lit("0")) == "1").alias("autoincrement"),
        F.get("_row.default", 0).alias("default"),
        F.get("_row.comment", 0).alias("comment"),
    )
    relations = rows.select(
        F.col("table_name").alias("child"), F.col("_row._name").alias("child_column"), F.explode("_row.relation").alias("_to")
    ).select("child", "child_column", F.col("_to._table").alias("parent"), F.col("_to._row").alias("parent_column"))
    keys = (
        raw.select(F.col("_name").alias("table_name"), F.posexplode("key").alias("_pos", "_key"))
        .select("table_name", "_pos", "_key._name", "_key._type", F.posexplode("_key.part").alias("_part_pos", "column_name"))
        .select(
            "table_name",
            (F.col("_pos") + 1).cast("bigint").alias("key_position"),
            F.col("_name").alias("key_name"),
            F.coalesce("_type", F.lit("INDEX")).alias("key_type"),
            (F.col("_part_pos") + 1).cast("bigint").alias("part"),
            "column_name",
        )
    )
    return Design(tables, columns, relations, keys)


def one_name(design: Design) -> Design:
    """A design over several schemas with `table_id` as table names; others as they are."""

    def named(df: DataFrame) -> DataFrame:
        if "table_schema" not in df.columns:
            return df
        return df.withColumn("table_name", table_id(F.col("table_schema"), F.col("table_name"))).drop("table_schema")

    return Design(named(design.tables), named(design.columns), by_table_id(design.relations), named(design.keys))


def design_elements(design: Design) -> DataFrame:
    """One row for each table, as the format nests it: by degree, columns by position with their relations, keys with their parts.

    All that a table has meets in one shuffle by table, and is sorted only behind it. The tables that refer to a table are counted
    beforehand, so a table that very many refer to is one row there. Of a table given several times, the greatest (x, y, comment)
    counts; relations of columns that do not exist are left out.
    """
    design = one_name(design)
    column = F.struct(
        F.col("position").alias("at"),
        F.col("column_name").alias("_name"),
        F.col("nullable").cast("int").alias("_null"),
        F.col("autoincrement").cast("int").alias("_autoincrement"),
        F.col("data_type").alias("datatype"),
        "default",
        "comment",
    )
    target = F.struct(F.col("child_column").alias("of"), F.col("parent").alias("_table"), F.col("parent_column").alias("_row"))
    part = F.struct("key_position", F.col("key_type").alias("_type"), F.col("key_name").alias("_name"), "part", "column_name")
    kinds = {
        "table": design.tables.select("table_name", F.struct("x", "y", "comment").alias("v")),
        "column": design.columns.select("table_name", column.alias("v")),
        "relation": design.relations.select(F.col("child").alias("table_name"), target.alias("v")),
        "part": design.keys.select("table_name", part.alias("v")),
        "incoming": incoming_links(design.relations.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(
            F.col("node").alias("table_name"), F.col("incoming").alias("v")
        ),
    }
    types = {kind: df.schema["v"].dataType.simpleString() for kind, df in kinds.items()}
    rows = None
    for kind, df in kinds.items():
        lined = df.select("table_name", *[F.col("v").alias(k) if k == kind else F.lit(None).cast(t).alias(k) for k, t in types.items()])
        rows = lined if rows is None else rows.union(lined)
    # Dealt out first, so that no map task sorts what it could hardly combine.
    met = rows.repartition("table_name").groupBy("table_name").agg(
        F.max("table").alias("table"),
        F.array_sort(F.collect_list("column")).alias("columns"),
        F.array_sort(F.collect_list("relation")).alias("relations"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("incoming").alias("incoming"),
    )
    met = met.where(F.col("table").isNotNull() | (F.size("columns") > 0) | (F.size("parts") > 0))
    targets = lambda c: F.transform(F.filter("relations", lambda r: r["of"] == c["_name"]), lambda r: F.struct(r["_table"], r["_row"]))
    plain = ["_name", "_null", "_autoincrement", "datatype", "default"]
    row = lambda c: F.struct(*[c[n].alias(n) for n in plain], targets(c).alias("relation"), c["comment"].alias("comment"))
    same = lambda p, k: reduce(lambda x, y: x & y, [p[n].eqNullSafe(k[n]) for n in ("key_position", "_type", "_name")])
    names = F.array_distinct(F.transform("parts", lambda p: F.struct(p["key_position"], p["_type"], p["_name"])))
    key = lambda k: F.struct(k["_type"].alias("_type"), k["_name"].alias("_name"), F.transform(F.filter("parts", lambda p: same(p, k)), lambda p: p["column_name"]).alias("part"))
    outgoing = F.size(F.array_distinct(F.transform("relations", lambda r: r["_table"])))
    return met.select(
        F.col("table_name").alias("_name"),
        F.col("table.x").alias("_x"),
        F.col("table.y").alias("_y"),
        F.col("table.comment").alias("comment"),
        F.transform("columns", row).alias("row"),
        F.transform(names, key).alias("key"),
        (outgoing + F.coalesce("incoming", F.lit(0))).alias("degree"),
    )


def write_design(design: Design, path: str, compression: str | None = None) -> None:
    """Write a design, tables by degree; over several schemas, tables go by `table_id`.

    The format has one element for each table, so all its columns and keys meet in one row. The text repeats its tags, so
    `compression` ("gzip", ...) makes it many times smaller; it is read back by the ending of the files.
    """
    elements = cut(design_elements(design), "elements").orderBy(F.desc("degree"), "_name").drop("degree")
    options = {"compression": compression} if compression else {}
    elements.write.format("xml").options(rootTag="sql", rowTag="table", **options).save(path)
