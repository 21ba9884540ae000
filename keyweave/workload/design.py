"""A design derived from the given tables, written as XML and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.lineage import cut, new_folder
from keyweave.plans.design import design_from_keys
from keyweave.sources.design_xml import Design, read_design, write_design
from keyweave.workload.tables import table


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def order_design(spark, folder) -> Design:
    """Each order is a table, each of its line numbers a column that refers to a part; the first line is the key."""
    orders = table(spark, folder, "orders")
    grouped = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.max("l_quantity").cast("int").alias("size")
    )
    lines = cut(grouped, "lines")
    tables = orders.select(
        _name("order_", "o_orderkey").alias("table_name"), F.col("o_custkey").cast("double").alias("x"), F.col("o_orderkey").cast("double").alias("y"),
        F.concat(F.lit("<"), "o_orderpriority", F.lit("> & co")).alias("comment"),
    )
    columns = lines.select(
        _name("order_", "l_orderkey").alias("table_name"), F.col("l_linenumber").cast("bigint").alias("position"), _name("line_", "l_linenumber").alias("column_name"),
        F.concat(F.lit("VARCHAR("), F.col("size"), F.lit(")")).alias("data_type"), (F.col("flag") == "N").alias("nullable"),
        (F.col("l_linenumber") == 1).alias("autoincrement"), F.when(F.col("flag") == "A", "'a'").alias("default"), F.lit(None).cast("string").alias("comment"),
    )
    relations = lines.select(
        _name("order_", "l_orderkey").alias("child"), _name("line_", "l_linenumber").alias("child_column"), _name("part_", "part").alias("parent"), F.lit("id").alias("parent_column")
    )
    keys = columns.select(
        "table_name", F.lit(1).cast("bigint").alias("key_position"), F.lit("pk").alias("key_name"), F.lit("PRIMARY").alias("key_type"),
        F.col("position").alias("part"), "column_name",
    )
    return Design(tables, columns, relations, keys)


_WRITTEN: dict[tuple[str, str], str] = {}


def _round_trip(spark, folder) -> Design:
    """The design, written once for all queries of an application over one folder, and read."""
    place = (spark.sparkContext.applicationId, folder)
    if place not in _WRITTEN:
        path = new_folder(spark, "design")
        write_design(order_design(spark, folder), path, compression="gzip")
        _WRITTEN[place] = path
    return read_design(spark, _WRITTEN[place])


def design_from_key_files(spark, folder) -> Design:
    """Each line number of an order is a key part of its table, each supplier a table it refers to."""
    lines = table(spark, folder, "lineitem")
    primary = lines.select(
        _name("order_", "l_orderkey").alias("table_name"), _name("line_", "l_linenumber").alias("column_name"),
        F.col("l_linenumber").alias("key_order"),
    ).distinct()
    foreign = lines.select(
        _name("order_", "l_orderkey").alias("child"), F.lit("supplier").alias("child_column"),
        _name("supplier_", "l_suppkey").alias("parent"), F.lit("id").alias("parent_column"),
    )
    return design_from_keys(primary, foreign)


QUERIES = {
    "design_from_keys": lambda s, d: design_from_key_files(s, d).columns.select("table_name", "position", "column_name", "autoincrement"),
    "design_relations": lambda s, d: _round_trip(s, d).relations,
    "design_columns": lambda s, d: _round_trip(s, d).columns.select("table_name", "column_name", "data_type", "nullable", "autoincrement", "default"),
    "design_tables": lambda s, d: _round_trip(s, d).tables.where("comment IS NOT NULL"),
    "design_keys": lambda s, d: _round_trip(s, d).keys,
}

LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS flag, max(l_quantity)::INT AS size FROM lineitem GROUP BY 1, 2"

SQL = {
    "design_from_keys": """
        WITH named AS (
            SELECT DISTINCT concat('order_', l_orderkey) AS table_name, concat('line_', l_linenumber) AS column_name, l_linenumber AS key_order FROM lineitem
            UNION SELECT concat('order_', l_orderkey), 'supplier', NULL FROM lineitem
            UNION SELECT concat('supplier_', l_suppkey), 'id', NULL FROM lineitem)
        SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY key_order NULLS LAST, column_name) AS position,
               column_name, key_order IS NOT NULL AS autoincrement FROM named""",
    "design_relations": f"""
        SELECT concat('order_', l_orderkey) AS child, concat('line_', l_linenumber) AS child_column,
               concat('part_', part) AS parent, 'id' AS parent_column FROM ({LINES})""",
    "design_columns": f"""
        SELECT concat('order_', l_orderkey) AS table_name, concat('line_', l_linenumber) AS column_name, concat('VARCHAR(', size, ')') AS data_type,
               flag = 'N' AS nullable, l_linenumber = 1 AS autoincrement, CASE WHEN flag = 'A' THEN '''a''' END AS "default" FROM ({LINES})""",
    "design_tables": """
        SELECT concat('order_', o_orderkey) AS table_name, o_custkey::DOUBLE AS x, o_orderkey::DOUBLE AS y,
               concat('<', o_orderpriority, '> & co') AS comment FROM orders""",
    "design_keys": f"""
        SELECT concat('order_', l_orderkey) AS table_name, 1::BIGINT AS key_position, 'pk' AS key_name, 'PRIMARY' AS key_type,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS part, concat('line_', l_linenumber) AS column_name FROM ({LINES})""",
}
