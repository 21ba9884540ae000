"""Catalogues over several schemas whose tables have equal names: a schema for each order status, a table for each customer.

Every customer that has orders of two statuses is a table name in two schemas. An order is a column of its customer's table; it is
a key part, and the cheap ones refer to the table of the same name in another schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.operators import keys
from keyweave.plans.design import import_catalog, import_catalog_pg
from keyweave.plans.join_path import join_path
from keyweave.sources.design_xml import Design, one_name
from keyweave.workload.tables import table


def _orders(spark, folder):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("table_schema"),
        text("customer_", "o_custkey").alias("table_name"),
        text("order_", "o_orderkey").alias("column_name"),
        F.col("o_orderkey").alias("ordinal_position"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "O").otherwise("F").alias("other_schema"),
        F.concat(F.lit("fk_"), F.pmod("o_orderkey", F.lit(7)).cast("string")).alias("fk_name"),
        text("k_", "o_orderkey").alias("own_name"),
        F.col("o_custkey").alias("custkey"),
    )


def mysql_design(spark, folder) -> Design:
    orders = _orders(spark, folder)
    tables = orders.select("table_schema", "table_name", F.when(F.col("table_schema") == "F", F.col("table_name")).otherwise("").alias("table_comment")).distinct()
    columns = orders.select(
        "table_schema", "table_name", "column_name", "ordinal_position", F.lit("int(11)").alias("column_type"), F.lit("NO").alias("is_nullable"),
        F.lit(None).cast("string").alias("column_default"), F.lit("").alias("extra"), F.col("priority").alias("column_comment"),
    )
    referring = orders.where("priority < '3'")
    usage = referring.select(
        "table_schema", "table_name", F.col("fk_name").alias("constraint_name"), "column_name", F.col("other_schema").alias("referenced_table_schema"),
        F.col("table_name").alias("referenced_table_name"), F.lit("id").alias("referenced_column_name"),
    )
    # In schema P, the constraints of these names are no foreign keys.
    kind = F.when(F.col("table_schema") == "P", "UNIQUE").otherwise("FOREIGN KEY")
    constraints = referring.select("table_schema", "table_name", F.col("fk_name").alias("constraint_name"), kind.alias("constraint_type")).distinct()
    statistics = orders.where("priority > '3'").select(
        "table_schema", "table_name", F.when(F.col("priority") == "4", "PRIMARY").otherwise("ix").alias("index_name"), F.lit(1).alias("non_unique"),
        F.lit("BTREE").alias("index_type"), F.col("ordinal_position").alias("seq_in_index"), "column_name",
    )
    return import_catalog(tables, columns, usage, constraints, statistics)


def pg_design(spark, folder) -> Design:
    orders = _orders(spark, folder)
    oid = F.concat_ws("/", "table_schema", "table_name")
    own = orders.select(oid.alias("oid"), "table_schema", F.col("table_name").alias("relname"), F.when(F.col("table_schema") == "P", "v").otherwise("r").alias("relkind")).distinct()
    plain = orders.where("priority = '5'")
    index_names = plain.select(F.col("own_name").alias("oid"), "table_schema", F.col("own_name").alias("relname"), F.lit("i").alias("relkind"))
    comments = own.where("table_schema = 'O'").select("oid", F.col("relname").alias("comment"))
    columns = orders.select(
        "table_schema", "table_name", "column_name", "ordinal_position", F.lit("integer").alias("data_type"), F.lit("YES").alias("is_nullable"),
        F.lit(None).cast("string").alias("column_default"),
    )
    kind = F.when(F.col("priority") < "3", "FOREIGN KEY").otherwise("PRIMARY KEY")
    named = orders.where("priority < '5'").withColumns({"constraint_schema": F.col("table_schema"), "constraint_name": F.col("own_name"), "constraint_type": kind})
    constraints = named.select("constraint_schema", "constraint_name", "table_schema", "table_name", "constraint_type")
    usage = named.select("constraint_schema", "constraint_name", F.lit(1).alias("ordinal_position"), "table_schema", "table_name", "column_name")
    parents = named.where("priority < '3'").select(
        "constraint_schema", "constraint_name", F.lit(1).alias("ordinal_position"), F.col("other_schema").alias("table_schema"), "table_name", F.lit("id").alias("column_name")
    )
    indexes = plain.select(F.col("own_name").alias("indexrelid"), oid.alias("indrelid"), F.array("ordinal_position").alias("indkey"), F.lit(False).alias("indisunique"), F.lit(False).alias("indisprimary"))
    attributes = orders.select(oid.alias("attrelid"), F.col("ordinal_position").alias("attnum"), F.col("column_name").alias("attname"))
    return import_catalog_pg(own.unionByName(index_names), comments, columns, constraints, usage, parents, indexes, attributes)


def relations_over_schemas(spark, folder):
    """Relations whose ends exist: their parent column `id` exists in the tables of even customers in schema O."""
    orders = _orders(spark, folder)
    ids = orders.where("table_schema = 'O' AND custkey % 2 = 0").select("table_schema", "table_name", F.lit("id").alias("column_name")).distinct()
    columns = orders.select("table_schema", "table_name", "column_name").union(ids)
    return keys.resolved(mysql_design(spark, folder).relations, columns)


def join_path_over_schemas(spark, folder):
    """From the line items of open orders to filled orders: both schemas have a table `orders`, and share the customers."""
    orders = table(spark, folder, "orders")
    fk = spark.createDataFrame(
        [(1, "open", "items", "l_orderkey", "open", "orders", "o_orderkey"), (2, "open", "orders", "o_custkey", "all", "customer", "c_custkey"), (3, "filled", "orders", "o_custkey", "all", "customer", "c_custkey")],
        "edge_ord bigint, child_schema string, child string, child_column string, parent_schema string, parent string, parent_column string",
    )
    tables = {
        "open.items": table(spark, folder, "lineitem").where("l_quantity > 45"),
        "open.orders": orders.where("o_orderstatus = 'O'"),
        "filled.orders": orders.where("o_orderstatus = 'F'"),
        "all.customer": table(spark, folder, "customer"),
    }
    joined = join_path(tables, fk, "open.items", "filled.orders")
    return joined.groupBy(F.col("t2__c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.max("t3__o_orderkey").alias("last_order"))


QUERIES = {
    **{f"import_catalog_{part}": lambda s, d, p=part: getattr(mysql_design(s, d), p) for part in ("columns", "relations", "keys")},
    "import_catalog_tables": lambda s, d: mysql_design(s, d).tables.drop("x", "y"),
    **{f"import_catalog_pg_{part}": lambda s, d, p=part: getattr(pg_design(s, d), p) for part in ("columns", "relations", "keys")},
    "import_catalog_pg_tables": lambda s, d: pg_design(s, d).tables.drop("x", "y"),
    "import_catalog_named": lambda s, d: one_name(mysql_design(s, d)).relations,
    "relations_over_schemas": relations_over_schemas,
    "join_path_over_schemas": join_path_over_schemas,
}

ORDERS = """
    SELECT o_orderstatus AS table_schema, concat('customer_', o_custkey) AS table_name, concat('order_', o_orderkey) AS column_name, o_orderkey AS k,
           left(o_orderpriority, 1) AS priority, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END AS other_schema, o_custkey
    FROM orders"""
RELATIONS = f"""
    SELECT table_schema AS child_schema, table_name AS child, column_name AS child_column, other_schema AS parent_schema, table_name AS parent, 'id' AS parent_column
    FROM ({ORDERS}) WHERE priority < '3'"""
NO_TEXT = "CAST(NULL AS VARCHAR)"

SQL = {
    "import_catalog_tables": f"SELECT DISTINCT table_schema, table_name, CASE WHEN table_schema = 'F' THEN table_name END AS comment FROM ({ORDERS})",
    "import_catalog_columns": f"""
        SELECT table_schema, table_name, k AS position, column_name, 'INT(11)' AS data_type, false AS nullable, false AS autoincrement,
               {NO_TEXT} AS "default", priority AS comment FROM ({ORDERS})""",
    "import_catalog_relations": f"SELECT * FROM ({RELATIONS}) WHERE child_schema <> 'P'",
    "import_catalog_keys": f"""
        SELECT table_schema, table_name, key_name, CASE WHEN key_name = 'PRIMARY' THEN 'PRIMARY' ELSE 'INDEX' END AS key_type,
               row_number() OVER (PARTITION BY table_schema, table_name, key_name ORDER BY k) AS part, column_name,
               dense_rank() OVER (PARTITION BY table_schema, table_name ORDER BY key_name) AS key_position
        FROM (SELECT *, CASE WHEN priority = '4' THEN 'PRIMARY' ELSE 'ix' END AS key_name FROM ({ORDERS}) WHERE priority > '3')""",
    "import_catalog_pg_tables": f"SELECT DISTINCT table_schema, table_name, CASE WHEN table_schema = 'O' THEN table_name END AS comment FROM ({ORDERS}) WHERE table_schema <> 'P'",
    "import_catalog_pg_columns": f"""
        SELECT table_schema, table_name, k AS position, column_name, 'INTEGER' AS data_type, true AS nullable, false AS autoincrement,
               {NO_TEXT} AS "default", {NO_TEXT} AS comment FROM ({ORDERS}) WHERE table_schema <> 'P'""",
    "import_catalog_pg_relations": RELATIONS,
    "import_catalog_pg_keys": f"""
        SELECT table_schema, table_name, key_name, key_type, 1::BIGINT AS part, column_name,
               row_number() OVER (PARTITION BY table_schema, table_name ORDER BY key_name) AS key_position
        FROM (SELECT *, concat('k_', k) AS key_name, CASE WHEN priority = '5' THEN 'INDEX' ELSE 'PRIMARY' END AS key_type FROM ({ORDERS}) WHERE priority >= '3')""",
    "import_catalog_named": f"""
        SELECT concat(child_schema, '.', child) AS child, child_column, concat(parent_schema, '.', parent) AS parent, parent_column
        FROM ({RELATIONS}) WHERE child_schema <> 'P'""",
    "relations_over_schemas": f"""
        SELECT * FROM ({RELATIONS}) WHERE child_schema <> 'P' AND parent_schema = 'O' AND parent IN (
            SELECT table_name FROM ({ORDERS}) WHERE table_schema = 'O' AND o_custkey % 2 = 0)""",
    "join_path_over_schemas": """
        SELECT c_mktsegment AS segment, count(*) AS n, max(f.o_orderkey) AS last_order
        FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey AND o.o_orderstatus = 'O' AND l_quantity > 45
        JOIN customer ON o.o_custkey = c_custkey JOIN orders f ON f.o_custkey = c_custkey AND f.o_orderstatus = 'F' GROUP BY 1""",
}
