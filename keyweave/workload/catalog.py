"""Catalogue operators over catalogues that Spark derives from the given tables: one catalogue row per data row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import comma_list, delimiter_of, quote_literal, safe_name, snap, split_path, url_part, url_text
from keyweave.lineage import new_folder
from keyweave.operators import catalog, importing, keys
from keyweave.sources.catalog_files import (
    build_index, detect_delimiters, find_datasets, read_columns, read_foreign_keys, read_index, read_primary_keys, read_records, write_index,
)
from keyweave.workload.tables import table


def _named(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") for c in columns])


# ---- columns and index: every order is a column of its customer's table ----


def order_index(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("source_schema"),
        F.col("o_orderstatus").alias("table_schema"),
        _named("customer_", "o_custkey").alias("table_name"),
        _named("Order_", "o_orderkey").alias("column_name"),
    )


ORDER_INDEX_SQL = """
    SELECT o_orderpriority AS source_schema, o_orderstatus AS table_schema,
           concat('customer_', o_custkey) AS table_name, concat('Order_', o_orderkey) AS column_name
    FROM orders"""

# The further cell of a turn, as it is read: outer white space trimmed.
SAID = """trim(concat(text, ' said "', role, '",', chr(9)), concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11)))"""


def order_files(spark, folder, label):
    """Column lists in one folder per source, some with commas and quotes, some with tabs; cheap orders lack a name."""
    commas = F.concat(
        F.col("o_orderstatus"), F.lit(', "customer_'), F.col("o_custkey"), F.lit('", '), F.col("_column"), F.lit(",int,,YES")
    )
    tabs = F.concat_ws("\t", F.col("o_orderstatus"), _named("customer_", "o_custkey"), F.col("_column"), F.lit("int"), F.lit(""), F.lit("YES"))
    named = F.when(F.col("o_totalprice") < 50_000, F.lit(" ")).otherwise(_named("Order_", "o_orderkey"))
    lines = table(spark, folder, "orders").withColumn("_column", named).select(
        F.when(F.col("o_orderpriority") < "3", commas).otherwise(tabs).alias("value"), F.col("o_orderpriority").alias("source")
    )
    path = new_folder(spark, label)
    lines.write.partitionBy("source").text(path)
    return path


def catalog_columns(spark, folder):
    return read_columns(spark, order_files(spark, folder, "columns"), "part-*").select(
        "table_schema", "table_name", "column_name", "data_type", "is_nullable"
    )


def catalog_index(spark, folder):
    return build_index(spark, order_files(spark, folder, "sources"), "part-*").select(
        "source_schema", "table_schema", "table_name", "column_name", "is_nullable"
    )


def turn_files(spark, folder, label):
    """A column for each turn of a conversation, its text as a quoted further cell: with line breaks, commas and quotes.

    Users have commas and two further cells, others tabs and one.
    """
    quoted = F.concat(F.lit('"'), F.replace(F.concat("text", F.lit(' said "'), "role", F.lit('",\t')), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.col("role"), _named("conv_", "conv_id"), _named("turn_", "turn"), F.lit("text"), F.char_length("text").cast("string"), F.lit("NO"), quoted]
    line = F.when(F.col("role") == "user", F.concat_ws(",", *cells, F.lit("5"))).otherwise(F.concat_ws("\t", *cells))
    path = new_folder(spark, label)
    table(spark, folder, "conversations").select(line.alias("value"), F.col("role").alias("source")).write.partitionBy("source").text(path)
    return path


def catalog_records(spark, folder):
    found = read_columns(spark, turn_files(spark, folder, "turns"), "part-*")
    return found.select("table_schema", "table_name", "column_name", "character_maximum_length", F.get("more", 0).alias("said"), F.get("more", 1).alias("last"))


def catalog_index_round_trip(spark, folder):
    """The index of all turns, each listed twice, once with a further cell, written and read again."""
    index = build_index(spark, turn_files(spark, folder, "turns"), "part-*")
    longer = index.withColumn("more", F.concat("more", F.array(F.lit(""), F.lit("more"))))
    path = new_folder(spark, "index")
    write_index(index.union(longer).union(index), path)
    return read_index(spark, path, "part-*", ",").select("source_schema", "table_name", "column_name", "is_nullable", F.array_join("more", "|").alias("more"))


def catalog_delimiters(spark, folder):
    """The separator of each file of columns, and how many records it has."""
    path = turn_files(spark, folder, "turns")
    found = read_records(spark, path, "part-*").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    both = detect_delimiters(spark, path, "part-*").join(found, "path")
    source = F.regexp_extract("path", "source=([^/]*)", 1)
    return both.groupBy(source.alias("source"), "sep").agg(F.sum("n").alias("n_records"))


def catalog_datasets(spark, folder):
    """A folder for each nation; those of the later regions hold a list of columns."""
    nations = table(spark, folder, "nation")
    path = new_folder(spark, "datasets")
    lines = nations.select(F.concat_ws(",", F.lit("dbo"), "n_name", F.col("n_nationkey").cast("string")).alias("value"), "n_name", "n_regionkey")
    lines.coalesce(1).write.partitionBy("n_regionkey", "n_name").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(hadoop.Path(f"{path}/n_regionkey=[1-9]/*/part-*")):  # a file for each nation
        files.rename(part.getPath(), hadoop.Path(part.getPath().getParent(), "columns.csv"))
    found = [find_datasets(spark, f"{path}/n_regionkey={k}") for k in range(1, 5)]
    return reduce(DataFrame.union, found).select("dataset", F.array_join("files", ",").alias("files"))


def import_constraints(spark, folder):
    """Constraints without the checks that only repeat NOT NULL."""
    orders = table(spark, folder, "orders")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_totalprice") < 50_000, "_not_null").otherwise("_not_null_2"))
    checks = orders.select(F.col("o_orderstatus").alias("constraint_schema"), name.alias("constraint_name"))
    return importing.drop_not_null_checks(checks.union(orders.select("o_orderstatus", _named("fk_not_null_", "o_orderkey"))))


def class_names(spark, folder):
    classes = table(spark, folder, "customer").select(
        F.col("c_name").alias("class_name"), F.when(F.col("c_acctbal") > 0, "CLASS").otherwise("VCLASS").alias("class_type"),
        F.when(F.col("c_mktsegment") == "BUILDING", "YES").otherwise("NO").alias("is_system_class"),
    )
    return importing.import_class_names(classes)


def url_parts(spark, folder):
    texts = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" a+b!~*'()é/?&")).alias("text"))
    encoded = texts.select("conv_id", "turn", url_part(F.col("text")).alias("encoded"), "text")
    return encoded.select("conv_id", "turn", "encoded", (url_text(F.col("encoded")) == F.col("text")).alias("decodes"))


def catalog_read_index(spark, folder):
    path = new_folder(spark, "index")
    order_index(spark, folder).distinct().write.csv(path)
    return read_index(spark, path, "part-*").select(*catalog.INDEX_KEY)


def _event_columns(spark, folder):
    """Each event is a column, named by its type, of the table of its user."""
    return table(spark, folder, "events").select(
        F.lit("app").alias("table_schema"),
        _named("user_", "user_id").alias("table_name"),
        F.initcap("event_type").alias("column_name"),
        F.col("event_id").alias("ordinal"),
    )


def _system_tables(spark, folder):
    orders = table(spark, folder, "orders")
    schemas = table(spark, folder, "nation").select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("schema_name"))
    system = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("schema_id"), F.col("c_name").alias("table_name")
    )
    columns = orders.select(
        F.col("o_custkey").alias("object_id"),
        F.substring("o_orderpriority", 1, 1).alias("type_id"),
        _named("o", "o_orderkey").alias("column_name"),
        F.col("o_orderkey").alias("ordinal"),
    )
    types = orders.select(F.substring("o_orderpriority", 1, 1).alias("type_id"), F.expr("substring(o_orderpriority, 3)").alias("type_name")).distinct()
    return schemas, system, columns, types


def catalog_related(spark, folder):
    customers = table(spark, folder, "customer").select(_named("customer_", "c_custkey").alias("table_name"), F.col("c_name").alias("column_name"))
    relations = table(spark, folder, "orders").select(_named("order_", "o_orderkey").alias("child"), _named("customer_", "o_custkey").alias("parent"))
    return catalog.related_only(customers, relations)


def path_split(spark, folder):
    paths = order_index(spark, folder).select(F.concat_ws("-", "table_schema", "table_name", "source_schema").alias("path"))
    return paths.select("path", split_path(F.col("path")).alias("p")).select("path", "p.schema", "p.table", "p.column")


def src_delimiters(spark, folder):
    documents = table(spark, folder, "documents").select(_named("document ", "doc_id").alias("path"), "text")
    pages = table(spark, folder, "pages").select(_named("page ", "page_id").alias("path"), F.col("html").alias("text"))
    both = documents.unionByName(pages)
    return both.select("path", delimiter_of(F.col("text")).alias("sep"))


def text_functions(spark, folder):
    pages = table(spark, folder, "pages")
    items = comma_list(F.col("html"))
    return pages.select(
        "page_id",
        url_text(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("decoded"),
        quote_literal(F.col("html")).alias("quoted"),
        F.size(items).cast("bigint").alias("items"),
        F.get(items, 0).alias("first_item"),
        snap(F.length("html"), 10).cast("bigint").alias("snapped"),
    )


# ---- key files: every line item is a key column and a relation ----


def keys_primary(spark, folder):
    path = new_folder(spark, "keys-primary")
    table(spark, folder, "lineitem").select(
        _named("order_", "l_orderkey").alias("TableName"), _named("line_", "l_linenumber").alias("ColumnName"), F.col("l_linenumber").alias("KeyOrder")
    ).write.csv(path, sep="\t", header=True)
    return read_primary_keys(spark, path)


def keys_foreign(spark, folder):
    path = new_folder(spark, "keys-foreign")
    table(spark, folder, "lineitem").select(
        F.lit("partkey").alias("ReferencedColumn"),
        _named("order_", "l_orderkey").alias("ParentTable"),
        _named("part_", "l_partkey").alias("ReferencedTable"),
        _named("line_", "l_linenumber").alias("ParentColumn"),
    ).write.csv(path, sep="\t", header=True)
    return read_foreign_keys(spark, path)


# ---- relations against columns ----


def _customer_relations(spark, folder):
    return table(spark, folder, "orders").select(
        _named("order_", "o_orderkey").alias("child"), F.lit("custkey").alias("child_column"),
        _named("customer_", "o_custkey").alias("parent"), F.lit("id").alias("parent_column"),
    )


def _declared_columns(spark, folder):
    """A column per order and per customer outside one segment, with a declared type."""
    orders = table(spark, folder, "orders").select(
        _named("order_", "o_orderkey").alias("table_name"), F.lit("custkey").alias("column_name"),
        F.when(F.col("o_orderstatus") == "F", "bigint").otherwise("INTEGER").alias("data_type"),
    )
    customers = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        _named("customer_", "c_custkey").alias("table_name"), F.lit("id").alias("column_name"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "serial").when(F.col("c_mktsegment") == "MACHINERY", "BIGSERIAL").otherwise("VARCHAR(20)").alias("data_type"),
    )
    return orders.unionByName(customers)


RELATIONS_SQL = "SELECT concat('order_', o_orderkey) AS child, 'custkey' AS child_column, concat('customer_', o_custkey) AS parent, 'id' AS parent_column"


# ---- catalogue tables of a database ----


def import_tables(spark, folder):
    classes = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("oid"),
        F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "pg_").otherwise(""), F.col("c_name")).alias("relname"),
        F.when(F.col("c_acctbal") > 0, "r").otherwise("v").alias("relkind"),
    )
    comments = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_name").alias("comment"))
    return importing.import_tables(classes, comments)


def import_columns(spark, folder):
    columns = table(spark, folder, "lineitem").select(
        _named("order_", "l_orderkey").alias("table_name"),
        _named("line_", "l_linenumber").alias("column_name"),
        F.col("l_linenumber").alias("ordinal_position"),
        F.when(F.col("l_returnflag") == "A", "varbinary(5)").when(F.col("l_returnflag") == "N", "numeric(8,0)").otherwise("int").alias("column_type"),
        F.when(F.col("l_linestatus") == "O", "YES").otherwise("NO").alias("is_nullable"),
        F.when(F.col("l_discount") > 0.05, "NULL").when(F.col("l_tax") > 0.04, _named("d", "l_partkey")).alias("column_default"),
        F.when(F.col("l_linenumber") == 1, "Auto_Increment").alias("extra"),
    )
    return importing.import_columns(columns)


def import_relations(spark, folder):
    usage = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("table_schema"), _named("order_", "l_orderkey").alias("table_name"), _named("fk_", "l_orderkey").alias("constraint_name"),
        _named("line_", "l_linenumber").alias("column_name"), _named("part_", "l_partkey").alias("referenced_table_name"), F.lit("partkey").alias("referenced_column_name"),
    )
    return importing.import_relations(usage, _order_constraints(spark, folder, "table_schema"))


def _order_constraints(spark, folder, schema_name):
    kind = F.when(F.col("o_orderpriority") < "3", "FOREIGN KEY").when(F.col("o_orderpriority") < "4", "CHECK").when(F.col("o_orderpriority") < "5", "PRIMARY KEY").otherwise("UNIQUE")
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias(schema_name), _named("order_", "o_orderkey").alias("table_name"), _named("fk_", "o_orderkey").alias("constraint_name"),
        kind.alias("constraint_type"),
    )


def _line_usage(spark, folder):
    """One key part per order and line number."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_linestatus").alias("schema"))
    return lines.select(
        F.col("schema").alias("constraint_schema"), _named("fk_", "l_orderkey").alias("constraint_name"), F.col("l_linenumber").alias("ordinal_position"),
        _named("order_", "l_orderkey").alias("table_name"), _named("line_", "l_linenumber").alias("column_name"), _named("part_", "part").alias("used"),
    )


LINE_USAGE_SQL = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_linestatus) AS sch FROM lineitem GROUP BY 1, 2"


def import_relations_pg(spark, folder):
    usage = _line_usage(spark, folder)
    parents = usage.select("constraint_schema", "constraint_name", "ordinal_position", F.col("used").alias("table_name"), F.lit("partkey").alias("column_name"))
    return importing.import_relations_pg(_order_constraints(spark, folder, "constraint_schema"), usage.drop("used"), parents)


def import_keys(spark, folder):
    statistics = table(spark, folder, "lineitem").select(
        _named("order_", "l_orderkey").alias("table_name"),
        F.when(F.col("l_linestatus") == "O", "PRIMARY").otherwise(_named("ix_", "l_returnflag")).alias("index_name"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("non_unique"),
        F.when(F.col("l_returnflag") == "N", "FULLTEXT").otherwise("BTREE").alias("index_type"),
        F.col("l_linenumber").alias("seq_in_index"),
        _named("part_", "l_partkey").alias("column_name"),
    )
    return importing.import_keys(statistics)


def import_keys_pg(spark, folder):
    return importing.import_keys_pg(_order_constraints(spark, folder, "constraint_schema"), _line_usage(spark, folder))


def import_index_columns(spark, folder):
    orders = table(spark, folder, "orders")
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    indexes = orders.select(
        _named("i", "o_orderkey").alias("indexrelid"), _named("c", "o_custkey").alias("indrelid"), F.array(first, F.lit(6) - first).alias("indkey"),
        (F.col("o_orderstatus") == "F").alias("indisunique"), F.lit(False).alias("indisprimary"),
    )
    customers = table(spark, folder, "customer")
    classes = orders.select(_named("i", "o_orderkey").alias("oid"), _named("index_", "o_orderkey").alias("relname")).unionByName(
        customers.select(_named("c", "c_custkey").alias("oid"), F.col("c_name").alias("relname"))
    )
    attributes = customers.select(_named("c", "c_custkey").alias("attrelid"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attnum")).withColumn(
        "attname", _named("column_", "attnum")
    )
    return importing.import_index_columns(indexes, classes, attributes)


def import_keys_cubrid(spark, folder):
    indexes = table(spark, folder, "orders").select(
        _named("order_", "o_orderkey").alias("class_name"), F.lit("ix").alias("index_name"),
        F.when(F.col("o_orderstatus") == "F", "YES").otherwise("NO").alias("is_unique"),
        F.when(F.col("o_orderpriority") < "2", "YES").otherwise("NO").alias("is_primary_key"),
        F.when(F.col("o_orderpriority") > "5", "YES").otherwise("NO").alias("is_foreign_key"),
    )
    lines = table(spark, folder, "lineitem")
    index_keys = lines.select(
        _named("order_", "l_orderkey").alias("class_name"), F.lit("ix").alias("index_name"), F.col("l_linenumber").alias("key_order"), _named("part_", "l_partkey").alias("key_attr_name")
    )
    attributes = lines.where("l_linestatus = 'O'").select(_named("order_", "l_orderkey").alias("class_name"), _named("part_", "l_partkey").alias("attr_name")).distinct()
    return importing.import_keys_cubrid(indexes, index_keys, attributes)


QUERIES = {
    "catalog_columns": catalog_columns,
    "catalog_index": catalog_index,
    "catalog_read_index": catalog_read_index,
    "catalog_records": catalog_records,
    "catalog_datasets": catalog_datasets,
    "import_constraints": import_constraints,
    "import_class_names": class_names,
    "url_parts": url_parts,
    "catalog_index_round_trip": catalog_index_round_trip,
    "catalog_delimiters": catalog_delimiters,
    "catalog_find": lambda s, d: catalog.find_columns(order_index(s, d), "R_9"),
    "catalog_find_tables": lambda s, d: catalog.find_tables(order_index(s, d), "h.P.CUSTOMER_1"),
    "catalog_refine": lambda s, d: catalog.refine(order_index(s, d), ["F-cust", "_1", "99"]),
    "catalog_related": catalog_related,
    "catalog_columns_per_table": lambda s, d: catalog.columns_per_table(_event_columns(s, d)),
    "catalog_tables_per_column": lambda s, d: catalog.tables_per_column(_event_columns(s, d)),
    "catalog_live": lambda s, d: catalog.system_catalog(*_system_tables(s, d)),
    "path_split": path_split,
    "safe_names": lambda s, d: table(s, d, "pages").select("page_id", safe_name(F.col("url")).alias("url_name"), safe_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("last_name")),
    "text_functions": text_functions,
    "src_delimiters": src_delimiters,
    "keys_primary": keys_primary,
    "keys_foreign": keys_foreign,
    "relations_resolved": lambda s, d: keys.resolved(_customer_relations(s, d), _declared_columns(s, d)),
    "relations_dangling": lambda s, d: keys.dangling(_customer_relations(s, d), _declared_columns(s, d)),
    "fk_type_mismatch": lambda s, d: keys.foreign_key_mismatches(_customer_relations(s, d), _declared_columns(s, d)),
    "import_tables": import_tables,
    "import_columns": import_columns,
    "import_relations": import_relations,
    "import_relations_pg": import_relations_pg,
    "import_keys": import_keys,
    "import_keys_pg": import_keys_pg,
    "import_index_columns": import_index_columns,
    "import_keys_cubrid": import_keys_cubrid,
}

SQL = {
    "catalog_columns": """
        SELECT o_orderstatus AS table_schema, concat('customer_', o_custkey) AS table_name,
               concat('Order_', o_orderkey) AS column_name, 'int' AS data_type, 'YES' AS is_nullable
        FROM orders WHERE o_totalprice >= 50000""",
    "catalog_index": """
        SELECT DISTINCT o_orderpriority AS source_schema, o_orderstatus AS table_schema, concat('customer_', o_custkey) AS table_name,
               CASE WHEN o_totalprice < 50000 THEN '' ELSE concat('Order_', o_orderkey) END AS column_name, 'YES' AS is_nullable
        FROM orders""",
    "catalog_read_index": f"SELECT DISTINCT * FROM ({ORDER_INDEX_SQL})",
    "catalog_records": f"""
        SELECT role AS table_schema, concat('conv_', conv_id) AS table_name, concat('turn_', turn) AS column_name,
               CAST(length(text) AS VARCHAR) AS character_maximum_length, {SAID} AS said, CASE WHEN role = 'user' THEN '5' END AS last
        FROM conversations""",
    "catalog_datasets": "SELECT concat('n_name=', n_name) AS dataset, 'columns.csv' AS files FROM nation WHERE n_regionkey > 0",
    "import_constraints": """
        SELECT o_orderstatus AS constraint_schema, concat(o_orderkey, '_not_null_2') AS constraint_name FROM orders WHERE o_totalprice >= 50000
        UNION ALL SELECT o_orderstatus, concat('fk_not_null_', o_orderkey) FROM orders""",
    "import_class_names": "SELECT c_name AS table_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'",
    "url_parts": """
        SELECT conv_id, turn, true AS decodes,
               replace(replace(replace(replace(replace(url_encode(concat(text, ' a+b!~*', chr(39), '()é/?&')), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')') AS encoded
        FROM conversations""",
    "catalog_index_round_trip": f"""
        WITH turns AS (
            SELECT DISTINCT role AS source_schema, concat('conv_', conv_id) AS table_name, concat('turn_', turn) AS column_name, 'NO' AS is_nullable,
                   {SAID} || CASE WHEN role = 'user' THEN '|5' ELSE '' END AS more, length(text) AS n
            FROM conversations)
        SELECT * EXCLUDE (n) FROM turns UNION ALL SELECT * EXCLUDE (n) REPLACE (more || '||more' AS more) FROM turns""",
    "catalog_delimiters": """
        SELECT role AS source, CASE WHEN role = 'user' THEN ',' ELSE chr(9) END AS sep, CAST(count(*) AS BIGINT) AS n_records
        FROM conversations GROUP BY 1""",
    "catalog_find": f"""
        SELECT *, concat_ws('.', source_schema, table_schema, table_name, column_name) AS qualified_name,
               row_number() OVER (ORDER BY lower(source_schema), lower(table_schema), lower(table_name), lower(column_name),
                                           source_schema, table_schema, table_name, column_name) AS position
        FROM (SELECT DISTINCT * FROM ({ORDER_INDEX_SQL}) WHERE contains(lower(column_name), 'r_9'))""",
    "catalog_find_tables": f"""
        SELECT DISTINCT source_schema, table_schema, table_name, concat_ws('.', source_schema, table_schema, table_name) AS qualified_name
        FROM ({ORDER_INDEX_SQL}) WHERE contains(lower(concat_ws('.', source_schema, table_schema, table_name)), 'h.p.customer_1')""",
    "catalog_refine": f"""
        SELECT * FROM ({ORDER_INDEX_SQL})
        WHERE contains(lower(concat_ws('-', table_schema, table_name, column_name)), 'f-cust')
          AND contains(lower(concat_ws('-', table_schema, table_name, column_name)), '_1')
          AND contains(lower(concat_ws('-', table_schema, table_name, column_name)), '99')""",
    "catalog_related": """
        SELECT concat('customer_', c_custkey) AS table_name, c_name AS column_name FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "catalog_columns_per_table": """
        SELECT 'app' AS table_schema, concat('user_', user_id) AS table_name,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
               concat(upper(event_type[1]), event_type[2:]) AS column_name FROM events""",
    "catalog_tables_per_column": """
        SELECT DISTINCT event_type AS column_key, 'app' AS table_schema, concat('user_', user_id) AS table_name FROM events""",
    "catalog_live": """
        SELECT n_name AS schema_name, c_name AS table_name, concat('o', o_orderkey) AS column_name,
               substring(o_orderpriority, 3) AS type_name, o_orderkey AS ordinal
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "path_split": """
        SELECT concat_ws('-', o_orderstatus, concat('customer_', o_custkey), o_orderpriority) AS path, o_orderstatus AS "schema",
               concat('customer_', o_custkey) AS "table", o_orderpriority AS "column" FROM orders""",
    "safe_names": r"""
        SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g'), '_'), ''), 'value') AS url_name,
               coalesce(nullif(trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\p{L}\p{N}]', '_', 'g'), '_'), ''), 'value') AS last_name
        FROM pages""",
    "text_functions": """
        WITH p AS (SELECT *, list_filter(list_transform(string_split(html, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS items FROM pages)
        SELECT page_id, url AS decoded, concat('''', replace(html, '''', ''''''), '''') AS quoted, len(items) AS items, items[1] AS first_item,
               (round(length(html) / 10) * 10)::BIGINT AS snapped FROM p""",
    "src_delimiters": """
        WITH lines AS (
            SELECT concat('document ', doc_id) AS path, split_part(text, chr(10), 1) AS line FROM documents
            UNION ALL SELECT concat('page ', page_id), split_part(html, chr(10), 1) FROM pages)
        SELECT path, CASE WHEN length(line) - length(replace(line, ',', '')) > length(line) - length(replace(line, chr(9), ''))
                          THEN ',' ELSE chr(9) END AS sep FROM lines""",
    "keys_primary": "SELECT concat('order_', l_orderkey) AS table_name, concat('line_', l_linenumber) AS column_name, l_linenumber AS key_order FROM lineitem",
    "keys_foreign": """
        SELECT concat('order_', l_orderkey) AS child, concat('line_', l_linenumber) AS child_column,
               concat('part_', l_partkey) AS parent, 'partkey' AS parent_column FROM lineitem""",
    "relations_resolved": RELATIONS_SQL + " FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'",
    "relations_dangling": RELATIONS_SQL + " FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
    "fk_type_mismatch": f"""
        WITH ends AS ({RELATIONS_SQL},
                   CASE WHEN o_orderstatus = 'F' THEN 'bigint' ELSE 'INTEGER' END AS child_type,
                   CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'serial' WHEN 'MACHINERY' THEN 'BIGSERIAL' ELSE 'VARCHAR(20)' END AS parent_type,
                   CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'INTEGER' WHEN 'MACHINERY' THEN 'BIGINT' ELSE 'VARCHAR(20)' END AS expected_type
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING')
        SELECT * FROM ends WHERE upper(child_type) <> expected_type""",
    "import_tables": """
        SELECT c_name AS table_name, s_name AS comment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
        WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0""",
    "import_columns": """
        SELECT concat('order_', l_orderkey) AS table_name, l_linenumber::BIGINT AS position, concat('line_', l_linenumber) AS column_name,
               CASE l_returnflag WHEN 'A' THEN 'VARBINARY(5)' WHEN 'N' THEN 'NUMERIC(8)' ELSE 'INT' END AS data_type,
               (l_linestatus = 'O')::BIGINT AS nullable, (l_linenumber = 1)::BIGINT AS autoincrement,
               CASE WHEN l_discount > 0.05 AND l_returnflag = 'A' THEN lower(hex('NULL'))
                    WHEN l_discount > 0.05 THEN ''
                    WHEN l_tax > 0.04 AND l_returnflag = 'A' THEN lower(hex(concat('d', l_partkey)))
                    WHEN l_tax > 0.04 THEN concat('d', l_partkey) END AS "default"
        FROM lineitem""",
    "import_relations": """
        SELECT concat('fk_', l_orderkey) AS constraint_name, concat('order_', l_orderkey) AS child, concat('line_', l_linenumber) AS child_column,
               concat('part_', l_partkey) AS parent, 'partkey' AS parent_column
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus WHERE o_orderpriority < '3'""",
    "import_relations_pg": f"""
        SELECT concat('fk_', l_orderkey) AS constraint_name, concat('order_', l_orderkey) AS child, concat('line_', l_linenumber) AS child_column,
               concat('part_', part) AS parent, 'partkey' AS parent_column
        FROM ({LINE_USAGE_SQL}) JOIN orders ON l_orderkey = o_orderkey AND sch = o_orderstatus WHERE o_orderpriority < '3'""",
    "import_keys": """
        SELECT concat('order_', l_orderkey) AS table_name, key_name,
               CASE WHEN key_name = 'PRIMARY' THEN 'PRIMARY' WHEN l_returnflag = 'A' THEN 'UNIQUE' WHEN l_returnflag = 'N' THEN 'FULLTEXT' ELSE 'INDEX' END AS key_type,
               row_number() OVER (PARTITION BY l_orderkey, key_name ORDER BY l_linenumber, concat('part_', l_partkey)) AS part,
               concat('part_', l_partkey) AS column_name
        FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'PRIMARY' ELSE concat('ix_', l_returnflag) END AS key_name FROM lineitem)""",
    "import_keys_pg": f"""
        SELECT concat('order_', o_orderkey) AS table_name, concat('fk_', o_orderkey) AS key_name,
               CASE WHEN o_orderpriority < '5' THEN 'PRIMARY' ELSE 'UNIQUE' END AS key_type,
               l_linenumber::BIGINT AS part, CASE WHEN l_linenumber IS NOT NULL THEN concat('line_', l_linenumber) END AS column_name
        FROM orders LEFT JOIN ({LINE_USAGE_SQL}) ON l_orderkey = o_orderkey AND sch = o_orderstatus WHERE o_orderpriority >= '4'""",
    "import_index_columns": """
        SELECT c_name AS table_name, concat('index_', o_orderkey) AS key_name, 'INDEX' AS key_type, part::BIGINT AS part,
               concat('column_', attnum) AS column_name
        FROM (SELECT o_orderkey, o_custkey, part, CASE part WHEN 1 THEN left(o_orderpriority, 1)::INT ELSE 6 - left(o_orderpriority, 1)::INT END AS attnum
              FROM orders, (VALUES (1), (2)) p(part) WHERE o_orderstatus <> 'F')
        JOIN customer ON o_custkey = c_custkey WHERE attnum <= 4""",
    "import_keys_cubrid": """
        SELECT DISTINCT concat('order_', o_orderkey) AS table_name, 'ix' AS key_name,
               CASE WHEN o_orderpriority < '2' THEN 'PRIMARY' WHEN o_orderstatus = 'F' THEN 'UNIQUE' ELSE 'INDEX' END AS key_type,
               l_linenumber::BIGINT AS part, concat('part_', l_partkey) AS column_name
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderpriority < '5'
          AND EXISTS (SELECT 1 FROM lineitem a WHERE a.l_linestatus = 'O' AND a.l_orderkey = l.l_orderkey AND a.l_partkey = l.l_partkey)""",
}
