"""Rules checked on the given tables, and tables brought into declared shape."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from keyweave.functions.text import parse_type
from keyweave.functions.types import DIALECT_TYPES, map_types
from keyweave.operators import checks
from keyweave.operators.conform import DeclaredColumn, assign_ids, check_length, conform, fill_defaults
from keyweave.plans.check_report import check_all
from keyweave.workload.tables import RULES, Tables, table

ORDERS = [
    DeclaredColumn("o_orderkey", "BIGINT", nullable=False),
    DeclaredColumn("o_orderdate", "DATE"),
    DeclaredColumn("o_custkey", "VARCHAR(20)"),
    DeclaredColumn("o_totalprice", "INTEGER"),
    DeclaredColumn("o_orderstatus", "CHAR(1)"),
]

PAGE_NUMBERS = [DeclaredColumn("page_id", "INTEGER", nullable=False), DeclaredColumn("page_number", "INTEGER")]

DOCUMENT_LENGTHS = [
    DeclaredColumn("text", "VARCHAR(500)"),
    DeclaredColumn("source", "VARCHAR(4)"),
    DeclaredColumn("lang", "CHAR(2)"),
]

LINE_LENGTHS = [DeclaredColumn("l_extendedprice", "DECIMAL(6,2)"), DeclaredColumn("l_discount", "DECIMAL(3,1)")]

LABELLED = [
    DeclaredColumn("doc_id", "BIGINT", nullable=False),
    DeclaredColumn("quality", "INTEGER", nullable=False, default="7"),
    DeclaredColumn("toxic", "INTEGER", default="null"),
    DeclaredColumn("reviewer", "VARCHAR(20)", nullable=False),
    DeclaredColumn("status", "VARCHAR(20)", default="open"),
    DeclaredColumn("loaded_at", "DATETIME", default="CURRENT_TIMESTAMP"),
]

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)


def _page_numbers(spark, folder):
    """The last part of each URL, which is not always a number."""
    return table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "/([^/]*)$", 1).alias("page_number"))


def _labelled(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")


def _declared_types(spark, folder):
    """A declared type for each line item, in several spellings."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    declared = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("varchar("), quantity, F.lit(")")))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("Decimal(20,"), F.col("l_linenumber").cast("string"), F.lit(")")))
        .when(F.col("l_returnflag") == "R", F.lit("DEC"))
        .otherwise(F.concat(F.lit("numeric("), quantity, F.lit(",0)")))
    )
    return table(spark, folder, "lineitem").select(declared.alias("data_type"))


DECLARED_TYPES_SQL = """
    SELECT CASE WHEN l_returnflag = 'A' THEN concat('varchar(', l_quantity::INT, ')')
                WHEN l_linestatus = 'O' THEN concat('Decimal(20,', l_linenumber, ')')
                WHEN l_returnflag = 'R' THEN 'DEC'
                ELSE concat('numeric(', l_quantity::INT, ',0)') END AS data_type
    FROM lineitem"""


def _other_customers(spark, folder):
    return table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'")


def type_parse(spark, folder):
    parsed = _declared_types(spark, folder).select(parse_type(F.col("data_type")).alias("t")).select("t.name", "t.size")
    return parsed.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n"))


def type_map(spark, folder):
    mapped = map_types(_declared_types(spark, folder), "mysql")
    return mapped.groupBy("spark_type", "mapped").agg(F.count(F.lit(1)).alias("n"))


def dialect_types(dialect: str):
    """Each line item declares a type of the dialect, in turn, some with a size, some in lower case, some unknown."""
    names = sorted(DIALECT_TYPES[dialect])

    def query(spark, folder):
        name = F.element_at(F.array(*map(F.lit, names)), F.pmod("l_partkey", F.lit(len(names))).cast("int") + 1)
        sized = F.when(F.col("l_linenumber") == 1, F.concat(name, F.lit("(6,2)"))).when(F.col("l_linenumber") == 2, F.lower(name)).otherwise(name)
        declared = F.when(F.pmod("l_suppkey", F.lit(10)) == 0, "MYSTERY(3)").otherwise(sized)
        mapped = map_types(table(spark, folder, "lineitem").select(declared.alias("data_type")), dialect)
        return mapped.groupBy("data_type", "spark_type", "mapped").agg(F.count(F.lit(1)).alias("n"))

    return query


def dialect_types_sql(dialect: str) -> str:
    rows = ", ".join(f"({i}, '{name}', '{base}')" for i, (name, base) in enumerate(sorted(DIALECT_TYPES[dialect].items())))
    return f"""
        WITH known(i, name, base) AS (VALUES {rows}),
        declared AS (
            SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'MYSTERY(3)' WHEN l_linenumber = 1 THEN name || '(6,2)' WHEN l_linenumber = 2 THEN lower(name) ELSE name END AS data_type,
                   l_suppkey % 10 <> 0 AS mapped, name, base, l_linenumber = 1 AS sized
            FROM lineitem JOIN known ON i = l_partkey % {len(DIALECT_TYPES[dialect])})
        SELECT data_type, CASE WHEN NOT mapped THEN 'STRING' WHEN base = 'DECIMAL' AND sized THEN 'DECIMAL(6,2)' WHEN base = 'DECIMAL' THEN 'DECIMAL(38,18)'
                               WHEN name = 'BIT' AND base = 'BOOLEAN' AND sized THEN 'BINARY' ELSE base END AS spark_type,
               mapped, count(*) AS n FROM declared GROUP BY ALL"""


def autoincrement(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return assign_ids(events, "new_id", [F.col("user_id"), F.desc("ts"), F.col("event_id")], table(spark, folder, "orders").select(F.col("o_orderkey").alias("new_id")))


QUERIES = {
    **{f"type_map_{dialect}": dialect_types(dialect) for dialect in DIALECT_TYPES},
    "check_pk_orders": lambda s, d: checks.check_primary_key(table(s, d, "orders"), ["o_orderkey"]),
    "check_pk_lineitem": lambda s, d: checks.check_primary_key(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "check_unique_part_name": lambda s, d: checks.check_unique(table(s, d, "part"), ["p_name"]),
    "check_not_null": lambda s, d: checks.check_not_null(_labelled(s, d), ["doc_id", "quality", "toxic"]),
    "check_fk_events_customer": lambda s, d: checks.check_foreign_key(table(s, d, "events"), table(s, d, "customer"), ["user_id"], ["c_custkey"]),
    "check_fk_orphans": lambda s, d: checks.check_foreign_key(table(s, d, "events"), _other_customers(s, d), ["user_id"], ["c_custkey"]),
    "check_fk_orphan_rows": lambda s, d: checks.orphan_rows(table(s, d, "orders"), _other_customers(s, d), ["o_custkey"], ["c_custkey"]),
    "orders_without_lineitems": lambda s, d: checks.unreferenced_parents(table(s, d, "orders"), table(s, d, "lineitem"), ["o_orderkey"], ["l_orderkey"]),
    "check_report": lambda s, d: check_all(Tables(s, d), RULES),
    "conform_orders": lambda s, d: conform(table(s, d, "orders"), ORDERS, lossy=True).rows,
    "conform_pages": lambda s, d: conform(_page_numbers(s, d), PAGE_NUMBERS).rows,
    "conform_rejects": lambda s, d: conform(_page_numbers(s, d), PAGE_NUMBERS).rejects.withColumn("failed_columns", F.array_join("failed_columns", ",")),
    "check_length": lambda s, d: check_length(table(s, d, "documents"), DOCUMENT_LENGTHS).unionByName(check_length(table(s, d, "lineitem"), LINE_LENGTHS)),
    "fill_defaults": lambda s, d: fill_defaults(_labelled(s, d), LABELLED, now=NOW),
    "autoincrement": autoincrement,
    "type_parse": type_parse,
    "type_map": type_map,
}


def _rule_sql(table_name: str, rule: str, columns: str, violations: str) -> str:
    return f"SELECT '{table_name}' AS table_name, '{rule}' AS rule, '{columns}' AS columns, ({violations})::BIGINT AS violations"


def _report_sql() -> str:
    parts = []
    for name, rules in RULES.items():
        for rule, keys in (("primary key", [rules.primary_key]), ("unique", rules.unique)):
            for key in keys:
                listed = ",".join(key)
                nulls = " OR ".join(f"{k} IS NULL" for k in key)
                test = f"count(*) > 1 OR {nulls}" if rule == "primary key" else f"count(*) > 1 AND NOT ({nulls})"
                counted = f"SELECT count(*) FROM (SELECT {listed} FROM {name} GROUP BY {listed} HAVING {test})"
                parts.append(_rule_sql(name, rule, listed, counted))
        for fk in rules.foreign_keys:
            child, parent = fk.columns[0], fk.parent_columns[0]
            counted = (
                f"SELECT count(*) FROM {name} c WHERE c.{child} IS NOT NULL"
                f" AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE p.{parent} = c.{child})"
            )
            parts.append(_rule_sql(name, "foreign key", child, counted))
        for c in rules.not_null:
            parts.append(_rule_sql(name, "not null", c, f"SELECT count(*) FROM {name} WHERE {c} IS NULL"))
        for d in rules.sized:
            parts.append(_rule_sql(name, "length", d.name, f"SELECT count(*) FROM {name} WHERE length({d.name}) > {d.size[0]}"))
    return " UNION ALL ".join(parts)


LABELLED_SQL = "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
PAGE_NUMBERS_SQL = "SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS page_number FROM pages"

SQL = {
    **{f"type_map_{dialect}": dialect_types_sql(dialect) for dialect in DIALECT_TYPES},
    "check_pk_orders": "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_orderkey IS NULL",
    "check_pk_lineitem": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "check_unique_part_name": "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "check_not_null": f"""
        WITH l AS ({LABELLED_SQL})
        SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS null_count FROM l
        UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM l
        UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM l""",
    "check_fk_events_customer": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "check_fk_orphans": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1",
    "check_fk_orphan_rows": "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
    "orders_without_lineitems": "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "check_report": _report_sql(),
    "conform_orders": """
        SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_custkey::VARCHAR AS o_custkey,
               trunc(o_totalprice)::INTEGER AS o_totalprice, o_orderstatus FROM orders""",
    "conform_pages": f"""
        SELECT page_id::INTEGER AS page_id, page_number::INTEGER AS page_number FROM ({PAGE_NUMBERS_SQL})
        WHERE regexp_full_match(page_number, '[0-9]+')""",
    "conform_rejects": f"""
        SELECT page_id, page_number, 'page_number' AS failed_columns FROM ({PAGE_NUMBERS_SQL})
        WHERE NOT regexp_full_match(page_number, '[0-9]+')""",
    "check_length": """
        SELECT 'text' AS column_name, 'VARCHAR(500)' AS declared_type, count(*) FILTER (length(text) > 500) AS violations FROM documents
        UNION ALL SELECT 'source', 'VARCHAR(4)', count(*) FILTER (length(source) > 4) FROM documents
        UNION ALL SELECT 'lang', 'CHAR(2)', count(*) FILTER (length(lang) > 2) FROM documents
        UNION ALL SELECT 'l_extendedprice', 'DECIMAL(6,2)', count(*) FILTER (l_extendedprice >= 10000) FROM lineitem
        UNION ALL SELECT 'l_discount', 'DECIMAL(3,1)', count(*) FILTER (round(l_discount, 1) <> l_discount) FROM lineitem""",
    "fill_defaults": f"""
        SELECT doc_id, coalesce(quality, 7) AS quality, toxic, '' AS reviewer, 'open' AS status,
               TIMESTAMP '2024-05-06 07:08:09' AS loaded_at FROM ({LABELLED_SQL})""",
    "autoincrement": """
        SELECT event_id, ts, user_id,
               row_number() OVER (ORDER BY user_id, ts DESC, event_id) + (SELECT max(o_orderkey) FROM orders) AS new_id
        FROM events""",
    "type_parse": f"""
        SELECT upper(regexp_extract(data_type, '^([^(]+)', 1)) AS name,
               nullif(replace(regexp_extract(data_type, '[(](.*)[)]', 1), ',0', ''), '') AS size, count(*) AS n
        FROM ({DECLARED_TYPES_SQL}) GROUP BY 1, 2""",
    "type_map": f"""
        SELECT CASE WHEN starts_with(data_type, 'Decimal') THEN upper(data_type)
                    WHEN data_type = 'DEC' THEN 'DECIMAL(38,18)' ELSE 'STRING' END AS spark_type,
               NOT starts_with(data_type, 'numeric') AS mapped, count(*) AS n
        FROM ({DECLARED_TYPES_SQL}) GROUP BY 1, 2""",
}
