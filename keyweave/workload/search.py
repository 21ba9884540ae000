"""Value search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.operators.search import TableSearch, search_indexed, search_tables, search_values
from keyweave.sources.live import catalog_of
from keyweave.workload.tables import Tables, table

TEXT_COLUMNS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}


def _hits_sql(table_name: str, test: str, columns=None, where: str = "true", extra: str = "") -> str:
    """Hits of one table: one count per column, columns without a match left out."""
    counts = [
        f"SELECT {extra}'{c}' AS column_name, count(*) AS match_count FROM {table_name} WHERE ({where}) AND ({test.format(c=c)})"
        for c in columns or TEXT_COLUMNS[table_name]
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(counts) + ") WHERE match_count > 0"


def _search(name: str, value: str, **options):
    return lambda spark, folder: search_values(table(spark, folder, name), value, **options)


def from_index(spark, folder):
    """Search the tables whose name in the catalogue of all given tables begins with p; each in its own way."""
    own = Tables(spark, folder)
    columns = catalog_of(spark, own)
    index = columns.select(F.lit("lake").alias("source_schema"), F.lit("main").alias("table_schema"), "table_name", "column_name")
    searches = {
        "lake.main.part": TableSearch(row_filter="p_size > 10", key=("p_partkey",), exclude="p_type"),
        "lake.main.pages": TableSearch(key=("page_id",), ignore_case=True),
    }
    return search_indexed(index, "MAIN.P", {f"lake.main.{name}": df for name, df in own.items()}, "an", searches)


def search_from_index_samples(spark, folder):
    samples = from_index(spark, folder)[1]
    key = F.coalesce(F.get_json_object("row_json", "$.p_partkey"), F.get_json_object("row_json", "$.page_id"))
    return samples.select("table_name", "column_name", key.cast("bigint").alias("row_key"))


QUERIES = {
    "search_from_index": lambda s, d: from_index(s, d)[0],
    "search_from_index_samples": search_from_index_samples,
    "search_contains": lambda s, d: _search("orders", "URG")(s, d).hits,
    "search_contains_documents": lambda s, d: _search("documents", "the")(s, d).hits,
    "search_like": lambda s, d: _search("part", "e%r_n", mode="like")(s, d).hits,
    "search_equals": lambda s, d: _search("part", "ECONOMY", mode="equals")(s, d).hits,
    "search_row_filter": lambda s, d: _search("lineitem", "R", row_filter="l_quantity > 30 OR l_discount = 0.05")(s, d).hits,
    "search_exclude": lambda s, d: _search("documents", "s", exclude=" text, ,lang ")(s, d).hits,
    "search_ignore_case": lambda s, d: _search("documents", "THE", ignore_case=True)(s, d).hits,
    "search_samples": lambda s, d: _search("orders", "O", key=["o_orderkey"])(s, d).sample_rows,
    "search_samples_json": lambda s, d: _search("customer", "URN", key=["c_custkey"])(s, d).samples,
    "search_summary": lambda s, d: _search("conversations", "user", table="conversations")(s, d).report(),
    "search_all_tables": lambda s, d: search_tables(Tables(s, d), "an"),
}

PART_HITS = "FROM part WHERE p_size > 10 AND contains({c}, 'an')"
PAGE_HITS = "FROM pages WHERE contains(lower({c}), 'an')"

SQL = {
    "search_from_index": " UNION ALL ".join([
        _hits_sql("part", "contains({c}, 'an')", ["p_name", "p_brand"], "p_size > 10", "'lake.main.part' AS table_name, "),
        _hits_sql("pages", "contains(lower({c}), 'an')", extra="'lake.main.pages' AS table_name, "),
    ]),
    "search_from_index_samples": " UNION ALL ".join(
        f"(SELECT 'lake.main.{t}' AS table_name, '{c}' AS column_name, {k}::BIGINT AS row_key {hits.format(c=c)} ORDER BY {k} LIMIT 5)"
        for t, k, hits, columns in [("part", "p_partkey", PART_HITS, ["p_name", "p_brand"]), ("pages", "page_id", PAGE_HITS, ["url", "html"])]
        for c in columns
    ),
    "search_contains": _hits_sql("orders", "contains({c}, 'URG')"),
    "search_contains_documents": _hits_sql("documents", "contains({c}, 'the')"),
    "search_like": _hits_sql("part", "{c} LIKE '%e%r_n%'"),
    "search_equals": _hits_sql("part", "{c} = 'ECONOMY'"),
    "search_row_filter": _hits_sql("lineitem", "contains({c}, 'R')", where="l_quantity > 30 OR l_discount = 0.05"),
    "search_exclude": _hits_sql("documents", "contains({c}, 's')", columns=["source"]),
    "search_ignore_case": _hits_sql("documents", "contains(lower({c}), 'the')"),
    "search_samples": """
        SELECT * FROM (
            SELECT 'o_orderstatus' AS column_name, * FROM orders WHERE contains(o_orderstatus, 'O')
            UNION ALL
            SELECT 'o_orderpriority' AS column_name, * FROM orders WHERE contains(o_orderpriority, 'O'))
        QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) <= 5""",
    "search_samples_json": """
        SELECT column_name, row_json FROM (
            SELECT 'c_name' AS column_name, c_custkey, to_json(customer)::VARCHAR AS row_json
            FROM customer WHERE contains(c_name, 'URN')
            UNION ALL
            SELECT 'c_mktsegment' AS column_name, c_custkey, to_json(customer)::VARCHAR AS row_json
            FROM customer WHERE contains(c_mktsegment, 'URN'))
        QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY c_custkey) <= 5""",
    "search_summary": "SELECT *, 'conversations' AS target_table, '1 = 1' AS row_filter, 'user' AS search_value,"
    " 2::BIGINT AS columns_scanned FROM (" + _hits_sql("conversations", "contains({c}, 'user')") + ")",
    "search_all_tables": " UNION ALL ".join(
        _hits_sql(name, "contains({c}, 'an')", extra=f"'{name}' AS table_name, ") for name in TEXT_COLUMNS
    ),
}
