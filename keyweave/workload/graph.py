"""Join paths over the foreign keys of the given tables, and key graphs whose edges are data rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.operators import graph
from keyweave.plans.join_path import both_directions, join_path, shortest_path
from keyweave.workload.tables import Tables, foreign_keys, table


def join_path_lineitem_region(spark, folder):
    joined = join_path(Tables(spark, folder), foreign_keys(spark), "lineitem", "region")
    last = next(c for c in joined.columns if c.endswith("__r_name"))
    return joined.groupBy(F.col(last).alias("r_name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t0__l_quantity").cast("bigint").alias("quantity")
    )


def join_path_orders_supplier(spark, folder):
    joined = join_path(Tables(spark, folder), foreign_keys(spark), "orders", "supplier")
    return joined.groupBy(F.col("t2__s_name").alias("s_name")).agg(
        F.count(F.lit(1)).alias("n"), F.max("t0__o_orderkey").alias("last_order")
    )


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def relation_rows(spark, folder):
    """Every row of a child table as an edge to its parent rows, in a fixed order."""
    parts = [
        ("orders", "order_", "o_orderkey", "customer_", "o_custkey", 1),
        ("lineitem", "order_", "l_orderkey", "supplier_", "l_suppkey", 2),
        ("customer", "customer_", "c_custkey", "nation_", "c_nationkey", 3),
        ("supplier", "supplier_", "s_suppkey", "nation_", "s_nationkey", 4),
        ("nation", "nation_", "n_nationkey", "region_", "n_regionkey", 5),
    ]
    edges = None
    for name, child, child_key, parent, parent_key, kind in parts:
        rows = table(spark, folder, name).select(
            _node(child, child_key).alias("child"), _node(parent, parent_key).alias("parent"),
            (F.col(parent_key).cast("bigint") * 10 + kind).alias("edge_ord"),
        )
        edges = rows if edges is None else edges.unionByName(rows)
    return edges


def join_path_rows(spark, folder):
    path = shortest_path(both_directions(cut(relation_rows(spark, folder), "relations")), "order_153", "region_4")
    steps = path.select(F.posexplode("path").alias("_pos", "_step"))
    return steps.select(
        (F.col("_pos") + 1).cast("bigint").alias("step"), F.col("_step.table").alias("table_name"), F.col("_step.edge_ord").alias("edge_ord")
    )


def part_supplier(spark, folder):
    return table(spark, folder, "lineitem").select(_node("p", "l_partkey").alias("src"), _node("s", "l_suppkey").alias("dst"))


def one_space(spark, folder):
    """Part and supplier keys taken as names of one kind: with self edges, mutual pairs and parallel edges."""
    return table(spark, folder, "lineitem").select(_node("t", "l_suppkey").alias("src"), _node("t", "l_partkey").alias("dst"))


def order_chain(spark, folder):
    """Order and customer keys taken as names of one kind: a sparse graph with many single children."""
    return table(spark, folder, "orders").select(_node("t", "o_orderkey").alias("src"), _node("t", "o_custkey").alias("dst"))


def event_chain(spark, folder):
    """The table of each event refers to that of its user."""
    return table(spark, folder, "events").select(_node("t", "event_id").alias("src"), _node("t", "user_id").alias("dst"))


def document_line(spark, folder):
    """Each document refers to the next one, and the event of a number to the document of its user: one long chain with fans."""
    documents = table(spark, folder, "documents")
    line = documents.select(_node("d", "doc_id").alias("src"), F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string")).alias("dst"))
    return line.unionByName(table(spark, folder, "events").select(_node("e", "event_id").alias("src"), _node("d", "user_id").alias("dst")))


def document_ring(spark, folder):
    """As `document_line` without fans, closed to a ring by an edge from each hundredth document back to the first."""
    documents = table(spark, folder, "documents")
    line = documents.select(_node("d", "doc_id").alias("src"), F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string")).alias("dst"))
    return line.unionByName(documents.where("doc_id % 100 = 0").select(_node("d", "doc_id").alias("src"), F.lit("d0").alias("dst")))


def _customers(spark, folder):
    return table(spark, folder, "customer").select(_node("t", "c_custkey").alias("node"))


def table_stats(spark, folder):
    columns = table(spark, folder, "orders").select(_node("customer_", "o_custkey").alias("table_name"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("column_name"))
    return graph.table_stats(columns)


QUERIES = {
    "join_path_lineitem_region": join_path_lineitem_region,
    "join_path_orders_supplier": join_path_orders_supplier,
    "join_path_rows": join_path_rows,
    "graph_degrees": lambda s, d: graph.degrees(one_space(s, d)),
    "graph_degrees_part_supplier": lambda s, d: graph.degrees(part_supplier(s, d)),
    "graph_roles": lambda s, d: graph.roles(event_chain(s, d), _customers(s, d)),
    "graph_hubs": lambda s, d: graph.hubs(one_space(s, d)),
    "graph_top5": lambda s, d: graph.top_nodes(one_space(s, d)),
    "graph_single_children": lambda s, d: graph.numbered_children(order_chain(s, d)),
    "graph_relation_counts": lambda s, d: graph.relation_counts(one_space(s, d)),
    "graph_hub_links": lambda s, d: graph.hub_links(one_space(s, d)),
    "graph_table_stats": table_stats,
    "graph_hops": lambda s, d: graph.hops(relation_rows(s, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")), "order_1"),
    "graph_hops_part_supplier": lambda s, d: graph.hops(part_supplier(s, d), "p1"),
    "graph_hops_chain": lambda s, d: graph.hops(document_line(s, d), "d0"),
    "graph_hops_ring": lambda s, d: graph.hops(document_ring(s, d), "d7"),
    "graph_clusters_chain": lambda s, d: graph.hub_clusters(document_line(s, d)),
    "graph_clusters": lambda s, d: graph.hub_clusters(order_chain(s, d), _customers(s, d)),
    "graph_clusters_part_supplier": lambda s, d: graph.hub_clusters(part_supplier(s, d)),
}


def _hops_sql(edges: str, start: str) -> str:
    """Rounds from the rows of the last one to what no round has reached, until one finds nothing."""
    return f"""
        WITH RECURSIVE e AS ({edges}),
        ways AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
        reached(node, hops) USING KEY (node) AS (
            SELECT '{start}', 0::BIGINT
            UNION
            SELECT dst, min(hops + 1) FROM reached JOIN ways ON node = src
            WHERE NOT EXISTS (SELECT 1 FROM recurring.reached r WHERE r.node = dst) GROUP BY dst)
        SELECT node, hops FROM reached"""


PART_SUPPLIER = "SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem"
ONE_SPACE = "SELECT concat('t', l_suppkey) AS src, concat('t', l_partkey) AS dst FROM lineitem"
ORDER_CHAIN = "SELECT concat('t', o_orderkey) AS src, concat('t', o_custkey) AS dst FROM orders"
EVENT_CHAIN = "SELECT concat('t', event_id) AS src, concat('t', user_id) AS dst FROM events"
DOCUMENT_LINE = """
    SELECT concat('d', doc_id) AS src, concat('d', doc_id + 1) AS dst FROM documents
    UNION ALL SELECT concat('e', event_id), concat('d', user_id) FROM events"""
DOCUMENT_RING = """
    SELECT concat('d', doc_id) AS src, concat('d', doc_id + 1) AS dst FROM documents
    UNION ALL SELECT concat('d', doc_id), 'd0' FROM documents WHERE doc_id % 100 = 0"""
RELATION_ROWS = """
    SELECT concat('order_', o_orderkey) AS src, concat('customer_', o_custkey) AS dst FROM orders
    UNION ALL SELECT concat('order_', l_orderkey), concat('supplier_', l_suppkey) FROM lineitem
    UNION ALL SELECT concat('customer_', c_custkey), concat('nation_', c_nationkey) FROM customer
    UNION ALL SELECT concat('supplier_', s_suppkey), concat('nation_', s_nationkey) FROM supplier
    UNION ALL SELECT concat('nation_', n_nationkey), concat('region_', n_regionkey) FROM nation"""
CUSTOMERS = "SELECT concat('t', c_custkey) AS node FROM customer"


def _degrees_sql(edges: str, nodes: str = "SELECT NULL AS node WHERE false") -> str:
    return f"""(
        WITH e AS (SELECT DISTINCT src, dst FROM ({edges})),
        o AS (SELECT src AS node, count(DISTINCT dst) AS n FROM e GROUP BY 1),
        i AS (SELECT dst AS node, count(DISTINCT src) AS n FROM e WHERE src <> dst GROUP BY 1)
        SELECT node, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree
        FROM (SELECT src AS node FROM e UNION SELECT dst FROM e UNION ({nodes}))
        LEFT JOIN o USING (node) LEFT JOIN i USING (node))"""


def _clusters_sql(edges: str, nodes: str = "SELECT NULL AS node WHERE false") -> str:
    """Rounds over the whole state: in each, an undecided main node without an undecided higher neighbour becomes
    a hub (h), its undecided neighbours members (m)."""
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges})),
        d AS MATERIALIZED (SELECT node, degree FROM {_degrees_sql(edges, nodes)}),
        ways AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
        up AS MATERIALIZED (
            SELECT w.src AS lo, w.dst AS hi, b.degree AS hi_degree
            FROM ways w JOIN d a ON a.node = w.src JOIN d b ON b.node = w.dst
            WHERE a.degree > 1 AND b.degree > 1 AND (a.degree, a.node) < (b.degree, b.node)),
        state(round, node, status) AS (
            SELECT 0, node, 'u' FROM d WHERE degree > 1
            UNION ALL
            (WITH hub AS (
                SELECT s.round, s.node FROM state s WHERE s.status = 'u' AND NOT EXISTS (
                    SELECT 1 FROM up JOIN state t ON t.node = up.hi WHERE up.lo = s.node AND t.status = 'u')),
             member AS (SELECT DISTINCT up.lo AS node FROM up JOIN hub ON hub.node = up.hi)
             SELECT s.round + 1, s.node,
                    CASE WHEN s.status <> 'u' THEN s.status WHEN hub.node IS NOT NULL THEN 'h' WHEN member.node IS NOT NULL THEN 'm' ELSE 'u' END
             FROM state s LEFT JOIN hub ON hub.node = s.node LEFT JOIN member ON member.node = s.node
             WHERE EXISTS (SELECT 1 FROM state WHERE status = 'u'))),
        final AS (SELECT node, status FROM state WHERE round = (SELECT max(round) FROM state)),
        main AS (
            SELECT node, 'hub' AS role, node AS hub FROM final WHERE status = 'h'
            UNION ALL
            SELECT f.node, 'member', arg_max(up.hi, (up.hi_degree, up.hi)) FROM final f JOIN up ON up.lo = f.node
            JOIN final h ON h.node = up.hi AND h.status = 'h' WHERE f.status = 'm' GROUP BY f.node),
        child AS (
            SELECT w.src AS child, any_value(w.dst) AS parent FROM ways w JOIN d ON d.node = w.src AND d.degree = 1 GROUP BY w.src),
        pair AS (
            SELECT e.src AS child, e.dst AS hub FROM e JOIN child c ON c.child = e.src AND c.parent = e.dst
            JOIN child k ON k.child = e.dst AND k.parent = e.src WHERE e.src <> e.dst),
        placed AS (
            SELECT node, role, hub AS parent, hub FROM main
            UNION ALL SELECT child, 'child', parent, hub FROM child JOIN main ON main.node = parent
            UNION ALL SELECT hub, 'hub', hub, hub FROM pair
            UNION ALL SELECT child, 'child', hub, hub FROM pair)
        SELECT * FROM placed
        UNION ALL SELECT node, 'orphan', node, node FROM d WHERE node NOT IN (SELECT node FROM placed)"""


SQL = {
    "join_path_lineitem_region": """
        SELECT r_name, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "join_path_orders_supplier": """
        SELECT s_name, count(*) AS n, max(o_orderkey) AS last_order FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "join_path_rows": """
        WITH first AS (
            SELECT concat('customer_', o_custkey) AS t1, o_custkey * 10 + 1 AS e1, c_nationkey AS nation, c_nationkey::BIGINT * 10 + 3 AS e2
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 153
            UNION
            SELECT concat('supplier_', l_suppkey), l_suppkey * 10 + 2, s_nationkey, s_nationkey::BIGINT * 10 + 4
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = 153),
        best AS (
            SELECT t1, e1, nation, e2 FROM first JOIN nation ON nation = n_nationkey WHERE n_regionkey = 4 ORDER BY e1, t1, e2 LIMIT 1)
        SELECT 1::BIGINT AS step, t1 AS table_name, e1 AS edge_ord FROM best
        UNION ALL SELECT 2, concat('nation_', nation), e2 FROM best
        UNION ALL SELECT 3, 'region_4', 45 FROM best""",
    "graph_degrees": f"SELECT * FROM {_degrees_sql(ONE_SPACE)}",
    "graph_degrees_part_supplier": f"SELECT * FROM {_degrees_sql(PART_SUPPLIER)}",
    "graph_roles": f"""
        WITH d AS {_degrees_sql(EVENT_CHAIN, CUSTOMERS)}
        SELECT node, degree, CASE degree WHEN 0 THEN 'orphan' WHEN 1 THEN 'single child' ELSE 'main' END AS role,
               row_number() OVER (ORDER BY degree DESC, node DESC) = 1 AS flag FROM d""",
    "graph_hubs": f"""
        SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node DESC) AS rank
        FROM {_degrees_sql(ONE_SPACE)} WHERE degree > 1""",
    "graph_top5": f"SELECT * FROM {_degrees_sql(ONE_SPACE)} ORDER BY degree DESC, node DESC LIMIT 5",
    "graph_single_children": f"""
        WITH e AS (SELECT DISTINCT src, dst FROM ({ORDER_CHAIN})),
        d AS {_degrees_sql(ORDER_CHAIN)},
        c AS (SELECT src AS child, dst AS parent FROM e UNION SELECT dst, src FROM e)
        SELECT child, parent, row_number() OVER (PARTITION BY parent ORDER BY child) AS position
        FROM c JOIN d ON node = child WHERE degree = 1 AND child <> parent""",
    "graph_relation_counts": f"""
        SELECT node, count(*) AS relations FROM (
            SELECT src AS node FROM ({ONE_SPACE}) UNION ALL SELECT dst FROM ({ONE_SPACE}) WHERE src <> dst) GROUP BY 1""",
    "graph_hub_links": f"""
        WITH e AS (SELECT DISTINCT src, dst FROM ({ONE_SPACE})),
        d AS {_degrees_sql(ONE_SPACE)},
        hub AS (SELECT node AS hub FROM d ORDER BY degree DESC, node DESC LIMIT 1),
        l AS (SELECT node, count(*) AS n FROM (
                SELECT src AS node FROM e, hub WHERE dst = hub UNION ALL SELECT dst FROM e, hub WHERE src = hub) GROUP BY 1),
        r AS (SELECT d.node, coalesce(n, 0) AS links, degree FROM d LEFT JOIN l USING (node), hub WHERE degree > 1 AND d.node <> hub)
        SELECT *, row_number() OVER (ORDER BY links DESC, degree DESC, node DESC) AS rank FROM r""",
    "graph_table_stats": """
        SELECT concat('customer_', o_custkey) AS table_name, count(*) AS columns,
               max(length(concat(o_orderpriority, o_orderkey))) AS longest_name FROM orders GROUP BY 1""",
    "graph_hops": _hops_sql(RELATION_ROWS, "order_1"),
    "graph_hops_part_supplier": _hops_sql(PART_SUPPLIER, "p1"),
    "graph_hops_chain": _hops_sql(DOCUMENT_LINE, "d0"),
    "graph_hops_ring": _hops_sql(DOCUMENT_RING, "d7"),
    "graph_clusters_chain": _clusters_sql(DOCUMENT_LINE),
    "graph_clusters": _clusters_sql(ORDER_CHAIN, CUSTOMERS),
    "graph_clusters_part_supplier": _clusters_sql(PART_SUPPLIER),
}
