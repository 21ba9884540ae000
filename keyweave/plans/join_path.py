"""Find the shortest foreign-key path between two tables and run the inner joins along it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import column
from keyweave.lineage import cut
from keyweave.operators.graph import Levels, OpenEdges
from keyweave.operators.keys import by_table_id

EDGE_COLUMNS = ["edge_ord", "child", "child_columns", "parent", "parent_columns"]


def relations_as_edges(fk: DataFrame) -> DataFrame:
    """One edge per relation: (edge_ord, child, child_columns, parent, parent_columns).

    Input is (edge_ord, child, child_column, parent, parent_column[, constraint_name][, child_schema, parent_schema]). With a
    constraint name all its parts form one edge, in edge_ord order; without one each row is its own edge. With schemas,
    tables are named by `table_id`.
    """
    fk = by_table_id(fk)
    if "constraint_name" not in fk.columns:
        return fk.select(
            "edge_ord",
            "child",
            F.array("child_column").alias("child_columns"),
            "parent",
            F.array("parent_column").alias("parent_columns"),
        )
    relation = F.coalesce("constraint_name", F.concat(F.lit("edge "), F.col("edge_ord").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("edge_ord", "child_column", "parent_column")))
    grouped = fk.groupBy("child", "parent", relation.alias("_relation")).agg(parts.alias("_parts"))
    return grouped.select(
        F.col("_parts")[0]["edge_ord"].alias("edge_ord"),
        "child",
        F.col("_parts.child_column").alias("child_columns"),
        "parent",
        F.col("_parts.parent_column").alias("parent_columns"),
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_ord) both ways, self edges left out."""
    ends = edges.where("child <> parent")
    down = ends.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "edge_ord")
    return down.unionByName(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_ord"))


def shortest_path(ways: DataFrame, start: str, end: str) -> DataFrame:
    """(node, path) of `end`: the edges and tables of the shortest path; no row when there is none.

    Among paths of equal length the one with the smallest edge_ord list wins: it is the one a queue meets
    first when it takes the edges of a table in edge_ord order.

    The search goes from `end` back to `start`, so each node it reaches needs one pointer, to the next node on the best way
    to `end`; rows of all levels have the same width. The path is read from `start` on, one row of each level.
    """
    spark = ways.sparkSession
    levels = Levels(spark, "path")
    nothing = [F.lit(None).cast("bigint").alias("edge_ord"), F.lit(None).cast("string").alias("next")]
    arrived = F.count_if(F.col("node") == F.lit(start))
    seen = levels.add(spark.range(1).select(F.lit(end).alias("node"), *nothing), arrived=arrived)
    still = OpenEdges(ways.select("src", "dst", F.col("edge_ord").cast("bigint").alias("edge_ord"))) if not seen["arrived"] else None
    while seen["rows"] and not seen["arrived"]:
        last = levels.level(levels.depth - 1).select(F.col("node").alias("src"))
        # An edge has both directions, so `dst` refers to `src` as well.
        steps = still.edges.join(last, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("edge_ord", "src")).alias("step"))
        # A neighbour of a level lies in the level before it, in itself or in the next one.
        known = levels.level(levels.depth - 1).select("node")
        if levels.depth > 1:
            known = known.union(levels.level(levels.depth - 2).select("node"))
        fresh = steps.join(known, "node", "left_anti").select("node", "step.edge_ord", F.col("step.src").alias("next"))
        seen = levels.add(fresh, arrived=arrived)
        if seen["rows"] and not seen["arrived"]:
            still.settle(seen["rows"], levels.all())
    path, node = [], start
    for k in range(levels.depth - 1, 0, -1) if seen["arrived"] else ():
        row = levels.level(k).where(F.col("node") == F.lit(node)).first()  # one row for each table on the path
        path.append((row["edge_ord"], row["next"]))
        node = row["next"]
    rows = [(end, path)] if seen["arrived"] else []
    return spark.createDataFrame(rows, "node string, path array<struct<edge_ord:bigint,table:string>>")


def join_path_plan(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, table_name, previous_columns, this_columns) along the shortest path; step 0 is `start`.

    No rows when `end` cannot be reached; one row when it is `start`. There is one row per table on the path.
    """
    edges = cut(edges.select(*EDGE_COLUMNS), "edges")
    path = shortest_path(both_directions(edges), start, end)
    first = path.select(
        F.lit(0).cast("bigint").alias("step"),
        F.lit(start).alias("table_name"),
        F.lit(None).cast("array<string>").alias("previous_columns"),
        F.lit(None).cast("array<string>").alias("this_columns"),
    )
    walked = path.select(F.posexplode("path").alias("_pos", "_step")).select(
        (F.col("_pos") + 1).cast("bigint").alias("step"),
        F.col("_step.table").alias("table_name"),
        F.col("_step.edge_ord").alias("edge_ord"),
    )
    up = F.col("table_name") == F.col("parent")
    joined = edges.join(walked, "edge_ord").select(
        "step",
        "table_name",
        F.when(up, F.col("child_columns")).otherwise(F.col("parent_columns")).alias("previous_columns"),
        F.when(up, F.col("parent_columns")).otherwise(F.col("child_columns")).alias("this_columns"),
    )
    return first.unionByName(joined)


def join_path(tables: Mapping[str, DataFrame], fk: DataFrame, start: str, end: str) -> DataFrame:
    """Inner joins along the shortest path from `start` to `end`.

    Columns are named `t0__col`, `t1__col`, ... in path order. The rows of the path are read by the driver to
    build the plan: one per table. Join order and strategy are left to the optimizer. With no path, the
    result is `start` without rows. If the relations have schemas, `tables`, `start` and `end` go by `table_id`: `schema.table`.
    """
    steps = sorted(join_path_plan(relations_as_edges(fk), start, end).collect(), key=lambda row: row.step)
    if not steps:
        return _prefixed(tables[start], 0).where(F.lit(False))
    joined = _prefixed(tables[start], 0)
    for i, step in enumerate(steps[1:], start=1):
        pairs = zip(step.previous_columns, step.this_columns)
        on = [column(f"t{i - 1}__{before}") == column(f"t{i}__{here}") for before, here in pairs]
        joined = joined.join(_prefixed(tables[step.table_name], i), on)
    return joined


def _prefixed(df: DataFrame, i: int) -> DataFrame:
    return df.select(*[column(c).alias(f"t{i}__{c}") for c in df.columns])
