"""Boxes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.operators import boxes
from keyweave.workload.tables import table


def order_boxes(spark, folder):
    """A box per order: customer against price, as wide as its status letter and as high as its priority."""
    price = F.floor(F.col("o_totalprice") / 100).cast("double")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), price.alias("y"),
        (F.ascii("o_orderstatus") - 69).cast("double").alias("width"),
        (F.ascii("o_orderpriority") - 48).cast("double").alias("height"),
    )


ORDER_BOXES = """SELECT o_orderkey AS id, o_custkey::DOUBLE AS x, floor(o_totalprice / 100) AS y,
    (ascii(o_orderstatus) - 69)::DOUBLE AS width, (ascii(o_orderpriority) - 48)::DOUBLE AS height FROM orders"""


def part_boxes(spark, folder):
    price = F.round(F.col("p_retailprice")).cast("double")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), price.alias("x"), F.col("p_size").cast("double").alias("y"),
        F.length("p_name").cast("double").alias("width"), F.length("p_brand").cast("double").alias("height"),
    )


PART_BOXES = """SELECT p_partkey AS id, round(p_retailprice) AS x, p_size::DOUBLE AS y, length(p_name)::DOUBLE AS width,
    length(p_brand)::DOUBLE AS height FROM part"""


def edge_length_total(spark, folder):
    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    lengths = boxes.edge_lengths(edges, part_boxes(spark, folder))
    return lengths.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length"), 2).alias("total_length"))


QUERIES = {
    "box_select": lambda s, d: boxes.select_boxes(order_boxes(s, d), 20, 1000, 60, 900).select("id"),
    "box_center_count": lambda s, d: boxes.count_centers(order_boxes(s, d), 300, 1500),
    "box_overlaps": lambda s, d: boxes.overlap_counts(order_boxes(s, d)),
    "box_overlap_pairs": lambda s, d: boxes.count_overlaps(order_boxes(s, d)),
    "box_overlap_area": lambda s, d: boxes.overlap_areas(part_boxes(s, d), margin=3),
    "edge_length_total": edge_length_total,
}

MEET = "a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height"

SQL = {
    "box_select": f"""
        SELECT id FROM ({ORDER_BOXES})
        WHERE x < 80 AND x + width >= 20 AND NOT (x < 20 AND x + width = 80)
          AND y < 1900 AND y + height >= 1000 AND NOT (y < 1000 AND y + height = 1900)""",
    "box_center_count": f"""
        SELECT count(*) AS boxes FROM ({ORDER_BOXES})
        WHERE x + floor(width / 2) BETWEEN 0 AND 600 AND y + floor(height / 2) BETWEEN 1200 AND 1800""",
    "box_overlaps": f"""
        WITH b AS ({ORDER_BOXES}), met AS (SELECT a.id, count(*) AS n FROM b a JOIN b ON {MEET} AND a.id <> b.id GROUP BY 1)
        SELECT id, coalesce(n, 0) AS overlaps FROM b LEFT JOIN met USING (id)""",
    "box_overlap_pairs": f"WITH b AS ({ORDER_BOXES}) SELECT count(*) AS pairs FROM b a JOIN b ON {MEET} AND a.id < b.id",
    "box_overlap_area": f"""
        WITH b AS (SELECT id, x, y, width + 3 AS width, height + 3 AS height FROM ({PART_BOXES})),
        met AS (
            SELECT a.id, sum((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))) AS covered
            FROM b a JOIN b ON {MEET} AND a.id <> b.id GROUP BY 1)
        SELECT id, coalesce(covered, 0)::DOUBLE AS area FROM b LEFT JOIN met USING (id)""",
    "edge_length_total": f"""
        WITH b AS (SELECT id, x + floor(width / 2) AS cx, y + floor(height / 2) AS cy FROM ({PART_BOXES})),
        p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem)
        SELECT count(*) AS edges, round(sum(sqrt((f.cx - t.cx) ** 2 + (f.cy - t.cy) ** 2)), 2) AS total_length
        FROM p JOIN b f ON f.id = p.a JOIN b t ON t.id = p.b""",
}
