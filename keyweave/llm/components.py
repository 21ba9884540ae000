"""Connected components of a table of links, in a few rounds of alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed


def few(df: DataFrame) -> DataFrame:
    """Links are far fewer than the rows they come from, so an eighth of the shuffle's partitions holds them."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame) -> DataFrame:
    """Add to each (a, b) the least of a and all its b. Minima are combined in the map tasks; a hot `a` is one row of them."""
    least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return rows.join(least, "a")


def _large_star(links: DataFrame) -> DataFrame:
    found = _with_least(_both_ways(links))
    return found.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down)
    return found.select(F.col("b").alias("a"), F.col("least").alias("b")).union(found.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the least node of its component.

    Links of a node with itself and repeated links don't matter. Each half round is written to the shared folder; the
    rounds end when a whole one changes nothing, which is seen from figures taken while writing.
    """
    figures = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    tidy = lambda df: few(df.where("a <> b").distinct())
    now, seen = cut_observed(tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "stars", **figures)
    before = None
    while seen != before:
        before = seen
        large = cut(few(_large_star(now)), "stars")  # no more rows than the links that go in
        now, seen = cut_observed(tidy(_small_star(large)), "stars", **figures)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
