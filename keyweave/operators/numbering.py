"""Running sums and dense row numbers without one sorting task.

A window over all rows, or over a hot group, puts them in one task. Here the rows are range partitioned by
(group, order), so a hot group is spread over many partitions; each partition adds up its own rows, and
the totals of the same group in earlier partitions are added to them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions.text import column
from keyweave.lineage import cut

COPIES_PER_TASK = 1_000  # that one placed row stands for; a row that occurs more often is placed several times


def running_sums(
    df: DataFrame, order_by: Sequence[Column], within: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Add, for each `new name: value column`, the sum of the values up to and with the row, in its group."""
    ranged = df.repartitionByRange(*[column(c) for c in within], *order_by)
    placed = cut(ranged.withColumn("_range", F.spark_partition_id()), "ranges")

    in_range = Window.partitionBy("_range", *[column(c) for c in within]).orderBy(*order_by)
    upto_here = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({name: F.sum(column(value)).over(upto_here) for name, value in sums.items()})

    totals = placed.groupBy("_range", *[column(c) for c in within]).agg(
        *[F.sum(column(value)).alias(f"_total_{name}") for name, value in sums.items()]
    )
    earlier = (
        Window.partitionBy(*([column(c) for c in within] or [F.lit(0)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only the first group of a range can have rows in an earlier range, so there is at most one carry per range.
    carry = totals.select(
        F.col("_range").alias("_carry_range"),
        *[column(c).alias(f"_carry_{i}") for i, c in enumerate(within)],
        *[F.sum(f"_total_{name}").over(earlier).alias(f"_before_{name}") for name in sums],
        F.count(F.lit(1)).over(earlier).alias("_ranges_before"),
    ).where("_ranges_before > 0")
    same = F.col("_range") == F.col("_carry_range")
    for i, c in enumerate(within):
        same = same & column(c).eqNullSafe(F.col(f"_carry_{i}"))
    joined = local.join(F.broadcast(carry), same, "left")
    zero = F.lit(0)
    return joined.select(
        *[column(c) for c in df.columns],
        *[(column(name) + F.coalesce(F.col(f"_before_{name}"), zero)).alias(name) for name in sums],
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "position",
    distinct_rows: bool = False,
) -> DataFrame:
    """Add `name`: 1, 2, ... in `order_by` order inside each `within` group.

    Equal order keys are ordered by a hash of the row. Exact copies are counted before the shuffle, placed by thousands and
    spread out at the end, so a row with very many copies never fills one partition; pass
    `distinct_rows=True` when there are none to save that step.
    """
    columns = df.columns
    one = F.lit(1).cast("bigint")
    tie = F.xxhash64(*[column(c) for c in columns])
    if distinct_rows:
        counted = df.withColumns({"_copies": one, "_before": F.lit(0).cast("bigint")})
    else:
        counted = df.groupBy(*[column(c) for c in columns]).agg(F.count(F.lit(1)).alias("_all"))
        step = F.lit(COPIES_PER_TASK).cast("bigint")
        starts = F.sequence(F.lit(0).cast("bigint"), F.col("_all") - 1, step)
        counted = counted.select(*[column(c) for c in columns], "_all", F.explode(starts).alias("_before"))
        counted = counted.withColumn("_copies", F.least(step, F.col("_all") - F.col("_before"))).drop("_all")
    summed = running_sums(counted, [*order_by, tie, F.col("_before")], within, {"_last": "_copies"})
    if distinct_rows:
        return summed.select(*[column(c) for c in columns], F.col("_last").alias(name))
    places = F.sequence(F.col("_last") - F.col("_copies") + 1, F.col("_last"))
    return summed.select(*[column(c) for c in columns], F.explode(places).alias(name))
