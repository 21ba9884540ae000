"""Boxes in the plane: (id, x, y, width, height).

Overlaps are counted and measured without forming pairs. Whether two boxes overlap, and by what area, is a
signed sum over their corners, so each box needs only sums over the corners below and left of its own
corners; these come from two rounds of sorting (`corner_sums`), in n rows however many boxes lie on one spot.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.lineage import cut

# The functions that run in tasks go there with the job, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Slabs and chunks of `corner_sums` hold about 2^CHUNK_BITS rows; fewer corners are dealt to up to FEW_PARTS tasks.
CHUNK_BITS = 20
FEW_PARTS, FEW_BITS = 64, 16


def _right() -> Column:
    return F.col("x") + F.col("width")


def _top() -> Column:
    return F.col("y") + F.col("height")


def center_x() -> Column:
    return F.col("x") + F.floor(F.col("width") / 2)


def center_y() -> Column:
    return F.col("y") + F.floor(F.col("height") / 2)


def select_boxes(boxes: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Boxes that meet a rectangle: on both axes they begin before its far edge and end at or after its near one.

    A box that begins before the near edge and ends exactly at the far one doesn't count.
    """

    def meets(low: Column, high: Column, start: float, end: float) -> Column:
        return (low < end) & (high >= start) & ~((low < start) & (high == end))

    return boxes.where(meets(F.col("x"), _right(), x, x + width) & meets(F.col("y"), _top(), y, y + height))


def count_centers(boxes: DataFrame, x: float, y: float, reach: float = 300) -> DataFrame:
    """One row: boxes whose centre is at most `reach` from (x, y) on both axes."""
    inside = center_x().between(x - reach, x + reach) & center_y().between(y - reach, y + reach)
    return boxes.agg(F.count_if(inside).alias("boxes"))


def edge_lengths(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(a, b, length): distance between the centres of each distinct connected pair of boxes."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    centers = boxes.select("id", center_x().alias("cx"), center_y().alias("cy"))
    ends = pairs.join(centers.toDF("a", "ax", "ay"), "a").join(centers.toDF("b", "bx", "by"), "b")
    return ends.select("a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("length"))


def overlap_counts(boxes: DataFrame) -> DataFrame:
    """(id, overlaps): other boxes whose open rectangle meets that of the box. A box without area meets none."""
    numbered = _numbered(boxes)
    solid = _solid(numbered)
    # On one axis two boxes meet iff low < other high, less the pairs with high <= other low. The product over both axes has
    # four terms: upper right corners over lower left ones and the other way round, and the same of the other diagonal, with
    # a minus. On a diagonal the corners of one end count those of the other that are before them. High ends come first at
    # equal coordinates, for they do not meet low ones.
    ends = [(x, y) for x in (False, True) for y in (False, True)]
    corners = [
        _corner(int(x != y), (F.col("right" if x else "left"), F.col("top" if y else "bottom")), (int(not x), int(not y)), [("low", F.lit(int(not x)).cast("bigint")), ("high", F.lit(int(x)).cast("bigint"))])
        for x, y in ends
    ]
    sums = corner_sums(solid.select(F.col("_box").alias("id"), F.inline(F.array(*corners))), 4 * solid.count(), ["low", "high"])
    others = F.when(F.col("low") == 1, F.col("sum_high")).otherwise(F.col("sum_low"))
    per_box = sums.groupBy("id").agg(F.sum(F.when(F.col("kind") == 0, others).otherwise(-others)).alias("_met"))
    counted = per_box.select(F.col("id").alias("_box"), (F.col("_met") - 1).cast("bigint").alias("overlaps"))
    zero = F.lit(0).cast("bigint")
    return numbered.select("id", "_box").join(counted, "_box", "left").select("id", F.coalesce("overlaps", zero).alias("overlaps"))


def count_overlaps(boxes: DataFrame) -> DataFrame:
    """One row: number of unordered pairs of boxes that overlap."""
    return overlap_counts(boxes).agg((F.coalesce(F.sum("overlaps"), F.lit(0)) / 2).cast("bigint").alias("pairs"))


def overlap_areas(boxes: DataFrame, margin: float = 0) -> DataFrame:
    """(id, area): total area that the other boxes cover of the box, each grown right and up by `margin`.

    Areas are differences of double sums, so they are exact for whole numbers below 2^53 and rounded like those sums else.
    """
    grown = boxes.withColumn("width", F.col("width") + margin).withColumn("height", F.col("height") + margin)
    numbered = _numbered(grown)
    solid = _solid(numbered)
    left, right, bottom, top = F.col("left"), F.col("right"), F.col("bottom"), F.col("top")
    signed = [(1, left, bottom), (-1, right, bottom), (-1, left, top), (1, right, top)]

    # The part of a box below and left of (X, Y) has the area: signed sum over its corners (x, y) with
    # x <= X and y <= Y of (X - x)(Y - y). Four sums over corners give it for all boxes at once.
    # Corners with x = X or y = Y add nothing, so their order is free.
    def weights(sign: int, x: Column, y: Column) -> list[tuple[str, Column]]:
        values = [("s", F.lit(sign)), ("sx", F.lit(sign) * x), ("sy", F.lit(sign) * y), ("sxy", F.lit(sign) * x * y)]
        return [(name, value.cast("double")) for name, value in values]

    corners = [_corner(0, (x, y), (0, 0), [*weights(s, x, y), ("at_x", x), ("at_y", y)]) for s, x, y in signed]
    sums = corner_sums(solid.select(F.col("_box").alias("id"), F.inline(F.array(*corners))), 4 * solid.count(), ["s", "sx", "sy", "sxy"])
    part = (
        F.col("at_x") * F.col("at_y") * F.col("sum_s")
        - F.col("at_x") * F.col("sum_sy")
        - F.col("at_y") * F.col("sum_sx")
        + F.col("sum_sxy")
    )
    per_box = sums.groupBy("id").agg(F.sum(part * F.col("s")).alias("_covered"))
    own = solid.select(F.col("_box").alias("id"), ((F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))).alias("_own"))
    covered = per_box.join(own, "id").select(F.col("id").alias("_box"), (F.col("_covered") - F.col("_own")).alias("area"))
    return numbered.select("id", "_box").join(covered, "_box", "left").select("id", F.coalesce("area", F.lit(0.0)).alias("area"))


def _numbered(boxes: DataFrame) -> DataFrame:
    """Boxes with a number of their own, for ids may repeat. Written, so that the numbers stay."""
    return cut(boxes.select("id", "x", "y", "width", "height").withColumn("_box", F.monotonically_increasing_id()), "boxes")


def _solid(boxes: DataFrame) -> DataFrame:
    edges = boxes.select(
        "_box",
        F.col("x").cast("double").alias("left"),
        F.col("y").cast("double").alias("bottom"),
        _right().cast("double").alias("right"),
        _top().cast("double").alias("top"),
    )
    return edges.where("left < right AND bottom < top")


def _corner(kind: int, at: tuple[Column, Column], turns: tuple[int, int], weights: Sequence[tuple[str, Column]]) -> Column:
    """A corner with its weights. At equal coordinates the turn decides who comes first."""
    return F.struct(
        F.lit(kind).alias("kind"),
        at[0].alias("cx"),
        at[1].alias("cy"),
        F.lit(turns[0]).alias("x_turn"),
        F.lit(turns[1]).alias("y_turn"),
        *[value.alias(name) for name, value in weights],
    )


def corner_sums(corners: DataFrame, rows: int, weights: Sequence[str]) -> DataFrame:
    """Parts of the sums of the weights over the corners before each corner on both axes, among the `rows` corners.

    `corners` has id, kind, cx, x_turn, cy, y_turn and the weights; only corners of one kind count for each other. At equal
    coordinates the lower turn is first; those of equal turns may come in any order.

    The corners are cut into slabs by x and into chunks by y, of about 2^CHUNK_BITS rows. What is before a corner on both axes
    is in its slab, or in its chunk and an earlier slab, or in an earlier chunk and an earlier slab. The first two are found within
    one task each, the last from the totals of slabs and chunks. So a corner is shuffled twice, however many there are. The
    result has the columns of `corners` without the coordinates, and the sums `sum_<weight>`; slabs and chunks are cut by
    (coordinate, turn, id), so even corners on one spot are spread.
    """
    parts = max((rows >> CHUNK_BITS) + 1, min(FEW_PARTS, rows >> FEW_BITS))
    own = {w: f"sum_{w}" for w in weights}
    kept = [c for c in corners.columns if c not in ("cx", "x_turn", "cy", "y_turn")]
    by_x = corners.repartitionByRange(parts, "kind", "cx", "x_turn", "id").withColumn("_slab", F.spark_partition_id())
    empty = by_x.withColumns({s: F.lit(0).cast(corners.schema[w].dataType) for w, s in own.items()})
    in_slab = cut(empty.mapInArrow(_adding(_slab_sums, weights), empty.schema).drop("cx", "x_turn"), "slabs")
    by_y = in_slab.repartitionByRange(parts, "kind", "cy", "y_turn", "id").withColumn("_chunk", F.spark_partition_id())
    in_chunk = by_y.mapInArrow(_adding(_chunk_sums, weights), by_y.schema)
    both = cut(in_chunk.select(*kept, "_slab", "_chunk", *own.values()), "chunks")

    place = ["kind", "_slab", "_chunk"]
    totals = both.groupBy(*place).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    numbers = [both.select(c).distinct() for c in place]
    cells = numbers[0].crossJoin(numbers[1]).crossJoin(numbers[2]).join(totals, place, "left")
    earlier = lambda of, by: Window.partitionBy("kind", of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    left = cells.select(*place, *[F.coalesce(F.sum(f"_t_{w}").over(earlier("_chunk", "_slab")), F.lit(0)).alias(f"_l_{w}") for w in weights])
    before = left.select(*place, *[F.coalesce(F.sum(f"_l_{w}").over(earlier("_slab", "_chunk")), F.lit(0)).alias(f"_b_{w}") for w in weights])
    joined = both.join(cut(before, "cells"), place)
    return joined.select(*kept, *[(F.col(s) + F.col(f"_b_{w}")).alias(s) for w, s in own.items()])


def _adding(kernel: Callable, weights: Sequence[str]) -> Callable:
    """A function over the batches of a partition that adds what `kernel` finds to the sums, kind by kind."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        part = pa.Table.from_batches(read)
        columns = {name: part.column(name).to_numpy() for name in part.column_names}
        sums = {f"sum_{w}": columns[f"sum_{w}"].copy() for w in weights}
        for kind in np.unique(columns["kind"]):
            here = np.flatnonzero(columns["kind"] == kind)
            found = kernel({name: values[here] for name, values in columns.items()}, [columns[w][here] for w in weights])
            for total, more in zip(sums.values(), found):
                total[here] += more
        out = pa.table([pa.array(sums[n]) if n in sums else part.column(n) for n in part.column_names], names=part.column_names)
        yield from out.to_batches(max_chunksize=100_000)

    return over


def _slab_sums(c: dict[str, np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    return sums_before(np.lexsort((c["id"], c["x_turn"], c["cx"])), np.lexsort((c["id"], c["y_turn"], c["cy"])), weights)


def _chunk_sums(c: dict[str, np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    """Those of the same slab count in the slab, so within one slab the later ones by y come first here."""
    by_y = np.lexsort((c["id"], c["y_turn"], c["cy"]))
    back = by_y[::-1]
    return sums_before(back[np.argsort(c["_slab"][back], kind="stable")], by_y, weights)


def sums_before(by_x: np.ndarray, by_y: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each row, the sums of the weights of the rows before it in both orders, in n log n steps.

    The rows stand by y and are dealt by the bits of their places by x, highest first: rows that agree above a bit are one
    run of known length, in it those with the bit set add up those without it that are ahead of them.
    """
    n = len(by_x)
    rank = np.empty(n, np.int64)
    rank[by_x] = np.arange(n)
    rows, at = by_y.copy(), np.arange(n)
    rank = rank[rows]
    sums = [np.zeros(n, w.dtype) for w in weights]
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        set_, start = (rank >> bit) & 1 == 1, rank >> (bit + 1) << (bit + 1)
        clear = np.concatenate(([0], np.cumsum(~set_)))
        zeros = clear[:-1] - clear[start]
        ones = rows[set_]
        for total, w in zip(sums, weights):
            running = np.concatenate((np.zeros(1, w.dtype), np.cumsum(np.where(set_, 0, w[rows]), dtype=w.dtype)))
            total[ones] += (running[:-1] - running[start])[set_]
        to = np.where(set_, start + (1 << bit) + (at - start - zeros), start + zeros)
        next_rows, next_rank = np.empty_like(rows), np.empty_like(rank)
        next_rows[to], next_rank[to] = rows, rank
        rows, rank = next_rows, next_rank
    return sums
