"""Near-duplicate vectors: groups by the links of a neighbour graph, and the number of links of each vector, exactly.

NN-descent (`neighbour_graph`) finds the links that hold groups together. How many links a vector has is then counted within
its group, without a row for each pair:

- A group of up to WHOLE nodes is one matrix product.
- A larger one is taken apart into balls. All that is within half the linking angle of a pivot is linked with each other, so a
  crowd of near copies costs one comparison each. What no ball takes stays in blocks.
- Two balls or blocks are compared only where their centres and radii leave open whether their vectors are linked.

Crowded nodes, whose longest list holds nothing but links, may have links outside the group that no list has room for. The pivots of
their groups are compared with all nodes, in blocks; a node near enough to reach a ball joins the ball's group for the count.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed
from keyweave.llm.columns import column
from keyweave.llm.components import components
from keyweave.llm.neighbour_graph import NearRule, against_all, descend, matrix, strong_pairs, unit_vectors

WHOLE = 512  # nodes of a group that are compared at once
CHUNK = 256  # nodes of a ball or block that are compared at once
PANEL = 2048  # pivots that are sent to the tasks at once
MARGIN = 1e-7  # of angles, for rounding
OPEN = -1  # the ball of nodes that are in none


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    return acos(min(1.0, max(-1.0, float(a @ b))))


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, ball, angle) of (grp, node, unit, pivot, pivot's unit)."""
    for batch in batches:
        if batch.num_rows:
            pairs = zip(batch.column(2), batch.column(4), strict=True)
            angles = [_angle(np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer())) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(angles)], ["grp", "node", "ball", "angle"])


def in_balls(members: DataFrame, rule: NearRule) -> DataFrame:
    """(grp, node, ball, angle) of the members (grp, node, unit): the pivot of the ball each is in, or OPEN.

    Each round gives every group one ball about one of its open nodes; a group's rounds end when one takes less than a
    quarter of what is open, so they are as many as a logarithm of its size at most.
    """
    half = acos(rule.cosine) / 2 - MARGIN
    done, left = [], cut(members.select("grp", "node", "unit"), "open-nodes")
    while not left.isEmpty():
        # The order is random, so a dense part of a group is likely to hold the pivot; minima combine in the map tasks.
        pivots = left.groupBy("grp").agg(F.min_by(F.struct("node", "unit"), F.xxhash64("node")).alias("p"), F.count(F.lit(1)).alias("n"))
        pivots = cut(pivots, "pivots")
        asked = left.join(pivots.select("grp", F.col("p.node").alias("ball"), F.col("p.unit").alias("pivot")), "grp")
        angles = asked.select("grp", "node", "unit", "ball", "pivot").mapInArrow(_angles, "grp bigint, node bigint, ball bigint, angle double")
        placed = cut(angles.withColumn("taken", F.col("angle") <= half), "angles")
        taken = placed.groupBy("grp").agg(F.count_if("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
        going = taken.where("4 * taken >= n AND taken < n").select("grp")
        rest = placed.where("NOT taken").select("grp", "node")
        done.append(placed.where("taken").select("grp", "node", "ball", "angle"))
        done.append(rest.join(going, "grp", "left_anti").select("grp", "node", F.lit(OPEN).cast("bigint").alias("ball"), F.lit(0.0).alias("angle")))
        left = cut(left.join(rest.join(going, "grp", "left_semi").select("node"), "node", "left_semi"), "open-nodes")
    out = members.select("grp", "node", F.lit(OPEN).cast("bigint").alias("ball"), F.lit(0.0).alias("angle")).limit(0)
    for part in done:
        out = out.union(part)
    return cut(out, "balls")


def reached(nodes: DataFrame, crowded: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs (a, b) of a pivot and any node that may be linked with a member of its ball.

    Pivots are the centres of the balls of crowded groups, and their nodes that are in no ball.
    """
    balls = in_balls(crowded, rule)
    pivots = balls.select(F.when(F.col("ball") == OPEN, F.col("node")).otherwise(F.col("ball")).alias("node"), "angle").groupBy("node").agg(F.max("angle").alias("angle"))
    pivots = pivots.join(nodes.select("node", "unit"), "node")
    pivots, seen = cut_observed(pivots, "pivots", n=F.count(F.lit(1)), reach=F.max("angle"))
    if not seen["n"]:
        return pivots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    least = float(np.cos(min(pi, acos(rule.cosine) + seen["reach"] + MARGIN)))

    def near(batch_nodes: np.ndarray, names: np.ndarray, close: np.ndarray) -> pa.RecordBatch:
        x, y = np.nonzero(close)
        return pa.RecordBatch.from_arrays([pa.array(names[y]), pa.array(batch_nodes[x])], ["a", "b"])

    out, panels = None, -(-seen["n"] // PANEL)
    for panel in range(panels):
        # A panel's expected size is PANEL; the hash deals evenly.
        asked = pivots.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(panels)) == panel).select("node", "unit").collect()
        found = cut(against_all(nodes, [tuple(r) for r in asked], least, "a bigint, b bigint", near), "reached")
        out = found if out is None else out.union(found)
    return out.where("a <> b")


def _placed(members: DataFrame, rule: NearRule) -> DataFrame:
    """(grp, node, w, unit, part, ball, chunk): the part of its group each member is in, and the chunk of the part."""
    sized = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = sized.where(F.col("size") > WHOLE).select("grp")
    balls = in_balls(members.join(large, "grp", "left_semi"), rule)
    named = members.join(balls.select("node", "ball"), "node", "left")
    counted = named.groupBy("grp", "ball").agg(F.count(F.lit(1)).alias("size"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / F.when(F.col("ball").isNull(), WHOLE).otherwise(CHUNK))).cast("int")
    deal = F.pmod(F.xxhash64("node", F.lit(11)), "chunks")
    joined = named.withColumnRenamed("grp", "g").withColumnRenamed("ball", "b")
    joined = joined.join(counted.withColumn("chunks", chunks), F.col("g").eqNullSafe(F.col("grp")) & F.col("b").eqNullSafe(F.col("ball")))
    is_ball = F.coalesce(F.col("b") != OPEN, F.lit(False))
    # A ball is one part of many chunks; of the open nodes, each chunk is a part of its own.
    part = F.when(is_ball, F.concat(F.lit("ball "), F.col("b").cast("string"))).otherwise(F.concat(F.lit("open "), deal.cast("string")))
    return cut(joined.select(F.col("g").alias("grp"), "node", "w", "unit", part.alias("part"), is_ball.alias("is_ball"), F.when(is_ball, deal).otherwise(0).alias("chunk")), "parts")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, part, chunk, is_ball, nodes, ws, units, centre, radius, w) of a chunk's rows."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            units = [np.frombuffer(m["unit"]) for m in row["m"]]  # of one length, for only such are linked
            centre = sum(units)
            norm = np.sqrt(centre @ centre)
            centre = centre / norm if norm > 1e-9 else units[0]
            radius = max(_angle(u, centre) for u in units)
            rows.append((row["grp"], row["part"], row["chunk"], row["is_ball"], [m["node"] for m in row["m"]], [m["w"] for m in row["m"]], b"".join(m["unit"] for m in row["m"]), centre.tobytes(), radius, sum(m["w"] for m in row["m"])))
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "part", "chunk", "is_ball", "nodes", "ws", "units", "centre", "radius", "w"])


_CHUNKS = "grp bigint, part string, chunk int, is_ball boolean, nodes array<bigint>, ws array<bigint>, units binary, centre binary, radius double, w bigint"


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a bipartite graph that hold its components together, one fewer than a component has nodes."""
    rows_left, columns_left, found = np.ones(len(linked), bool), np.ones(linked.shape[1], bool), []
    for start in range(len(linked)):
        if not rows_left[start]:
            continue
        rows_left[start], front = False, [start]
        while front:
            reached_columns = []
            for i in front:
                new = np.flatnonzero(linked[i] & columns_left)
                columns_left[new] = False
                found += [(i, int(j)) for j in new]
                reached_columns += new.tolist()
            front = []
            for j in reached_columns:
                new = np.flatnonzero(linked[:, j] & rows_left)
                rows_left[new] = False
                found += [(int(i), j) for i in new]
                front += new.tolist()
    return found


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): what to add to the count of a, and links that hold groups together, as (a, b, 0)."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b = row["a"], row["b"]
            x = np.frombuffer(a["units"]).reshape(len(a["nodes"]), -1)
            y = np.frombuffer(b["units"]).reshape(len(b["nodes"]), -1)
            linked = x @ y.T >= cosine
            same = a["nodes"] == b["nodes"]
            if same:
                np.fill_diagonal(linked, False)
            names, others = np.array(a["nodes"], np.int64), np.array(b["nodes"], np.int64)
            counts = [(names, linked @ np.array(b["ws"], np.int64))]
            if not same:
                counts.append((others, linked.T @ np.array(a["ws"], np.int64)))
            pairs = np.array(_spanning(linked), np.int64).reshape(-1, 2)
            left = np.concatenate([n for n, _ in counts] + [names[pairs[:, 0]]])
            right = np.concatenate([np.full(len(n), -1) for n, _ in counts] + [others[pairs[:, 1]]])
            n = np.concatenate([c for _, c in counts] + [np.zeros(len(pairs), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def _verdicts(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, all) for pairs of chunks of which all are linked, or some may be; none for those of which none can be."""
    limit = acos(cosine)
    for batch in batches:
        keep, whole = [], []
        for x, y, rx, ry in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            angle = _angle(np.frombuffer(x.as_buffer()), np.frombuffer(y.as_buffer()))
            keep.append(angle - rx - ry <= limit + MARGIN)
            whole.append(angle + rx + ry <= limit - MARGIN)
        found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.bool_())], ["a", "b", "all"])
        yield found.filter(pa.array(keep, pa.bool_()))


def count_links(members: DataFrame, rule: NearRule) -> tuple[DataFrame, DataFrame]:
    """(node, n) and links (a, b) that hold groups together, of members (grp, node, w, unit); w counts a node's vectors.

    n adds up the w of all other nodes of the group that are linked with the node.
    """
    placed, cosine = _placed(members, rule), rule.cosine
    lists = placed.groupBy("grp", "part", "is_ball", "chunk").agg(F.collect_list(F.struct("node", "w", "unit")).alias("m"))  # about CHUNK, WHOLE at most
    chunks = lists.select("grp", "part", "chunk", "is_ball", "m").mapInArrow(_summaries, _CHUNKS)
    chunks = cut(chunks.withColumn("id", F.concat_ws("/", "grp", "part", "chunk")), "chunks")
    # Within a ball all are linked.
    of_ball = chunks.where("is_ball").groupBy("grp", "part").agg(F.sum("w").alias("total"))
    in_ball = placed.where("is_ball").join(of_ball, ["grp", "part"])
    counts = in_ball.select(F.col("node").alias("a"), (F.col("total") - F.col("w")).alias("n"))
    links = in_ball.select(F.col("node").alias("a"), F.substring_index("part", " ", -1).cast("bigint").alias("b"))
    brief = chunks.select("grp", "part", "is_ball", "id", "centre", "radius")
    several = brief.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    brief = brief.join(several, "grp", "left_semi")
    left, right = (brief.select("grp", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "id", "centre", "radius")]) for s in "xy")
    met = left.join(right, "grp").where("id_x < id_y AND part_x <> part_y").select("id_x", "id_y", "centre_x", "centre_y", "radius_x", "radius_y")
    verdicts = cut(met.mapInArrow(lambda b: _verdicts(b, cosine), "a string, b string, all boolean"), "verdicts")
    own = chunks.where("NOT is_ball").select(F.col("id").alias("a"), F.col("id").alias("b"))
    unsure = verdicts.where("NOT all").select("a", "b").union(own)
    packed = F.struct("nodes", "ws", "units")
    brought = unsure.join(chunks.select(F.col("id").alias("a"), packed.alias("x")), "a").join(chunks.select(F.col("id").alias("b"), packed.alias("y")), "b")
    compared = cut(brought.select(F.col("x").alias("a"), F.col("y").alias("b")).mapInArrow(lambda b: _compare(b, cosine), "a bigint, b bigint, n bigint"), "compared")
    # Where all of two chunks are linked, weights are added, and one link for each member holds them together.
    first = chunks.select("id", "w", F.element_at("nodes", 1).alias("head"))
    both = verdicts.where("all").select("a", "b").union(verdicts.where("all").select(F.col("b").alias("a"), F.col("a").alias("b")))
    sums = both.join(first.select(F.col("id").alias("b"), "w", "head"), "b").groupBy("a").agg(F.sum("w").alias("n"), F.min("head").alias("head"))
    spread = chunks.select(F.col("id").alias("a"), F.explode("nodes").alias("node")).join(sums, "a")
    heads = both.join(first.select(F.col("id").alias("a"), F.col("head").alias("head_a")), "a").join(first.select(F.col("id").alias("b"), F.col("head").alias("head_b")), "b")
    counts = counts.union(compared.where("b < 0").select("a", "n")).union(spread.select(F.col("node").alias("a"), "n"))
    links = links.union(compared.where("b >= 0").select("a", "b")).union(spread.select(F.col("node").alias("a"), F.col("head").alias("b")))
    links = links.union(heads.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    return counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), links.where("a <> b")


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", rule: NearRule = NearRule()) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: the number of other rows that are linked, the smallest id links lead to
    (its own included), and whether that is its own.

    Null vectors, those of length zero or without components, and those that hold null or infinite components or NaN link
    with nothing; vectors only link with others of as many components. Rows with equal vectors are linked; repeated rows
    are rows of their own. A null id is never the smallest; it is kept if it leads to no other. No other column is read.
    """
    rows = df.select(column(id).alias("id"), column(vector).cast("array<double>").alias("vector"))
    id_type = rows.schema["id"].dataType.simpleString()
    members = cut(rows.mapInArrow(unit_vectors, f"id {id_type}, unit binary"), "units")
    nodes = members.where("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("least"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    lists = descend(nodes, rule)
    links = cut(strong_pairs(lists, nodes, rule), "near-links")
    grouped = cut(components(links), "near-groups")
    crowded_groups = lists.where("crowded").select("node").join(grouped, "node").select(F.col("root").alias("grp")).distinct()
    of_group = grouped.select("node", F.col("root").alias("grp")).join(nodes.select("node", "unit", "w"), "node")
    crowded = of_group.join(crowded_groups, "grp", "left_semi")
    if not crowded_groups.isEmpty():
        near = links.union(reached(nodes, crowded, rule))
        groups = cut(components(near), "counted-groups")
        of_group = groups.select("node", F.col("root").alias("grp")).join(nodes.select("node", "unit", "w"), "node")
    counts, holding = count_links(cut(of_group.select("grp", "node", "w", "unit"), "group-members"), rule)
    final = components(links.union(holding))
    least = final.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    component = final.join(least, "root").select("node", "component")
    found = nodes.join(counts, "node", "left").join(component, "node", "left")
    found = cut(found.select("unit", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "vector-results")
    joined = members.join(found, "unit", "left")
    component_id = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("id")).alias("kept")
    )
