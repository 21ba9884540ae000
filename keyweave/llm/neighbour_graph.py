"""Pairs of near vectors by NN-descent: a graph of neighbour lists, refined by joins of neighbours with neighbours' neighbours.

1. Equal unit vectors are one node.
2. First lists: nodes are sorted by the signs of random projections, once for each of several tables, and compared within
   leaves of the order. Leaves are cut by number, so a crowd of near vectors fills as many as it needs.
3. Rounds: the vectors of a node's list, and of the nodes that list it, are brought together and compared with each other, if one
   of a pair is new there; what beats the worst entry of a list enters it. Of a node that very many list, blocks dealt
   anew in each round are compared.
4. A list all of whose entries are links is saturated: it may be too short, so it gets twice the length, up to a bound. Rounds
   end when no list is enlarged and no list that isn't saturated gains a link.
5. Audit: a sample of bounded size is compared with all nodes; while too few of its links are in its lists, more tables and
   rounds follow.

Nodes that saturate even the longest lists are crowded; `vector_groups` has the exact way for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed

_LISTS = "node bigint, others array<bigint>, sims array<float>"
_ROWS = 200_000  # candidates that a task merges at a time


@dataclass(frozen=True)
class NearRule:
    #: Vectors with at least this cosine are linked.
    cosine: float = 0.9
    #: Cosines are first taken of halved precision; what comes so near to the threshold is computed again in double precision.
    slack: float = 0.005
    neighbours: int = 12
    most_neighbours: int = 48
    tables: int = 8
    leaf: int = 64
    #: Rows that are compared as one block.
    block: int = 64
    audited: int = 1024
    recall: float = 0.98


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit) of (id, vector): the vector in double precision with length 1; null if it has none or isn't finite."""
    for batch in batches:
        units = []
        for vector in batch.column(1):
            values = vector.values
            if values is None or not len(values) or values.null_count:
                units.append(None)
                continue
            found = values.to_numpy(zero_copy_only=False).astype(np.float64)
            largest = np.abs(found).max()
            if not np.isfinite(largest) or not largest:
                units.append(None)
                continue
            found = found / largest  # neither overflows nor vanishes when squared
            units.append((found / np.sqrt(found @ found)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], ["id", "unit"])


def matrix(vectors: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal length, from their bytes."""
    buffers = [v.as_buffer() for v in vectors]
    return np.frombuffer(b"".join(buffers), kind).reshape(len(buffers), -1)


def halved(nodes: DataFrame) -> DataFrame:
    """(node, dim, vec) with half-precision vectors, for all comparisons but the last."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.float64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(v) for v in found], pa.int32()), pa.array([v.astype(np.float16).tobytes() for v in found], pa.binary())],
                ["node", "dim", "vec"],
            )

    return nodes.select("node", "unit").mapInArrow(halve, "node bigint, dim int, vec binary")


def _rank_in_runs(keys: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal keys."""
    if not len(keys):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def best_of(node: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the `most` best others, each once."""
    order = np.lexsort((-sim, other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1]))) if len(node) else np.empty(0, bool)
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    best = _rank_in_runs(node) < most
    return node[best], other[best], sim[best]


def _as_lists(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)
    offsets = pa.array(np.append(first, len(node)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (other, sim.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(node[first]), *lists], ["node", "others", "sims"])


def _collected(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Candidates (node, other, sim) as lists, merged in the task as far as its memory is bounded."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= _ROWS:
            yield _as_lists(*best_of(*(np.concatenate(x) for x in zip(*held, strict=True)), most))
            held, n = [], 0
    if held:
        yield _as_lists(*best_of(*(np.concatenate(x) for x in zip(*held, strict=True)), most))


def _signs(vectors: np.ndarray, table: int) -> np.ndarray:
    """64 signs of random projections of each row, as 8 bytes."""
    planes = np.random.RandomState(table).standard_normal((vectors.shape[1], 64)).astype(np.float32)
    return np.packbits(vectors.astype(np.float32) @ planes > 0, axis=1)


def first_lists(vectors: DataFrame, rule: NearRule, tables: range, partitions: int) -> DataFrame:
    """Lists (node, others, sims) from the leaves of the given tables."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                found = matrix(part.column(2), np.float16)
                for table in tables:
                    codes = pa.array([c.tobytes() for c in _signs(found, table)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), table, np.int32)), part.column(1), codes, part.column(0), part.column(2)], ["table", "dim", "code", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leaves() -> Iterator[pa.RecordBatch]:
            left = None
            for batch in batches:
                batch = batch if left is None else pa.concat_batches([left, batch])
                key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
                start = 0
                for end in ends:
                    while end - start > 2 * rule.leaf or (end < len(key) and start < end):
                        size = min(rule.leaf, end - start)
                        yield batch.slice(start, size)
                        start += size
                left = batch.slice(start)
            if left is not None and left.num_rows:
                yield left

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for leaf in leaves():
                nodes, found = leaf.column(3).to_numpy(), matrix(leaf.column(4), np.float16).astype(np.float32)
                sims = found @ found.T
                np.fill_diagonal(sims, -2)
                k = min(rule.neighbours, len(nodes) - 1)
                if k < 1:
                    continue
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield np.repeat(nodes, k), nodes[best].ravel(), np.take_along_axis(sims, best, 1).ravel()

        yield from _collected(pairs(), rule.neighbours)

    placed = vectors.mapInArrow(place, "table int, dim int, code binary, node bigint, vec binary")
    order = ["table", "dim", "code", "node"]
    dealt = cut(placed, "signs").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(compare, _LISTS)


def merged(lists: DataFrame, found: DataFrame, rule: NearRule) -> tuple[DataFrame, dict]:
    """The lists (node, k, others, sims, fresh) after candidates (node, others, sims) have come in, and what changed."""
    candidates = found.groupBy("node").agg(F.flatten(F.collect_list("others")).alias("new_others"), F.flatten(F.collect_list("sims")).alias("new_sims"))
    limit, most = rule.cosine - rule.slack, rule.most_neighbours

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for i, k in enumerate(sizes):
                old = [batch.column(c)[i].values for c in (2, 3, 4)]
                new = [batch.column(c)[i].values for c in (5, 6)]
                others = old[0].to_numpy() if old[0] is not None else np.empty(0, np.int64)
                sims = old[1].to_numpy() if old[1] is not None else np.empty(0, np.float32)
                fresh = np.zeros(len(others), bool)
                if new[0] is not None:
                    more = new[0].to_numpy()
                    more_at = np.unique(more, return_index=True)[1]
                    more_at = more_at[~np.isin(more[more_at], others) & (more[more_at] != nodes[i])]
                    others = np.concatenate((others, more[more_at]))
                    sims = np.concatenate((sims, new[1].to_numpy()[more_at]))
                    fresh = np.concatenate((fresh, np.ones(len(more_at), bool)))
                best = np.lexsort((others, -sims))[:k]
                others, sims, fresh = others[best], sims[best], fresh[best]
                full = len(best) == k and sims[-1] >= limit
                gained = 0 if full else int((fresh & (sims >= limit)).sum())
                grown = full and k < most
                if grown:  # what was turned away before may enter now
                    k, fresh = min(2 * k, most), np.ones(len(best), bool)
                rows.append((nodes[i], k, others, sims, fresh, gained, grown, full and not grown))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["node", "k", "others", "sims", "fresh", "gained", "grown", "crowded"])

    joined = lists.join(candidates, "node", "left").select("node", "k", "others", "sims", "fresh", "new_others", "new_sims")
    made = joined.mapInArrow(merge, "node bigint, k int, others array<bigint>, sims array<float>, fresh array<boolean>, gained bigint, grown boolean, crowded boolean")
    return cut_observed(made, "neighbour-lists", gained=F.sum("gained"), grown=F.count_if("grown"), crowded=F.count_if("crowded"))


def one_round(lists: DataFrame, vectors: DataFrame, rule: NearRule, number: int) -> DataFrame:
    """Candidates (node, others, sims): neighbours of a common node that beat the worst entry of a list."""
    floor = F.when(F.size("sims") < F.col("k"), F.lit(-2.0)).otherwise(F.element_at("sims", -1))
    members = vectors.join(lists.select("node", floor.cast("float").alias("floor")), "node").select(F.col("node").alias("member"), "floor", "vec")
    listed = lists.select("node", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.fresh").alias("fresh"))
    edges = listed.select(F.col("node").alias("center"), F.col("other").alias("member"), "fresh").union(
        listed.select(F.col("other").alias("center"), F.col("node").alias("member"), "fresh")
    )
    edges = edges.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    centers = edges.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / rule.block).cast("int").alias("blocks"), F.max("fresh").alias("moves"))
    centers = centers.where("moves").drop("moves")
    deal = F.pmod(F.xxhash64("member", F.lit(number)), F.col("blocks")).alias("block")
    dealt = edges.join(centers, "center").select("center", deal, "member", "fresh").join(members, "member")
    rows = dealt.select("center", "block", "member", "fresh", "floor", "vec").repartition("center", "block").sortWithinPartitions("center", "block")
    most = rule.most_neighbours

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.RecordBatch]:
            left = None
            for batch in batches:
                batch = batch if left is None else pa.concat_batches([left, batch])
                centers, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ends = np.flatnonzero((centers[1:] != centers[:-1]) | (parts[1:] != parts[:-1])) + 1
                start = 0
                for end in ends:
                    yield batch.slice(start, end - start)
                    start = end
                left = batch.slice(start)
            if left is not None and left.num_rows:
                yield left

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for block in blocks():
                if block.num_rows < 2:
                    continue
                nodes, fresh, floors = block.column(2).to_numpy(), block.column(3).to_numpy(zero_copy_only=False), block.column(4).to_numpy()
                found = matrix(block.column(5), np.float16).astype(np.float32)
                sims = found @ found.T
                np.fill_diagonal(sims, -3)
                x, y = np.nonzero((sims > floors[:, None]) & (fresh[:, None] | fresh[None, :]))
                yield nodes[x], nodes[y], sims[x, y]

        yield from _collected(pairs(), most)

    return rows.mapInArrow(compare, _LISTS)


def strong_pairs(lists: DataFrame, nodes: DataFrame, rule: NearRule) -> DataFrame:
    """(a, b) with a < b: the entries of lists that are links in double precision."""
    near = lists.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).where(F.col("e.sims") >= rule.cosine - rule.slack)
    pairs = near.select(F.least("node", "e.others").alias("a"), F.greatest("node", "e.others").alias("b")).distinct()
    left, right = nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    limit = rule.cosine

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            keep = [float(np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer())) >= limit for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def against_all(nodes: DataFrame, asked: list[tuple[int, bytes]], cosine: float, out: str, answer) -> DataFrame:
    """Compare all nodes, batch by batch, with a list of (name, unit) of bounded length; `answer` makes the rows `out`.

    It is given the names of a batch, those asked for, and the matrix of cosines not less than `cosine`.
    """
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(unit) for _, unit in asked}:
        own = [(name, unit) for name, unit in asked if len(unit) == size]
        by_dim[size] = np.array([n for n, _ in own], np.int64), np.frombuffer(b"".join(u for _, u in own)).reshape(len(own), -1)
    sent = nodes.sparkSession.sparkContext.broadcast(by_dim)  # as many as are asked for, a documented number

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([v.as_buffer().size for v in batch.column(1)])
            for size in set(sizes.tolist()) & set(sent.value):
                part = batch.filter(pa.array(sizes == size))
                names, units = sent.value[size]
                yield answer(part.column(0).to_numpy(), names, matrix(part.column(1), np.float64) @ units.T >= cosine)

    return nodes.select("node", "unit").mapInArrow(compare, out)


def audit(lists: DataFrame, nodes: DataFrame, rule: NearRule) -> float:
    """The share of the links of a sample of nodes that their lists hold. Crowded nodes are left to the exact way."""
    sample = lists.where("NOT crowded").select("node", "others", "sims").join(nodes.select("node", "unit"), "node")
    asked = sample.orderBy(F.xxhash64("node")).limit(rule.audited).collect()  # a documented number of rows
    if not asked:
        return 1.0

    def count(batch_nodes: np.ndarray, names: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array((linked & (batch_nodes[:, None] != names[None, :])).sum(0))], ["node", "n"])

    counts = against_all(nodes, [(r["node"], r["unit"]) for r in asked], rule.cosine, "node bigint, n bigint", count)
    truth = {r["node"]: r["n"] for r in counts.groupBy("node").agg(F.sum("n").alias("n")).collect()}
    held = sum(min(truth.get(r["node"], 0), sum(s >= rule.cosine - rule.slack for s in r["sims"])) for r in asked)
    total = sum(truth.values())
    return held / total if total else 1.0


def descend(nodes: DataFrame, rule: NearRule) -> DataFrame:
    """The neighbour lists (node, k, others, sims, fresh, crowded) of nodes (node, unit); units are bytes of doubles."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = cut(halved(nodes), "vectors")
    none = "cast(array() AS array<{}>)"
    lists = vectors.select("node", F.lit(rule.neighbours).alias("k"), *[F.expr(none.format(t)).alias(c) for c, t in (("others", "bigint"), ("sims", "float"), ("fresh", "boolean"))])
    tables = number = 0
    while True:
        found = first_lists(vectors, rule, range(tables, tables + rule.tables), partitions)
        lists, seen = merged(lists, found, rule)
        tables += rule.tables
        moving = True
        while moving:
            number += 1
            lists, seen = merged(lists.select("node", "k", "others", "sims", "fresh"), one_round(lists, vectors, rule, number), rule)
            moving = bool(seen["gained"] or seen["grown"])
        if audit(lists, nodes, rule) >= rule.recall:
            return lists
        lists = lists.select("node", "k", "others", "sims", "fresh")
