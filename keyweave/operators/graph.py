"""Degrees, roles, hops and hub clusters of a graph given as an edge table (src, dst).

An edge goes from the referring node (child) to the referred one (parent). Node names are strings. All
operators are joins and aggregates on the edge table, so a graph of data rows works like one of tables.
Where edges meet node facts, the edges are the streamed side of the join, which lets adaptive execution
split the rows of a hot node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keyweave.lineage import cut, cut_bucketed, cut_observed, new_folder
from keyweave.operators.numbering import number_rows


def links(edges: DataFrame) -> DataFrame:
    """Distinct directed edges."""
    return edges.select("src", "dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, self edges left out."""
    forward = edges.select("src", "dst").where("src <> dst")
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, outgoing, incoming, degree).

    Outgoing counts distinct parents, itself included; incoming counts distinct other children; a mutual pair
    counts on both. `nodes(node)` adds the nodes without an edge. One shuffle for the distinct edges, one for
    the sums, both combined in the map tasks first.
    """
    return _degree_sums(links(edges), nodes)


def _degree_sums(distinct: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`degrees` of edges that are distinct already."""
    none = F.lit(0).cast("bigint")
    counted = _ends(distinct)
    if nodes is not None:
        counted = counted.unionByName(nodes.select("node", none.alias("o"), none.alias("i")))
    sums = counted.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return sums.withColumn("degree", F.col("outgoing") + F.col("incoming"))


def _ends(distinct: DataFrame) -> DataFrame:
    """(node, o, i): what each distinct edge adds to the outgoing and incoming edges of its ends."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    of_other = F.when(F.col("src") == F.col("dst"), none).otherwise(one)
    ends = F.array(
        F.struct(F.col("src").alias("node"), one.alias("o"), none.alias("i")),
        F.struct(F.col("dst").alias("node"), none.alias("o"), of_other.alias("i")),
    )
    return distinct.select(F.inline(ends))


def incoming_links(edges: DataFrame) -> DataFrame:
    """(node, incoming) of the nodes that others refer to, as in `degrees`."""
    itself = F.coalesce(F.col("src") == F.col("dst"), F.lit(False))
    return links(edges.where(~itself)).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))


def ranked_first(degree_table: DataFrame) -> DataFrame:
    """The node of highest (degree, name): one row."""
    top = degree_table.agg(F.max(F.struct("degree", "node")).alias("_top"))
    return top.select("_top.node", "_top.degree")


def roles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree, role, flag): orphan, single child or main; the first hub carries the flag."""
    table = degrees(edges, nodes)
    flag = ranked_first(table).select(F.col("node").alias("_flag"))
    role = (
        F.when(F.col("degree") == 0, "orphan").when(F.col("degree") == 1, "single child").otherwise("main")
    )
    joined = table.join(F.broadcast(flag), F.col("node") == F.col("_flag"), "left")
    return joined.select("node", "degree", role.alias("role"), F.col("_flag").isNotNull().alias("flag"))


def hubs(edges: DataFrame) -> DataFrame:
    """Main nodes numbered by (degree, name), both descending."""
    main = degrees(edges).where("degree > 1").select("node", "degree")
    return number_rows(main, [F.desc("degree"), F.desc("node")], name="rank", distinct_rows=True)


def top_nodes(edges: DataFrame, k: int = 5) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), F.desc("node")).limit(k)


def single_children(edges: DataFrame) -> DataFrame:
    """(child, parent): nodes of degree 1 with their only neighbour.

    A node whose only edge is to itself has no neighbour and is no child.
    """
    distinct = links(edges)
    return _children(distinct, _degree_sums(distinct)).select("child", "parent")


def _children(distinct: DataFrame, degree_table: DataFrame) -> DataFrame:
    """(child, parent, refers) of distinct edges; `refers` tells whether the edge goes from child to parent.

    A node of degree 1 is on one distinct edge, so that edge is looked up and nothing is grouped.
    """
    ends = F.array(
        F.struct(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit(True).alias("refers")),
        F.struct(F.col("dst").alias("child"), F.col("src").alias("parent"), F.lit(False).alias("refers")),
    )
    one = degree_table.where("degree = 1").select(F.col("node").alias("child"))
    return distinct.where("src <> dst").select(F.inline(ends)).join(one, "child", "left_semi")


def numbered_children(edges: DataFrame) -> DataFrame:
    """(parent, position, child): the single children of each parent in name order."""
    table = single_children(edges)
    return number_rows(table, [F.col("child")], within=["parent"], distinct_rows=True)


def relation_counts(edges: DataFrame) -> DataFrame:
    """(node, relations): edges that touch the node; a self edge counts once, parallel edges each."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("relations"))


def hub_links(edges: DataFrame) -> DataFrame:
    """Main nodes ranked by their links to the first hub (2 mutual, 1 one way, 0 none), then degree, then name."""
    distinct = cut(links(edges), "links")
    table = cut(_degree_sums(distinct), "degrees")
    hub = ranked_first(table).select(F.col("node").alias("_hub"))
    up = distinct.where("src <> dst").join(F.broadcast(hub), F.col("dst") == F.col("_hub")).select(F.col("src").alias("node"))
    down = distinct.where("src <> dst").join(F.broadcast(hub), F.col("src") == F.col("_hub")).select(F.col("dst").alias("node"))
    linked = up.unionByName(down).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    main = table.where("degree > 1").join(F.broadcast(hub), F.col("node") == F.col("_hub"), "left_anti")
    ranked = main.join(linked, "node", "left").select(
        "node", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "degree"
    )
    return number_rows(
        ranked, [F.desc("links"), F.desc("degree"), F.desc("node")], name="rank", distinct_rows=True
    )


def table_stats(columns: DataFrame, table: str = "table_name", name: str = "column_name") -> DataFrame:
    """(table, columns, longest_name) per table of a column catalogue."""
    return columns.groupBy(table).agg(
        F.count(F.lit(1)).alias("columns"), F.max(F.length(name)).cast("bigint").alias("longest_name")
    )


class Levels:
    """The levels of a search as one table, a folder for each: read at once, or one level alone, with a plan of one scan."""

    def __init__(self, spark, label: str):
        self._spark, self._path, self._schema, self.depth = spark, new_folder(spark, label), None, 0

    def add(self, level: DataFrame, **figures: Column) -> dict:
        """Write a level; the number of its rows, as `rows`, and other figures of it."""
        seen = Observation()
        figures = {"rows": F.count(F.lit(1)), **figures}
        level.observe(seen, *[c.alias(n) for n, c in figures.items()]).write.parquet(f"{self._path}/level={self.depth}")
        self._schema, self.depth = level.schema, self.depth + 1
        return seen.get

    def level(self, k: int) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/level={k}")

    def all(self) -> DataFrame:
        """The rows of all levels, with their `level`."""
        return self._spark.read.schema(StructType([*self._schema, StructField("level", LongType())])).parquet(self._path)


class OpenEdges:
    """Edges (src, dst, ...) that a search can still use: written anew without those to settled nodes once these are about half
    of the nodes they lead to, so that all rewriting together costs about as much as reading the edges twice."""

    def __init__(self, edges: DataFrame):
        self._write(edges)

    def _write(self, edges: DataFrame) -> None:
        self.edges, seen = cut_observed(edges, "open-edges", nodes=F.approx_count_distinct("dst"))
        self._nodes, self._settled = seen["nodes"], 0

    def settle(self, more: int, settled: DataFrame) -> None:
        """`more` nodes have joined the `settled` (node): no edge to them is of use any more."""
        self._settled += more
        if 2 * self._settled >= self._nodes > 0:
            self._write(self.edges.join(settled.select(F.col("node").alias("dst")), "dst", "left_anti"))


def _sides(ways: DataFrame, start: str) -> tuple[DataFrame, dict]:
    """(at, n, one, other) of all nodes but the start with one or two neighbours, and how many there are of each."""
    sides = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("one"), F.max("dst").alias("other"))
    kept = sides.where((F.col("n") <= 2) & (F.col("src") != F.lit(start))).withColumnRenamed("src", "at")
    return cut_observed(kept, "sides", tips=F.count_if(F.col("n") == 1), inner=F.count_if(F.col("n") == 2))


def _chain_spans(ways: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, length) between the ends of chains, and (node, stop, length) for the nodes within them.

    A node with two neighbours, other than the start, lies within a chain (`inner`): from an edge into it only one edge goes
    on. Each round joins what follows to what has been followed, so a chain of n edges takes log n rounds. Rings without any
    end can't be reached from the start; they are what is left when a round ends no chain.
    """
    inner = inner.where("n = 2").select("at", "one", "other")
    onward = F.when(F.col("one") == F.col("src"), F.col("other")).otherwise(F.col("one"))
    first = ways.join(inner, F.col("dst") == F.col("at"), "left").select(
        "src", "dst", F.coalesce("at", "src").alias("from"), F.when(F.col("at").isNotNull(), onward).otherwise(F.col("dst")).alias("to"),
        F.when(F.col("at").isNotNull(), 2).otherwise(1).cast("bigint").alias("length"), F.col("at").isNotNull().alias("going"),
    )
    # An edge whose end is within a chain goes on with the edge (from, to), whose own length counts anew.
    steps = first.join(inner.select(F.col("at").alias("to_inner")), F.col("to") == F.col("to_inner"), "left")
    steps = steps.select("src", "dst", "from", "to", "length", (F.col("going") & F.col("to_inner").isNotNull()).alias("going"))
    now, seen = cut_observed(steps, "chains", going=F.count_if("going"))
    going = seen["going"] + 1
    while 0 < seen["going"] < going:
        going = seen["going"]
        ahead = now.select(*[F.col(c).alias(f"{c}_") for c in now.columns])
        met = now.where("going").join(ahead, (F.col("from") == F.col("src_")) & (F.col("to") == F.col("dst_")))
        moved = met.select("src", "dst", F.col("from_").alias("from"), F.col("to_").alias("to"), (F.col("length") + F.col("length_") - 1).alias("length"), F.col("going_").alias("going"))
        now, seen = cut_observed(now.where("NOT going").union(moved), "chains", going=F.count_if("going"))
    ended = now.where("NOT going")
    outer = ended.join(inner.select(F.col("at").alias("src")), "src", "left_anti")
    edges = outer.where("src <> to").groupBy("src", F.col("to").alias("dst")).agg(F.min("length").alias("length"))
    within = ended.join(inner.select(F.col("at").alias("src")), "src", "left_semi").select(F.col("src").alias("node"), F.col("to").alias("stop"), "length")
    return edges, within


#: So many levels are searched edge by edge before the chains of what is left are followed; fewer if none has had WIDE nodes.
PLAIN_LEVELS, THIN_LEVELS, WIDE = 10, 6, 100


def hops(edges: DataFrame, start: str) -> DataFrame:
    """(node, hops): fewest edges from `start`, in either direction; no row if the start has no edge.

    The edges are shuffled once, into buckets by the node they leave; each round deals the last level to the buckets and writes
    the new nodes as the next level. What lies beyond these plain levels is searched from the last level as if that were one node,
    chains first, so rounds are as many as there are branchings on the way, not edges.
    """
    spark = edges.sparkSession
    forward = edges.select("src", "dst").where("src <> dst")
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = cut_bucketed(forward.select(F.inline(turned)), "ways", "src", 2 * edges.count())
    levels = Levels(spark, "hops")
    first = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).cast("bigint").alias("hops"))
    seen = levels.add(first.join(ways.where(F.col("src") == F.lit(start)), F.col("node") == F.col("src"), "left_semi"))
    widest = 0
    while seen["rows"] and levels.depth <= (PLAIN_LEVELS if widest >= WIDE else THIN_LEVELS):
        last = levels.level(levels.depth - 1).select("node")
        # A neighbour of a level lies in the level before it, in itself or in the next one.
        known = last if levels.depth == 1 else last.union(levels.level(levels.depth - 2).select("node"))
        met = ways.join(last.hint("shuffle_hash"), F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = met.join(known, "node", "left_anti")
        seen = levels.add(fresh.select("node", F.lit(levels.depth).cast("bigint").alias("hops")))
        widest = max(widest, seen["rows"])
    if seen["rows"]:
        depth, last = levels.depth - 1, levels.level(levels.depth - 1).select(F.col("node").alias("_last"))
        rest = ways.join(levels.all().select(F.col("node").alias("dst")), "dst", "left_anti").join(last, F.col("src") == F.col("_last"), "left")
        merged = F.when(F.col("_last").isNotNull(), F.lit(start)).otherwise(F.col("src"))
        beyond = _hops_along_chains(rest.select(merged.alias("src"), "dst"), start).where(F.col("node") != F.lit(start))
        levels.add(beyond.select("node", (F.col("hops") + depth).alias("hops")))
    return levels.all().select("node", "hops")


def _hops_along_chains(edges: DataFrame, start: str) -> DataFrame:
    """(node, hops) as of `hops`, for graphs of great depth.

    Nodes with one neighbour lead nowhere and are left out until the end. Chains are followed by doubling first and count as
    one edge of their length. Each round reads the last level and the edges that can still better something, and writes what
    it has bettered as the next level.
    """
    spark = edges.sparkSession
    ways = inward = cut(both_ways(edges), "ways")
    sides, seen = _sides(ways, start)
    tips = sides.where("n = 1").select(F.col("at").alias("node"), F.col("one").alias("stop")) if seen["tips"] else None
    if tips is not None:
        inward = ways.join(tips.select(F.col("node").alias("dst")), "dst", "left_anti").join(tips.select(F.col("node").alias("src")), "src", "left_anti")
        inward = cut(inward.select("src", "dst"), "inward")
        sides, seen = _sides(inward, start)
    between, within = inward.withColumn("length", F.lit(1).cast("bigint")), None
    if seen["inner"]:
        between, within = _chain_spans(inward, sides)
    levels, still = Levels(spark, "hops"), OpenEdges(between)
    first = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).cast("bigint").alias("hops"))
    levels.add(first.join(ways, F.col("node") == F.col("src"), "left_semi"))
    figures = {"rows": 1}
    while figures["rows"]:
        last = levels.level(levels.depth - 1)
        known = levels.all().groupBy("node").agg(F.min("hops").alias("known"))
        found = still.edges.join(last, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("hops") + F.col("length")).alias("hops"))
        better = found.join(known, "node", "left").where("known IS NULL OR hops < known").select("node", "hops")
        figures = levels.add(better, least=F.min("hops"))
        if figures["rows"]:
            # What is reached with no more hops than any later level can bring stays as it is.
            done = levels.all().groupBy("node").agg(F.min("hops").alias("hops")).where(F.col("hops") <= figures["least"] + 1)
            still.settle(figures["rows"], done)
    found = levels.all().groupBy("node").agg(F.min("hops").alias("hops"))
    if within is not None:
        ends = found.select(F.col("node").alias("stop"), F.col("hops").alias("before"))
        found = found.union(within.join(ends, "stop").groupBy("node").agg(F.min(F.col("before") + F.col("length")).alias("hops")))
    if tips is not None:
        found = cut(found, "hops")
        found = found.union(tips.join(found.select(F.col("node").alias("stop"), "hops"), "stop").select("node", (F.col("hops") + 1).alias("hops")))
    return found


def hub_clusters(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, role, parent, hub).

    Hubs are taken in descending (degree, name); a hub takes all its main neighbours that no earlier hub
    took; single children follow their only neighbour; nodes without neighbours stand alone as orphans.
    Taking them one by one is the same as taking, in each round, every undecided node that has no undecided
    neighbour of higher rank. Chains of nodes with one open higher neighbour each are decided in one round, by
    doubling; other orders take as many rounds as their longest run of dependent choices.
    """
    rows = edges.count()
    distinct = cut_bucketed(edges.select("src", "dst"), "links", "src", rows, distinct_rows=True)
    table = cut(_bucketed_degrees(distinct, nodes), "degrees")
    main = table.where("degree > 1").select("node", "degree")

    towards = cut_bucketed(_towards_higher(distinct, table), "ranked", "lo", rows)
    ranked = towards.where("lo_degree > 1").select("lo", "hi", "hi_degree")
    taken = _taken_nodes(ranked)
    chosen = cut(main.select("node").join(taken, "node", "left_anti"), "hubs")

    # Whatever has a hub above it is taken.
    members = (
        ranked.join(chosen.withColumnRenamed("node", "hi"), "hi", "left_semi")
        .groupBy("lo")
        .agg(F.max(F.struct("hi_degree", "hi")).alias("_best"))
        .select(F.col("lo").alias("node"), F.lit("member").alias("role"), F.col("_best.hi").alias("hub"))
    )
    main_rows = cut(
        chosen.select("node", F.lit("hub").alias("role"), F.col("node").alias("hub")).unionByName(members), "main"
    )

    children = cut(_lone_ends(towards), "children")
    under_main = children.join(main_rows.select(F.col("node").alias("parent"), "hub"), "parent").select(
        F.col("child").alias("node"), F.lit("child").alias("role"), "parent", "hub"
    )
    apart = table.where("degree <= 1").join(children, F.col("node") == F.col("child"), "left_anti").select(
        "node", F.lit("orphan").alias("role"), F.col("node").alias("parent"), F.col("node").alias("hub")
    )
    return (
        main_rows.select("node", "role", F.col("hub").alias("parent"), "hub")
        .unionByName(under_main)
        .unionByName(_pairs(children, table))
        .unionByName(apart)
    )


def _bucketed_degrees(distinct: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """`degrees` of distinct edges in buckets by `src`: only the incoming ones are shuffled, combined in the map tasks first."""
    none = F.lit(0).cast("bigint")
    of_other = F.when(F.col("src") == F.col("dst"), none).otherwise(F.lit(1).cast("bigint"))
    counted = distinct.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.lit(0).cast("bigint").alias("i"))
    counted = counted.unionByName(distinct.groupBy(F.col("dst").alias("node")).agg(F.sum(of_other).alias("i")).withColumn("o", none))
    if nodes is not None:
        counted = counted.unionByName(nodes.select("node", none.alias("o"), none.alias("i")))
    sums = counted.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return sums.withColumn("degree", F.col("outgoing") + F.col("incoming"))


def _towards_higher(distinct: DataFrame, table: DataFrame) -> DataFrame:
    """(lo, hi, lo_degree, hi_degree, refers): edges from the lower to the higher (degree, name); `refers` tells whether
    the lower node is the referring one.

    `distinct` lies in buckets by `src`; nodes that others refer to are written, so that Spark knows how many there are. A
    mutual pair gives two rows, which changes no hub and no member.
    """
    heads = cut(table.where("incoming > 0").select(F.col("node").alias("dst"), F.col("degree").alias("dst_degree")), "heads")
    tails = table.where("outgoing > 0").select(F.col("node").alias("src"), F.col("degree").alias("src_degree"))
    ends = distinct.where("src <> dst").join(tails.hint("shuffle_hash"), "src").join(heads, "dst")
    a, b = (F.struct(F.col(f"{end}_degree").alias("degree"), F.col(end).alias("node")) for end in ("src", "dst"))
    ranked = ends.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a < b).alias("refers"))
    return ranked.select(
        F.col("low.node").alias("lo"), F.col("high.node").alias("hi"),
        F.col("low.degree").alias("lo_degree"), F.col("high.degree").alias("hi_degree"), "refers",
    )


def _lone_ends(towards: DataFrame) -> DataFrame:
    """(child, parent, refers) as of `_children`, from the edges towards higher nodes."""
    lone = towards.where("lo_degree = 1")
    lower = lone.select(F.col("lo").alias("child"), F.col("hi").alias("parent"), "refers")
    return lower.unionByName(lone.where("hi_degree = 1").select(F.col("hi").alias("child"), F.col("lo").alias("parent"), (~F.col("refers")).alias("refers")))


def _taken_nodes(ranked: DataFrame) -> DataFrame:
    """(node): the main nodes that a hub takes; the other main nodes are the hubs.

    In each round, the nodes with open edges from below only are hubs. A node with one open edge to a higher
    node is the opposite of that node, so chains of such nodes follow from the node they end in. Lower ends of
    edges to hubs are taken; edges of taken nodes are closed.
    """
    open_edges, rows, taken = ranked.select("lo", "hi"), ranked.count(), []
    while rows:
        higher = cut(open_edges.groupBy(F.col("lo").alias("node")).agg(F.count(F.lit(1)).alias("n")), "higher")
        tops = cut(open_edges.select("hi").distinct().join(higher, F.col("hi") == F.col("node"), "left_anti"), "tops")
        # The two rows of a mutual pair are one edge.
        few = open_edges.join(higher.where("n <= 2").hint("shuffle_hash"), F.col("lo") == F.col("node"), "left_semi")
        one = few.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("end"), F.max("hi").alias("_last")).where("end = _last")
        ends = _chain_ends(one.select("node", "end", F.lit(True).alias("turned")))
        decided = ends.join(tops, F.col("end") == F.col("hi"), "left_semi")
        hubs = cut(tops.select(F.col("hi").alias("hub")).unionByName(decided.where("NOT turned").select(F.col("node").alias("hub"))), "hubs")
        below = open_edges.join(hubs, F.col("hi") == F.col("hub"), "left_semi").select(F.col("lo").alias("node")).distinct()
        new = cut(below, "taken")
        taken.append(new)
        rest = open_edges.join(new.withColumnRenamed("node", "lo"), "lo", "left_anti")
        rest = rest.join(new.withColumnRenamed("node", "hi"), "hi", "left_anti").select("lo", "hi")
        open_edges = cut_bucketed(rest, "open", "lo", rows)
        rows = open_edges.count()
    return reduce(DataFrame.unionByName, taken, ranked.select(F.col("lo").alias("node")).limit(0))


def _chain_ends(pointers: DataFrame) -> DataFrame:
    """(node, end, turned): where the pointers (node, end, turned) lead, each step doubling their reach."""
    now = cut(pointers, "pointers")
    moved = 1
    while moved:
        after = now.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("turned").alias("_turned"))
        doubled = now.join(after, "end", "left").select(
            "node",
            F.coalesce("_end", "end").alias("end"),
            (F.col("turned") != F.coalesce("_turned", F.lit(False))).alias("turned"),
            F.col("_end").isNotNull().alias("_moved"),
        )
        now, seen = cut_observed(doubled, "pointers", moved=F.count_if("_moved"))
        now, moved = now.drop("_moved"), seen["moved"]
    return now


def _pairs(children: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of two nodes that are each other's only neighbour: the referred one is the hub.

    In a graph without main nodes the first node by (degree, name) is a hub, whichever end it is.
    """
    other = children.select(F.col("child").alias("_other"))
    pair = children.where("refers").join(other, F.col("parent") == F.col("_other"), "left_semi")
    flag = ranked_first(table).where("degree = 1").select(F.col("node").alias("_flag"))
    turned = pair.join(F.broadcast(flag), F.col("child") == F.col("_flag"), "left")
    is_flag = F.col("_flag").isNotNull()
    named = turned.select(
        F.when(is_flag, F.col("child")).otherwise(F.col("parent")).alias("hub"),
        F.when(is_flag, F.col("parent")).otherwise(F.col("child")).alias("child"),
    )
    rows = [
        F.struct(F.col(node).alias("node"), F.lit(role).alias("role"), F.col("hub").alias("parent"), F.col("hub").alias("hub"))
        for node, role in (("hub", "hub"), ("child", "child"))
    ]
    return named.select(F.inline(F.array(*rows)))
