import random

import pytest
from pyspark.sql import functions as F

from keyweave.operators import graph
from keyweave.plans import join_path as paths
from keyweave.workload.tables import FOREIGN_KEYS

SHOP = [("Product", "Producer"), ("Garbage", "Product"), ("Garbage", "Consumer")]
WEB = [("projects", "users"), ("projects", "categories"), ("data", "projects"), ("projects_tags", "tags"), ("projects_tags", "projects")]


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def random_edges(seed, nodes=14, count=22):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(count)]


def model_degrees(pairs, nodes=()):
    pairs = set(pairs)
    names = {n for p in pairs for n in p} | set(nodes)
    out = {n: len({d for s, d in pairs if s == n}) for n in names}
    inn = {n: len({s for s, d in pairs if d == n and s != n}) for n in names}
    return {n: (out[n], inn[n], out[n] + inn[n]) for n in names}


def model_clusters(pairs, nodes=()):
    """One hub after the other, as the rule says."""
    degree = {n: d[2] for n, d in model_degrees(pairs, nodes).items()}
    near = {n: set() for n in degree}
    for s, d in pairs:
        if s != d:
            near[s].add(d)
            near[d].add(s)
    order = sorted(degree, key=lambda n: (degree[n], n), reverse=True)
    placed = {}
    for n in order:
        if degree[n] > 1 and n not in placed:
            placed[n] = ("hub", n, n)
            for m in near[n]:
                if degree[m] > 1 and m not in placed:
                    placed[m] = ("member", n, n)
    flag = order[0] if order else None
    for s, d in pairs:
        if s != d and degree[s] == degree[d] == 1:
            hub, child = (s, d) if s == flag else (d, s)
            placed[hub], placed[child] = ("hub", hub, hub), ("child", hub, hub)
    for n in order:
        if n not in placed and degree[n] == 1 and near[n]:
            (parent,) = near[n]
            placed[n] = ("child", parent, placed[parent][2])
    return {n: placed.get(n, ("orphan", n, n)) for n in degree}


def clusters(spark, pairs, nodes=None):
    frame = spark.createDataFrame([(n,) for n in nodes], "node string") if nodes else None
    return {r.node: (r.role, r.parent, r.hub) for r in graph.hub_clusters(edges_of(spark, pairs), frame).collect()}


def test_degrees_of_the_samples(spark):
    got = {r.node: r.degree for r in graph.degrees(edges_of(spark, SHOP)).collect()}
    assert got == {"Producer": 1, "Consumer": 1, "Product": 2, "Garbage": 2}
    got = {r.node: r.degree for r in graph.degrees(edges_of(spark, WEB)).collect()}
    assert got == {"projects": 4, "projects_tags": 2, "data": 1, "tags": 1, "categories": 1, "users": 1}


@pytest.mark.parametrize("seed", range(3))
def test_degrees_and_clusters_match_a_sequential_model(spark, seed):
    pairs = random_edges(seed, count=(22, 14, 40)[seed])
    got = {r.node: (r.outgoing, r.incoming, r.degree) for r in graph.degrees(edges_of(spark, pairs)).collect()}
    assert got == model_degrees(pairs)
    nodes = ["n01", "lonely"]
    assert clusters(spark, pairs, nodes) == model_clusters(pairs, nodes)


def test_clusters_of_the_samples(spark):
    assert clusters(spark, SHOP) == {
        "Product": ("hub", "Product", "Product"), "Garbage": ("member", "Product", "Product"),
        "Producer": ("child", "Product", "Product"), "Consumer": ("child", "Garbage", "Product"),
    }
    got = clusters(spark, WEB)
    assert got["projects"][0] == "hub" and got["projects_tags"] == ("member", "projects", "projects")
    assert got["tags"] == ("child", "projects_tags", "projects")


def test_clusters_of_the_given_tables(spark):
    got = clusters(spark, [(child, parent) for child, _, parent, _ in FOREIGN_KEYS], ["pages"])
    assert {n for n, (role, _, _) in got.items() if role == "hub"} == {"nation", "lineitem", "documents"}
    assert got["customer"] == ("member", "nation", "nation") and got["orders"] == ("member", "lineitem", "lineitem")
    assert got["events"] == ("child", "customer", "nation") and got["part"] == ("child", "lineitem", "lineitem")
    assert got["labels"] == ("child", "documents", "documents") and got["pages"] == ("orphan", "pages", "pages")


def test_pairs_and_self_edges(spark):
    assert clusters(spark, [("b", "a"), ("d", "c"), ("e", "e")]) == model_clusters([("b", "a"), ("d", "c"), ("e", "e")])
    got = clusters(spark, [("a", "b"), ("x", "y"), ("x", "z")])
    assert got["b"][0] == "hub" and got["a"] == ("child", "b", "b") and got["x"][0] == "hub"
    assert clusters(spark, [("e", "e"), ("x", "y"), ("x", "z")])["e"][0] == "orphan"


def test_roles_hubs_and_children(spark):
    nodes = spark.createDataFrame([("lonely",)], "node string")
    got = {r.node: (r.role, r.flag) for r in graph.roles(edges_of(spark, WEB), nodes).collect()}
    assert got["projects"] == ("main", True) and got["data"] == ("single child", False) and got["lonely"] == ("orphan", False)
    assert [(r.rank, r.node) for r in graph.hubs(edges_of(spark, SHOP)).orderBy("rank").collect()] == [(1, "Product"), (2, "Garbage")]
    children = graph.numbered_children(edges_of(spark, WEB)).orderBy("parent", "position").collect()
    assert [(r.parent, r.position, r.child) for r in children] == [
        ("projects", 1, "categories"), ("projects", 2, "data"), ("projects", 3, "users"), ("projects_tags", 1, "tags"),
    ]
    assert [r.node for r in graph.top_nodes(edges_of(spark, WEB), 2).collect()] == ["projects", "projects_tags"]


def test_hub_links_and_relation_counts(spark):
    pairs = [("h", "a"), ("a", "h"), ("b", "h"), ("h", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("h", "h")]
    got = [(r.rank, r.node, r.links) for r in graph.hub_links(edges_of(spark, pairs)).orderBy("rank").collect()]
    assert got == [(1, "a", 2), (2, "c", 1), (3, "b", 1), (4, "d", 0)]
    counts = {r.node: r.relations for r in graph.relation_counts(edges_of(spark, pairs + [("b", "h")])).collect()}
    assert counts["h"] == 6 and counts["b"] == 3 and counts["e"] == 1


@pytest.mark.parametrize("seed", range(2))
def test_hops_match_a_plain_search(spark, seed):
    pairs = random_edges(seed, nodes=20, count=22)
    start = pairs[0][0]
    level, expected = {start}, {start: 0}
    while level:
        level = {b for a, b in pairs + [(d, s) for s, d in pairs] if a in level and b not in expected}
        expected.update({n: max(expected.values()) + 1 for n in level})
    assert {r.node: r.hops for r in graph.hops(edges_of(spark, pairs), start).collect()} == expected


def test_hops_from_an_unknown_node(spark):
    assert graph.hops(edges_of(spark, SHOP), "nowhere").count() == 0


def fk(spark, rows):
    return spark.createDataFrame(rows, "edge_ord bigint, child string, child_column string, parent string, parent_column string")


def plan(spark, rows, start, end):
    steps = paths.join_path_plan(paths.relations_as_edges(fk(spark, rows)), start, end).orderBy("step").collect()
    return [(s.table_name, s.previous_columns, s.this_columns) for s in steps]


def model_path(rows, start, end):
    """Breadth first over adjacency lists in edge order."""
    near = {}
    for _, child, cc, parent, pc in rows:
        near.setdefault(child, []).append((parent, cc, pc))
        near.setdefault(parent, []).append((child, pc, cc))
    queue, seen = [[(start, None, None)]], {start}
    while queue:
        path = queue.pop(0)
        if path[-1][0] == end:
            return path
        for table, before, here in near.get(path[-1][0], []):
            if table not in seen:
                seen.add(table)
                queue.append(path + [(table, [before], [here])])
    return []


@pytest.mark.parametrize("seed", range(4))
def test_path_is_the_one_a_queue_finds_first(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"t{rng.randrange(9)}", f"c{i}", f"t{rng.randrange(9)}", f"p{i}") for i in range(16)]
    for end in ("t1", "t7"):
        assert plan(spark, rows, "t0", end) == model_path(rows, "t0", end)


def test_path_corner_cases(spark):
    rows = [(1, "a", "x", "a", "id"), (2, "a", "b1", "b", "id"), (3, "a", "b2", "b", "id"), (4, "c", "d", "d", "id")]
    assert plan(spark, rows, "a", "a") == [("a", None, None)]
    assert plan(spark, rows, "b", "a") == [("b", None, None), ("a", ["id"], ["b1"])]
    assert plan(spark, rows, "a", "d") == []


def test_parts_of_one_constraint_join_together(spark):
    rows = [(1, "a", "x", "b", "p", "k"), (2, "a", "y", "b", "q", "k")]
    named = spark.createDataFrame(rows, "edge_ord bigint, child string, child_column string, parent string, parent_column string, constraint_name string")
    steps = paths.join_path_plan(paths.relations_as_edges(named), "a", "b").orderBy("step").collect()
    assert (steps[1].previous_columns, steps[1].this_columns) == (["x", "y"], ["p", "q"])
    tables = {
        "a": spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "x int, y int"),
        "b": spark.createDataFrame([(1, 2, "hit"), (9, 9, "miss")], "p int, q int, v string"),
    }
    joined = paths.join_path(tables, named, "a", "b")
    assert joined.columns == ["t0__x", "t0__y", "t1__p", "t1__q", "t1__v"]
    assert [tuple(r) for r in joined.collect()] == [(1, 2, 1, 2, "hit")]
    assert paths.join_path(tables, named, "a", "a").count() == 3


def test_no_path_gives_no_rows(spark):
    tables = {"a": spark.createDataFrame([(1,)], "x int"), "z": spark.createDataFrame([(1,)], "x int")}
    assert paths.join_path(tables, fk(spark, [(1, "a", "x", "b", "id")]), "a", "z").count() == 0
