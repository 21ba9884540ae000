"""What plans and files look like: nothing grows with depth, no whole row is sorted, untouched files stay."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from keyweave import lineage
from keyweave.operators import graph, store
from keyweave.operators.catalog import find_tables
from keyweave.operators.keys import by_table_id, dangling, foreign_key_mismatches, resolved, table_id
from keyweave.operators.numbering import number_rows
from keyweave.operators.search import TableSearch, search_indexed, search_values
from keyweave.plans.join_path import both_directions, join_path, join_path_plan, relations_as_edges, shortest_path
from keyweave.sources.design_xml import Design, design_elements, one_name, read_design, write_design


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_hops(edges, start):
    ways = {}
    for a, b in edges:
        if a != b:
            ways.setdefault(a, set()).add(b)
            ways.setdefault(b, set()).add(a)
    found, queue = ({start: 0}, deque([start])) if start in ways else ({}, deque())
    while queue:
        a = queue.popleft()
        for b in ways[a]:
            if b not in found:
                found[b] = found[a] + 1
                queue.append(b)
    return sorted(found.items())


def line(prefix, n):
    return [(f"{prefix}{i}", f"{prefix}{i + 1}") for i in range(n)]


GRAPHS = {
    "a chain of a thousand": line("a", 1000),
    "a ring": [*line("a", 30), ("a30", "a0"), ("x", "y"), ("y", "z"), ("z", "x")],
    "a loop on a stalk": [("a0", "b0"), *line("b", 9), ("b9", "b0"), ("b4", "tip")],
    "two ways of unequal length": [*line("a", 12), ("a0", "s"), ("s", "a12"), *line("t", 3), ("a12", "t0")],
    "self edges, mutual pairs and repeats": [("a0", "a0"), ("a0", "b"), ("b", "a0"), ("a0", "b"), ("c", "c")],
    "a start without edges": [("x", "y")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_hops(spark, name):
    edges = GRAPHS[name]
    assert rows(graph.hops(spark.createDataFrame(edges, "src string, dst string"), "a0")) == sorted(plain_hops(edges, "a0"), key=str)


def test_hops_of_a_random_graph(spark):
    rng = random.Random(5)
    edges = [(f"a{rng.randrange(300)}", f"a{rng.randrange(300)}") for _ in range(330)] + [("a0", "a1")]
    assert rows(graph.hops(spark.createDataFrame(edges, "src string, dst string"), "a0")) == sorted(plain_hops(edges, "a0"), key=str)


def test_plans_of_searches_do_not_grow_with_depth(spark):
    """A ladder has no chains to follow: each rung is a round."""

    def ladder(n):
        rungs = [(f"a{i}", f"b{i}") for i in range(n)]
        return spark.createDataFrame([*line("a", n - 1), *line("b", n - 1), *rungs], "src string, dst string")

    short, long = graph.hops(ladder(5), "a0"), graph.hops(ladder(16), "a0")
    assert plan_of(short).count("Scan") == plan_of(long).count("Scan")
    assert rows(long)[-1] == ("b9", 10)


def test_hops_write_each_edge_once(spark, monkeypatch):
    written = []

    def noting(spark, label, named=lineage.new_folder):
        written.append(named(spark, label))
        return written[-1]

    monkeypatch.setattr(lineage, "new_folder", noting)
    monkeypatch.setattr(graph, "new_folder", noting)
    edges = [(f"p{i}", f"s{i * 7 % 11 + k}") for i in range(60) for k in range(5)] + [("tip", "s0"), ("p1", "s7")]
    found = rows(graph.hops(spark.createDataFrame(edges, "src string, dst string"), "p1"))
    assert found == sorted(plain_hops(edges, "p1"), key=str)
    assert sum(spark.read.parquet(path).count() for path in written) == 2 * len(edges) + len(found)


def test_rounds_of_hops_shuffle_no_edges(spark):
    """A broadcast would hide it; the exchanges that are left deal out the level and what it meets."""
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(50)], "src string, dst string")
    ways = lineage.cut_bucketed(edges, "ways", "src", 50)
    level = spark.createDataFrame([("a3",), ("a9",)], "node string")
    met = ways.join(level.hint("shuffle_hash"), F.col("src") == F.col("node"), "left_semi")
    assert rows(met) == [("a3", "a4"), ("a9", "a10")]
    assert plan_of(met).split("== Initial Plan ==")[0].count("Exchange") == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keyweave")]


def test_hops_beyond_the_plain_levels(spark):
    """The last plain level has several nodes, and ways between them, chains, tips and rings lie beyond it."""
    rng = random.Random(0)
    edges = [(f"a{i}", f"a{i + rng.choice([1, 1, 2, 5])}") for i in range(120)] + [(f"a{rng.randrange(40, 120)}", f"t{i}") for i in range(10)]
    edges += [*line("c", 40), ("a90", "c0"), ("c40", "a100"), ("x", "y"), ("y", "z"), ("z", "x"), ("a0", "a1"), (None, "a3"), ("a4", None)]
    expected = plain_hops([e for e in edges if None not in e], "a0")
    assert max(h for _, h in expected) > graph.PLAIN_LEVELS + 5
    assert rows(graph.hops(spark.createDataFrame(edges, "src string, dst string"), "a0")) == sorted(expected, key=str)


def test_rounds_of_clusters_shuffle_no_edges(spark, monkeypatch):
    """Edges lie in buckets by their lower end; hubs are few enough for a broadcast here."""
    plans = []

    def noting(how):
        def noted(df, label, **figures):
            plans.append((label, plan_of(df)))
            return how(df, label, **figures)

        return noted

    monkeypatch.setattr(graph, "cut", noting(lineage.cut))
    monkeypatch.setattr(graph, "cut_observed", noting(lineage.cut_observed))
    edges = [(f"p{i}", f"s{i * 7 % 11 + k}") for i in range(60) for k in range(5)] + [("tip", "s3"), ("p1", "s7"), ("s7", "p1")]
    found = {r.node: (r.role, r.hub) for r in graph.hub_clusters(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {role for n, (role, _) in found.items() if n[0] == "s"} == {"hub"} and found["tip"] == ("child", "s3")
    noted = {label for label, _ in plans}
    assert {"taken", "children"} <= noted
    assert not [label for label, plan in plans if label in ("taken", "higher", "children") and "Exchange hashpartitioning" in plan]


def test_shortest_path_of_a_random_graph(spark):
    rng = random.Random(6)
    edges = [(i, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for i in range(90)]
    df = spark.createDataFrame(edges, "edge_ord bigint, child string, parent string")
    ways = {}
    for i, a, b in edges:
        if a != b:
            ways.setdefault(a, []).append((i, b))
            ways.setdefault(b, []).append((i, a))
    for end in ("n7", "n21", "n0", "nowhere"):
        queue, best = deque([("n0", [])]), None
        seen = {"n0"}
        while queue and best is None:
            node, path = queue.popleft()
            if node == end:
                best = path
            for i, other in sorted(ways.get(node, [])):
                if other not in seen:
                    seen.add(other)
                    queue.append((other, [*path, (i, other)]))
        found = shortest_path(both_directions(df), "n0", end).collect()
        assert [[tuple(s) for s in r.path] for r in found] == ([] if best is None else [best]), end


def test_only_keys_of_samples_are_ranked(spark):
    df = spark.createDataFrame([(i % 4, None if i % 5 == 0 else f"text {i % 3}", {"m": i % 2}) for i in range(60)] + [(None, "text", None)] * 3, "k bigint, t string, m map<string,bigint>")
    found = search_values(df, "text", key=["k"], samples=4)
    sort = [x for x in plan_of(found.sample_rows).splitlines() if "Sort [" in x or "Window" in x]
    assert sort and not any("_row" in x for x in sort)
    assert Counter(r.k for r in found.sample_rows.collect()) == Counter([None, None, None, 0])
    assert Counter(map(str, found.sample_rows.collect())) == Counter(map(str, search_values(df.repartition(9), "text", key=["k"], samples=4).sample_rows.collect()))


def test_search_through_the_index(spark):
    names = "source_schema string, table_schema string, table_name string, column_name string"
    index = spark.createDataFrame([("s", "a", "t", "x"), ("s", "b", "t", "x"), ("s", "b", "gone", "x"), ("s", "c", "other", "x")], names)
    one, two = spark.createDataFrame([(1, "hit"), (2, "hit")], "id int, x string"), spark.createDataFrame([(3, "HIT"), (4, "no")], "id int, x string")
    tables = {"s.a.t": one, "s.b.t": two, "s.c.other": one}
    hits, samples = search_indexed(index, ".T", tables, "hit", {"s.a.t": TableSearch(row_filter="id > 1", key=("id",)), "s.b.t": TableSearch(ignore_case=True)})
    assert rows(hits) == [("s.a.t", "x", 1), ("s.b.t", "x", 1)] and rows(samples) == [("s.a.t", "x", '{"id":2,"x":"hit"}')]
    none, no_samples = search_indexed(index, "nothing like it", tables, "hit")
    assert none.collect() == no_samples.collect() == [] and find_tables(index, "gone").count() == 1


def test_many_copies_are_numbered_in_one_branch(spark):
    df = spark.createDataFrame([("a", 1)] * 2500 + [("a", 0), ("b", 5)], "g string, v int")
    numbered = number_rows(df, [F.col("v")], within=["g"])
    assert "Union" not in plan_of(numbered)
    assert rows(numbered.where("g = 'a'").select("position")) == sorted([(i,) for i in range(1, 2502)], key=str)
    assert numbered.where("g = 'a' AND v = 0").first().position == 1 and numbered.where("g = 'b'").first().position == 1


def test_an_upsert_leaves_untouched_files(spark, tmp_path):
    def at(hour):
        return f"2024-01-01 {hour:02}:00:00"

    make = lambda data: spark.createDataFrame(data, "key string, payload string, at string").select("key", "payload", F.to_timestamp_ntz("at").alias("dt"))
    files = store.PartitionedStore(str(tmp_path / "store"), parts=8)
    base = make([(f"k{i}", "old", at(5)) for i in range(100)])
    files.create(base)
    listed = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.parquet")}
    before = listed()
    updates = make([("k1", "late", at(9)), ("k1", "later", at(10)), ("k2", "early", at(1)), ("new", "first", None)])
    touched = files.upsert(updates)
    after = listed()
    assert 1 <= len(touched) <= 3
    same = {p for p in before if int(str(p).split("part=")[1].split("/")[0]) not in touched}
    assert same and all(after[p] == before[p] for p in same) and not any(p in after for p in set(before) - same)
    assert rows(files.read(spark)) == rows(store.upsert(base, updates))
    assert [r.payload for r in files.load(spark, "k1").collect()] == ["later"] and files.load(spark, "absent").collect() == []
    assert files.upsert(updates.limit(0)) == [] and listed() == after


def two_schemas(spark):
    tables = spark.createDataFrame([("a", "t", 1.0, 2.0, "first"), ("b", "t", 3.0, 4.0, None)], "table_schema string, table_name string, x double, y double, comment string")
    columns = spark.createDataFrame(
        [("a", "t", 1, "id", "BIGINT", False, True, None, None), ("b", "t", 1, "id", "INT", True, False, "1", "c"), ("b", "t", 2, "t_id", "INT", True, False, None, None)],
        "table_schema string, table_name string, position bigint, column_name string, data_type string, nullable boolean, autoincrement boolean, default string, comment string",
    )
    relations = spark.createDataFrame([("b", "t", "t_id", "a", "t", "id")], "child_schema string, child string, child_column string, parent_schema string, parent string, parent_column string")
    keys = spark.createDataFrame([("a", "t", 1, "pk", "PRIMARY", 1, "id"), ("b", "t", 1, "pk", "PRIMARY", 2, "id"), ("b", "t", 1, "pk", "PRIMARY", 1, "t_id")], "table_schema string, table_name string, key_position bigint, key_name string, key_type string, part bigint, column_name string")
    return Design(tables, columns, relations, keys)


def test_two_schemas_in_a_design(spark, tmp_path):
    design = two_schemas(spark)
    write_design(design, str(tmp_path / "out"))
    back, named = read_design(spark, str(tmp_path / "out")), one_name(design)
    for part in ("tables", "columns", "relations", "keys"):
        assert rows(getattr(back, part)) == rows(getattr(named, part).select(*getattr(back, part).columns))
    assert rows(back.relations) == [("b.t", "t_id", "a.t", "id")]


def test_a_design_meets_in_one_shuffle_by_table(spark):
    plan = plan_of(design_elements(two_schemas(spark)))
    assert plan.count("Exchange hashpartitioning(table_name") == 1 and "Join" not in plan


def test_a_design_is_dealt_out_before_it_is_collected(spark):
    plan = plan_of(design_elements(two_schemas(spark)))
    assert "collect_list" not in plan[plan.index("Exchange hashpartitioning(table_name") :]


def test_degrees_of_a_design_count_distinct_links(spark):
    pairs = [("a", "b"), ("a", "b"), ("a", "a"), ("b", "a"), ("c", "b"), ("a", "gone"), ("d", None)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    tables = spark.createDataFrame([(n,) for n in "abcde"], "table_name string").select("table_name", *[F.lit(None).cast(t).alias(c) for c, t in (("x", "double"), ("y", "double"), ("comment", "string"))])
    relations = edges.select(F.col("src").alias("child"), F.lit("c").alias("child_column"), F.col("dst").alias("parent"), F.lit("id").alias("parent_column"))
    empty = two_schemas(spark)
    design = Design(tables, empty.columns.drop("table_schema").limit(0), relations, empty.keys.drop("table_schema").limit(0))
    got = {r._name: r.degree for r in design_elements(design).select("_name", "degree").collect()}
    assert got == {n: d for n, d in {r.node: r.degree for r in graph.degrees(edges).collect()}.items() if n in set("abcd")} | {"e": 0}


def test_a_compressed_design_reads_the_same(spark, tmp_path):
    design = two_schemas(spark)
    write_design(design, str(tmp_path / "plain"))
    write_design(design, str(tmp_path / "packed"), compression="gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / "packed").glob("part-*"))
    plain, packed = (read_design(spark, str(tmp_path / n)) for n in ("plain", "packed"))
    for part in ("tables", "columns", "relations", "keys"):
        assert rows(getattr(packed, part)) == rows(getattr(plain, part))


def test_relations_over_schemas(spark):
    design = two_schemas(spark)
    bare = design.relations.drop("child_schema", "parent_schema")
    assert resolved(design.relations, design.columns).count() == 1 and dangling(design.relations, design.columns).count() == 0
    assert dangling(design.relations, design.columns.where("table_schema = 'b'")).count() == 1
    assert foreign_key_mismatches(design.relations, design.columns).first().expected_type == "BIGINT"
    assert resolved(bare, design.columns).count() == 1
    ids = spark.createDataFrame([("a.b", "c"), ("a", "b.c"), ("a", "t`")], "s string, t string")
    assert sorted(r[0] for r in ids.select(table_id(F.col("s"), F.col("t"))).collect()) == ["`a.b`.c", "a.`b.c`", "a.`t```"]
    assert by_table_id(bare).columns == bare.columns


def test_a_path_over_schemas(spark):
    edges = [(1, "x", "t", "u_id", "x", "u", "id"), (2, "y", "t", "u_id", "y", "u", "id"), (3, "y", "u", "all_id", "z", "t", "id"), (4, "x", "u", "all_id", "z", "t", "id")]
    fk = spark.createDataFrame(edges, "edge_ord bigint, child_schema string, child string, child_column string, parent_schema string, parent string, parent_column string")
    steps = sorted(tuple(r) for r in join_path_plan(relations_as_edges(fk), "x.t", "y.t").select("step", "table_name").collect())
    assert steps == [(0, "x.t"), (1, "x.u"), (2, "z.t"), (3, "y.u"), (4, "y.t")]
    u = spark.createDataFrame([(1, 7)], "id int, all_id int")
    tables = {"x.t": spark.createDataFrame([(1, "xt")], "u_id int, n string"), "x.u": u, "y.u": u, "z.t": spark.createDataFrame([(7,)], "id int"), "y.t": spark.createDataFrame([(1, "yt")], "u_id int, n string")}
    assert [(r.t0__n, r.t4__n) for r in join_path(tables, fk, "x.t", "y.t").collect()] == [("xt", "yt")]
