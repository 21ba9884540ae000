"""Inputs that the given tables don't hold."""

import datetime

import pytest

from keyweave.functions.text import parse_type
from keyweave.functions.types import known_type, map_types, spark_type
from keyweave.lineage import cut_observed
from keyweave.operators import graph, importing
from keyweave.operators.boxes import overlap_areas, overlap_counts, select_boxes
from keyweave.operators.checks import check_foreign_key, orphan_rows
from keyweave.operators.conform import DeclaredColumn, conform
from keyweave.operators.search import search_values
from keyweave.operators.store import upsert
from keyweave.sources.catalog_files import build_index

BOX = "id string, x double, y double, width double, height double"


def test_long_chain_clusters_in_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []

    def counting(df, label, **figures):
        rounds.append(label)
        return cut_observed(df, label, **figures)

    monkeypatch.setattr(graph, "cut_observed", counting)
    edges = spark.createDataFrame([(f"n{i:05d}", f"n{i + 1:05d}") for i in range(n)], "src string, dst string")
    rows = {r.node: r for r in graph.hub_clusters(edges).collect()}
    # Main nodes are 1 to n - 1; the last of them is the first hub, and every second one below it.
    for i in range(1, n):
        expected = "hub" if (n - 1 - i) % 2 == 0 else "member"
        assert rows[f"n{i:05d}"].role == expected
    assert rounds.count("taken") <= 3 and rounds.count("pointers") <= 16


def test_boxes_with_fractions_and_repeated_ids(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 0.00002, 1.0), ("b", 0.00001, 0.0, 0.00002, 1.0), ("b", 1e11, 0.0, 1.0, 1.0)], BOX)
    assert sorted((r.id, r.overlaps) for r in overlap_counts(boxes).collect()) == [("a", 1), ("b", 0), ("b", 1)]
    near = spark.createDataFrame([("a", 0.0, 0.0, 0.5, 0.5), ("b", 0.25, 0.25, 0.5, 0.5)], BOX)
    assert {r.id: r.area for r in overlap_areas(near).collect()} == pytest.approx({"a": 0.0625, "b": 0.0625})


def test_select_boxes_at_the_edges(spark):
    rows = [("left", 0, 10), ("touches", 0, 20), ("far", 80, 10), ("inside", 30, 10), ("spans", 0, 100), ("ends at far", 0, 80), ("from near", 20, 60)]
    boxes = spark.createDataFrame([(n, float(x), 0.0, float(w), 1.0) for n, x, w in rows], BOX)
    found = {r.id for r in select_boxes(boxes, 20, -1, 60, 5).collect()}
    assert found == {"touches", "inside", "spans", "from near"}


def test_samples_of_a_table_with_a_column_name_column(spark):
    df = spark.createDataFrame([(1, "x1", "t"), (1, "x2", "t")], "k int, column_name string, other string")
    found = search_values(df, "x", key=["k"])
    assert found.sample_rows.columns == ["_column_name", "k", "column_name", "other"]
    assert sorted(r.column_name for r in found.sample_rows.collect()) == ["x1", "x2"]
    assert {r.column_name for r in found.samples.collect()} == {"column_name"}


def test_null_time_is_oldest(spark):
    schema, t = "key string, payload string, dt timestamp_ntz", datetime.datetime(2024, 1, 1)
    store = spark.createDataFrame([("a", "old", None), ("b", "old", t), ("c", "old", t), ("d", "old", None)], schema)
    updates = spark.createDataFrame([("a", "new", t), ("b", "new", None), ("d", "new", None), ("e", "new", None)], schema)
    assert {r.key: r.payload for r in upsert(store, updates).collect()} == {"a": "new", "b": "old", "c": "old", "d": "new", "e": "new"}


def test_repeated_parent_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "c int")
    parent = spark.createDataFrame([(1,)] * 50, "p int")
    found = check_foreign_key(child, parent, ["c"], ["p"])
    assert [tuple(r) for r in found.collect()] == [(2, 2)]
    assert [r.c for r in orphan_rows(child, parent, ["c"], ["p"]).collect()] == [2, 2]


def test_types_with_suffix(spark):
    assert spark_type("mysql", "int(10) unsigned") == "BIGINT"
    assert spark_type("mysql", "bigint unsigned") == "DECIMAL(20,0)"
    assert spark_type("mysql", "tinyint(3) unsigned zerofill") == "SMALLINT"
    assert spark_type("mysql", "bit(8)") == "BINARY" and spark_type("mysql", "bit(1)") == "BOOLEAN"
    assert spark_type("postgresql", "timestamp(3) with time zone") == "TIMESTAMP"
    with pytest.raises(ValueError):
        known_type("mysql", "nonsense")
    rows = spark.createDataFrame([("int(10) unsigned",), ("bit(8)",), ("longtext",), ("nonsense",)], "data_type string")
    found = {r.data_type: (r.spark_type, r.mapped) for r in map_types(rows, "mysql").collect()}
    assert found["int(10) unsigned"] == ("BIGINT", True) and found["bit(8)"] == ("BINARY", True)
    assert found["longtext"] == ("STRING", True) and not found["nonsense"][1]
    parsed = rows.select(parse_type(rows["data_type"]).alias("t")).collect()[0].t
    assert (parsed.name, parsed.size) == ("INT UNSIGNED", "10")


def test_conform_rejects_what_a_cast_changes(spark):
    df = spark.createDataFrame([(1, 12.999, "9.99", "abc"), (2, 12.0, "9.9", "ab"), (3, None, None, None)], "k int, a double, b string, c string")
    declared = [DeclaredColumn("k", "INTEGER"), DeclaredColumn("a", "INTEGER"), DeclaredColumn("b", "DECIMAL(3,1)"), DeclaredColumn("c", "VARCHAR(2)")]
    made = conform(df, declared)
    assert [r.k for r in made.rows.orderBy("k").collect()] == [2, 3]
    assert made.rejects.collect()[0].failed_columns == ["a", "b", "c"]
    assert conform(df, declared, lossy=True).rows.count() == 3
    with pytest.raises(ValueError):
        conform(df, [DeclaredColumn("k", "NONSENSE")])
    assert DeclaredColumn("e", "ENUM('v2','v10')").size == [] and DeclaredColumn("d", "DECIMAL( 5 , 2 )").size == [5, 2]


@pytest.mark.parametrize("name", ["data", "my data", "a+b%20c"])
def test_index_root(spark, tmp_path, name):
    root = tmp_path / name / "project" / name
    (root / "one" / name).mkdir(parents=True)
    (root / "one" / name / "columns.csv").write_text("s,t,c,int,,YES\n")
    (root / "columns.csv").write_text("s,t,skipped,int,,YES\n")
    assert [(r.source_schema, r.column_name) for r in build_index(spark, str(root)).collect()] == [("one", "c")]


def test_keys_of_equal_tables_in_two_schemas(spark):
    rows = [("s1", "t", "PRIMARY", "id"), ("s2", "t", "PRIMARY", "key")]
    schema = "table_schema string, table_name string, index_name string, column_name string"
    statistics = spark.createDataFrame(rows, schema).selectExpr("*", "0 AS non_unique", "'BTREE' AS index_type", "1 AS seq_in_index")
    found = importing.import_keys(statistics).collect()
    assert sorted((r.table_schema, r.key_name, r.part, r.column_name) for r in found) == [("s1", "PRIMARY", 1, "id"), ("s2", "PRIMARY", 1, "key")]
