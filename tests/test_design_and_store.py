import datetime

import pytest

from keyweave.operators import store
from keyweave.plans.design import design_from_keys, import_catalog, import_catalog_pg
from keyweave.sources import design_xml
from keyweave.sources.design_xml import read_design, write_design

XML = """<?xml version="1.0" encoding="utf-8"?>
<sql>
  <table x="10" y="20" name="Product">
    <row name="id" null="0" autoincrement="1"><datatype>INTEGER</datatype><default>NULL</default></row>
    <row name="id_Producer" null="1" autoincrement="0"><datatype>INTEGER</datatype><datatype>TEXT</datatype>
      <relation table="Producer" row="id" /><relation table="Other" row="key" /><comment>who &amp; what</comment></row>
    <row null="1"><datatype>INTEGER</datatype></row>
    <key type="PRIMARY" name="pk"><part>id</part></key>
    <key name="both"><part>id</part><part>id_Producer</part></key>
    <comment>a table</comment>
  </table>
  <table x="1" y="2" name="Producer"><row name="id"><datatype>INTEGER</datatype></row></table>
  <table x="1" y="2"><row name="id"><datatype>INTEGER</datatype></row></table>
</sql>
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def design(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("design") / "shop.xml"
    path.write_text(XML)
    return read_design(spark, str(path))


def test_read(design):
    assert rows(design.tables) == [("Producer", 1.0, 2.0, None), ("Product", 10.0, 20.0, "a table")]
    assert rows(design.columns) == [
        ("Producer", 1, "id", "INTEGER", False, False, None, None),
        ("Product", 1, "id", "INTEGER", False, True, "NULL", None),
        ("Product", 2, "id_Producer", "INTEGER", True, False, None, "who & what"),
    ]
    assert rows(design.relations) == [("Product", "id_Producer", "Other", "key"), ("Product", "id_Producer", "Producer", "id")]
    assert rows(design.keys) == [
        ("Product", 1, "pk", "PRIMARY", 1, "id"), ("Product", 2, "both", "INDEX", 1, "id"), ("Product", 2, "both", "INDEX", 2, "id_Producer"),
    ]


def test_round_trip(spark, design, tmp_path):
    write_design(design, str(tmp_path / "out"))
    back = read_design(spark, str(tmp_path / "out"))
    for name in ("tables", "columns", "relations", "keys"):
        assert rows(getattr(back, name)) == rows(getattr(design, name))


def test_design_from_key_files(spark, tmp_path):
    primary = spark.createDataFrame([("Lines", "No", 2), ("Lines", "OrderId", 1)], "table_name string, column_name string, key_order int")
    foreign = spark.createDataFrame([("Lines", "OrderId", "Orders", "Id"), ("Lines", "ItemId", "Items", "Id")], "child string, child_column string, parent string, parent_column string")
    made = design_from_keys(primary, foreign)
    assert rows(made.columns.select("table_name", "position", "column_name", "autoincrement")) == [
        ("Items", 1, "Id", False), ("Lines", 1, "OrderId", True), ("Lines", 2, "No", True), ("Lines", 3, "ItemId", False), ("Orders", 1, "Id", False),
    ]
    write_design(made, str(tmp_path / "keys"))
    back = read_design(spark, str(tmp_path / "keys"))
    assert rows(back.relations) == rows(made.relations) and rows(back.columns) == rows(made.columns)
    assert [(r.key_type, r.part, r.column_name) for r in back.keys.orderBy("part").collect()] == [("PRIMARY", 1, "OrderId"), ("PRIMARY", 2, "No")]
    # Tables come with the most connected one first.
    text = "".join(p.read_text() for p in sorted((tmp_path / "keys").glob("part-*")))
    assert text.index('name="Lines"') < text.index('name="Items"')


def frame(spark, columns, *data):
    return spark.createDataFrame(list(data), columns)


def test_import_of_a_mysql_catalogue(spark):
    made = import_catalog(
        frame(spark, "table_schema string, table_name string, table_comment string", ("s", "t", "mine"), ("s", "p", "")),
        frame(
            spark,
            "table_name string, column_name string, ordinal_position int, column_type string, is_nullable string, column_default string, extra string, column_comment string",
            ("t", "id", 1, "int(11)", "NO", None, "auto_increment", "the key"), ("t", "pid", 2, "int(11)", "YES", "NULL", "", ""),
        ),
        frame(
            spark,
            "table_schema string, table_name string, constraint_name string, column_name string, referenced_table_name string, referenced_column_name string",
            ("s", "t", "fk", "pid", "p", "id"), ("s", "t", "PRIMARY", "id", None, None),
        ),
        frame(spark, "table_schema string, table_name string, constraint_name string, constraint_type string", ("s", "t", "fk", "FOREIGN KEY"), ("s", "t", "PRIMARY", "PRIMARY KEY")),
        frame(
            spark,
            "table_name string, index_name string, non_unique int, index_type string, seq_in_index int, column_name string",
            ("t", "PRIMARY", 0, "BTREE", 1, "id"), ("t", "by_pid", 1, "BTREE", 1, "pid"), ("t", "by_pid", 1, "BTREE", 2, "id"),
        ),
    )
    assert rows(made.tables) == [("p", None, None, None), ("t", None, None, "mine")]
    assert rows(made.columns) == [("t", 1, "id", "INT(11)", False, True, None, "the key"), ("t", 2, "pid", "INT(11)", True, False, "", None)]
    assert rows(made.relations) == [("t", "pid", "p", "id")]
    assert rows(made.keys.select("key_position", "key_name", "key_type", "part", "column_name")) == [
        (1, "PRIMARY", "PRIMARY", 1, "id"), (2, "by_pid", "INDEX", 1, "pid"), (2, "by_pid", "INDEX", 2, "id"),
    ]


def test_import_of_a_postgresql_catalogue(spark):
    used = "constraint_schema string, constraint_name string, ordinal_position int, table_name string, column_name string"
    made = import_catalog_pg(
        frame(spark, "oid int, relname string, relkind string", (1, "t", "r"), (2, "pg_x", "r"), (9, "by_b", "i")),
        frame(spark, "oid int, comment string", (1, "mine")),
        frame(
            spark,
            "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string",
            ("t", "a", 1, "integer", "NO", None), ("pg_x", "z", 1, "oid", "NO", None),
        ),
        frame(spark, "constraint_schema string, constraint_name string, table_name string, constraint_type string", ("s", "pk", "t", "PRIMARY KEY"), ("s", "fk", "t", "FOREIGN KEY"), ("s", "c", "t", "CHECK")),
        frame(spark, used, ("s", "pk", 1, "t", "a"), ("s", "fk", 1, "t", "b")),
        frame(spark, used, ("s", "fk", 1, "p", "id")),
        frame(spark, "indexrelid int, indrelid int, indkey array<int>, indisunique boolean, indisprimary boolean", (9, 1, [2], False, False)),
        frame(spark, "attrelid int, attnum int, attname string", (1, 2, "b")),
    )
    assert rows(made.tables) == [("t", None, None, "mine")]
    assert rows(made.columns) == [("t", 1, "a", "INTEGER", False, False, None, None)]
    assert rows(made.relations) == [("t", "b", "p", "id")]
    assert rows(made.keys.select("key_position", "key_name", "key_type", "part", "column_name")) == [(1, "by_b", "INDEX", 1, "b"), (2, "pk", "PRIMARY", 1, "a")]


def day(n):
    return datetime.datetime(2024, 1, n)


def versions(spark, data):
    return spark.createDataFrame(data, "key string, payload string, dt timestamp_ntz, seq int")


def test_latest_version_wins_and_ties_are_broken(spark):
    df = versions(spark, [("a", "old", day(1), 1), ("a", "new", day(2), 1), ("b", "first", day(1), 1), ("b", "second", day(1), 2)])
    assert rows(store.latest(df, "seq")) == [("a", "new", day(2)), ("b", "second", day(1))]


def test_upsert_is_idempotent(spark):
    base = versions(spark, [("a", "old", day(1), 1), ("b", "kept", day(5), 1)]).drop("seq")
    updates = versions(spark, [("a", "new", day(2), 1), ("b", "late", day(4), 1), ("c", "added", day(1), 1)])
    once = store.upsert(base, updates, "seq")
    assert rows(once) == [("a", "new", day(2)), ("b", "kept", day(5)), ("c", "added", day(1))]
    assert rows(store.upsert(once, updates, "seq")) == rows(once)


def test_list_and_load(spark):
    df = versions(spark, [("a", "x", day(1), 1), ("b", "y", day(3), 1), ("c", "z", day(3), 1)])
    assert [tuple(r) for r in store.list_keys(df).collect()] == [("b", "03-January-2024 00:00"), ("c", "03-January-2024 00:00"), ("a", "01-January-2024 00:00")]
    assert rows(store.load(df, "b").select("payload")) == [("y",)] and store.load(df, "nope").count() == 0
