import pytest
from pyspark.sql import functions as F

from keyweave.operators import catalog, importing, keys
from keyweave.sources import catalog_files as files
from keyweave.sources.live import catalog_of


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    write = lambda path, text: (path.parent.mkdir(parents=True, exist_ok=True), path.write_bytes(text))
    write(root / "shop/columns.csv", b"Table_Schema,TABLE_NAME,COLUMN_NAME,DATA_TYPE\ndbo, Orders ,Id,int\ndbo,Orders,\ndbo,Orders\n\n,,\ndbo,\"Order, old\",Id,int\n")
    write(root / "shop/deep/er/columns.csv", b"dbo\tOrders\tId\tint\ndbo\tOrders\tName, full\tnvarchar\ndbo\tBad\xff\tX\tint\n")
    write(root / "Art/columns.csv", b"dbo,Orders,Id,int\ndbo,Orders,Id,int\n")
    write(root / "columns.csv", b"skip,me,please\n")
    write(root / "art keys/keys-primary.csv", "﻿TableName\tColumnName\tKeyOrder\nOrders\tId\t1\nLines\tOrderId\t1\nLines\tNo\t2\n".encode())
    write(root / "art keys/keys-foreign.csv", "﻿ReferencedTable\tParentTable\tParentColumn\tReferencedColumn\nOrders\tLines\tOrderId\tId\n".encode())
    write(root / "old/primary_keys.csv", b"TableName\tColumnName\tKeyOrder\n")
    write(root / "old/foreign_keys.csv", b"ParentTable\n")
    write(root / "half/keys-primary.csv", b"TableName\n")
    return str(root)


def test_delimiters(spark, root):
    found = {r.path.split("/data0/")[-1]: r.sep for r in files.detect_delimiters(spark, root, "columns.csv").collect()}
    assert found == {"shop/columns.csv": ",", "shop/deep/er/columns.csv": "\t", "Art/columns.csv": ",", "columns.csv": ","}


def test_a_tie_is_a_tab(spark):
    df = spark.createDataFrame([("a,b\tc\n,,,",), ("plain",), ("a,b,c\td",)], "t string")
    from keyweave.functions.text import delimiter_of

    assert [r.s for r in df.select(delimiter_of(F.col("t")).alias("s")).collect()] == ["\t", "\t", ","]


def test_columns(spark, root):
    shop = files.read_columns(spark, f"{root}/shop")
    assert rows(shop.select("table_schema", "table_name", "column_name", "data_type")) == [
        ("dbo", "Bad�", "X", "int"), ("dbo", "Order, old", "Id", "int"), ("dbo", "Orders", "Id", "int"),
        ("dbo", "Orders", "Id", "int"), ("dbo", "Orders", "Name, full", "nvarchar"),
    ]


def test_index_has_the_first_folder_as_source(spark, root):
    index = files.build_index(spark, root)
    assert rows(index.select("source_schema", "table_name", "column_name", "data_type")) == [
        ("Art", "Orders", "Id", "int"), ("shop", "Bad�", "X", "int"), ("shop", "Order, old", "Id", "int"),
        ("shop", "Orders", "", ""), ("shop", "Orders", "Id", "int"), ("shop", "Orders", "Name, full", "nvarchar"),
    ]


def test_index_write_and_read(spark, root, tmp_path):
    files.write_index(files.build_index(spark, root), str(tmp_path / "index.csv"))
    back = files.read_index(spark, str(tmp_path / "index.csv"), "part-*")
    assert [(r.source_schema, r.table_name, r.column_name) for r in back.collect()] == [
        ("Art", "Orders", "Id"), ("shop", "Bad�", "X"), ("shop", "Order, old", "Id"), ("shop", "Orders", "Id"), ("shop", "Orders", "Name, full"),
    ]


def test_key_files(spark, root):
    assert rows(files.read_primary_keys(spark, f"{root}/art keys/keys-primary.csv")) == [("Lines", "No", 2), ("Lines", "OrderId", 1), ("Orders", "Id", 1)]
    assert rows(files.read_foreign_keys(spark, f"{root}/art keys/keys-foreign.csv")) == [("Lines", "OrderId", "Orders", "Id")]


def test_datasets(spark, root):
    assert [r.dataset for r in files.find_datasets(spark, root).collect()] == ["Art", "shop"]
    assert [tuple(r) for r in files.find_datasets(spark, root, "keys").collect()] == [
        ("art keys", ["keys-primary.csv", "keys-foreign.csv"]), ("old", ["primary_keys.csv", "foreign_keys.csv"]),
    ]


def test_live_catalog(spark):
    found = catalog_of(spark, {"t": spark.range(1).select("id", F.lit("x").alias("v"))})
    assert rows(found) == [("t", "id", 1, "bigint", False), ("t", "v", 2, "string", False)]


@pytest.fixture(scope="module")
def index(spark):
    data = [("S", "dbo", "Orders", "UserId"), ("s", "dbo", "orders", "userid"), ("a", "x", "People", "User_ID"), ("a", "x", "People", "Name")]
    return spark.createDataFrame(data, "source_schema string, table_schema string, table_name string, column_name string")


def test_find_and_refine(index):
    found = catalog.find_columns(index, "SERID").orderBy("position").collect()
    assert [(r.position, r.qualified_name) for r in found] == [(1, "S.dbo.Orders.UserId"), (2, "s.dbo.orders.userid")]
    assert rows(catalog.refine(index, ["x-p", "ID"]).select("column_name")) == [("User_ID",)]
    assert [r.qualified_name for r in catalog.find_tables(index, "PEOP").collect()] == ["a.x.People"]


def test_merge_related_and_lists(spark, index):
    assert catalog.merge_catalogs([index, index, index.drop("source_schema")]).count() == 8
    relations = spark.createDataFrame([("Orders", "People")], "child string, parent string")
    assert catalog.related_only(index, relations).count() == 3
    ordered = index.withColumn("ordinal", F.length("column_name"))
    listed = catalog.columns_per_table(ordered).where("table_name = 'People'")
    assert rows(listed.select("position", "column_name")) == [(1, "Name"), (2, "User_ID")]
    assert ("userid", "dbo", "orders") in rows(catalog.tables_per_column(index))


def test_relations_with_and_without_their_columns(spark):
    columns = spark.createDataFrame([("a", "id", "SERIAL"), ("b", "a_id", "int"), ("c", "a_id", "INTEGER"), ("d", "s", "CHAR(3)"), ("e", "s", "CHAR(4)")], "table_name string, column_name string, data_type string")
    relations = spark.createDataFrame(
        [("b", "a_id", "a", "id"), ("c", "a_id", "a", "id"), ("b", "gone", "a", "id"), ("b", "a_id", "x", "id"), ("x", "y", "x", "z"), ("d", "s", "e", "s")],
        "child string, child_column string, parent string, parent_column string",
    )
    assert keys.resolved(relations, columns).count() == 3
    assert rows(keys.dangling(relations, columns)) == [("b", "a_id", "x", "id"), ("b", "gone", "a", "id"), ("x", "y", "x", "z")]
    wrong = keys.foreign_key_mismatches(relations, columns).select("child", "child_type", "expected_type")
    assert rows(wrong) == [("b", "int", "INTEGER"), ("d", "CHAR(3)", "CHAR(4)")]


def test_columns_of_a_catalogue(spark):
    raw = spark.createDataFrame(
        [("t", "a", 1, "int(11)", "NO", None, "AUTO_INCREMENT"), ("t", "b", 2, "binary(2)", "YES", "ab", ""), ("t", "c", 3, "numeric(8,0)", "YES", "NULL", None)],
        "table_name string, column_name string, ordinal_position int, column_type string, is_nullable string, column_default string, extra string",
    )
    assert rows(importing.import_columns(raw)) == [
        ("t", 1, "a", "INT(11)", 0, 1, None), ("t", 2, "b", "BINARY(2)", 1, 0, "6162"), ("t", 3, "c", "NUMERIC(8)", 1, 0, ""),
    ]


def test_constraint_names_of_two_schemas_stay_apart(spark):
    constraints = spark.createDataFrame([("s1", "t", "fk", "FOREIGN KEY"), ("s2", "t", "fk", "UNIQUE")], "table_schema string, table_name string, constraint_name string, constraint_type string")
    usage = spark.createDataFrame(
        [("s1", "t", "fk", "a", "p", "id"), ("s2", "t", "fk", "b", None, None)],
        "table_schema string, table_name string, constraint_name string, column_name string, referenced_table_name string, referenced_column_name string",
    )
    assert rows(importing.import_relations(usage, constraints)) == [("fk", "t", "a", "p", "id")]


def test_parts_of_a_wide_key_are_paired(spark):
    constraints = spark.createDataFrame([("s", "fk", "t", "FOREIGN KEY")], "constraint_schema string, constraint_name string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("s", "fk", 1, "t", "a"), ("s", "fk", 2, "t", "b")], "constraint_schema string, constraint_name string, ordinal_position int, table_name string, column_name string")
    used = spark.createDataFrame([("s", "fk", 1, "p", "x"), ("s", "fk", 2, "p", "y")], "constraint_schema string, constraint_name string, ordinal_position int, table_name string, column_name string")
    assert rows(importing.import_relations_pg(constraints, usage, used)) == [("fk", "t", "a", "p", "x"), ("fk", "t", "b", "p", "y")]


def test_keys_of_catalogues(spark):
    statistics = spark.createDataFrame(
        [("t", "PRIMARY", 0, "BTREE", 2, "b"), ("t", "PRIMARY", 0, "BTREE", 1, "a"), ("t", "ft", 1, "FULLTEXT", 1, "c"), ("t", "u", 0, "BTREE", 1, "d"), ("t", "i", 1, "BTREE", 1, "e")],
        "table_name string, index_name string, non_unique int, index_type string, seq_in_index int, column_name string",
    )
    assert rows(importing.import_keys(statistics).select("key_name", "key_type", "part", "column_name")) == [
        ("PRIMARY", "PRIMARY", 1, "a"), ("PRIMARY", "PRIMARY", 2, "b"), ("ft", "FULLTEXT", 1, "c"), ("i", "INDEX", 1, "e"), ("u", "UNIQUE", 1, "d"),
    ]
    constraints = spark.createDataFrame(
        [("s", "pk", "t", "PRIMARY KEY"), ("s", "1_not_null", "t", "CHECK"), ("s", "fk", "t", "FOREIGN KEY"), ("s", "u", "t", "UNIQUE")],
        "constraint_schema string, constraint_name string, table_name string, constraint_type string",
    )
    usage = spark.createDataFrame([("s", "pk", 1, "a"), ("s", "fk", 1, "b")], "constraint_schema string, constraint_name string, ordinal_position int, column_name string")
    assert rows(importing.import_keys_pg(constraints, usage)) == [("t", "pk", "PRIMARY", 1, "a"), ("t", "u", "UNIQUE", None, None)]
    assert importing.drop_not_null_checks(constraints).count() == 3


def test_one_unique_index_does_not_hide_the_others(spark):
    indexes = spark.createDataFrame([(11, 1, [2], True, False), (12, 1, [3, 1], False, False)], "indexrelid int, indrelid int, indkey array<int>, indisunique boolean, indisprimary boolean")
    classes = spark.createDataFrame([(1, "t"), (11, "u"), (12, "i")], "oid int, relname string")
    attributes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "attrelid int, attnum int, attname string")
    assert rows(importing.import_index_columns(indexes, classes, attributes)) == [("t", "i", "INDEX", 1, "c"), ("t", "i", "INDEX", 2, "a")]


def test_system_objects_are_left_out(spark):
    classes = spark.createDataFrame([(1, "pg_x", "r"), (2, "t", "r"), (3, "v", "v"), (4, "sql_y", "r")], "oid int, relname string, relkind string")
    comments = spark.createDataFrame([(2, "mine")], "oid int, comment string")
    assert rows(importing.import_tables(classes, comments)) == [("t", "mine")]
    names = spark.createDataFrame([("a", "CLASS", "NO"), ("b", "VCLASS", "NO"), ("c", "CLASS", "YES")], "class_name string, class_type string, is_system_class string")
    assert rows(importing.import_class_names(names)) == [("a",)]
