import datetime

from pyspark.sql import functions as F

from keyweave.functions.types import DIALECT_TYPES, map_types, spark_type
from keyweave.operators import checks
from keyweave.operators.conform import DeclaredColumn, assign_ids, check_length, conform, fill_defaults
from keyweave.plans.check_report import ForeignKey, TableRules, check_all


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_primary_key_and_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d"), (2, None)], "k int, v string")
    assert rows(checks.check_primary_key(df, ["k"])) == [(1, 2), (2, 2), (None, 1)]
    assert rows(checks.check_unique(df, ["v"])) == [("a", 2)]
    assert rows(checks.check_unique(df, ["k", "v"])) == [(1, "a", 2)]
    assert rows(checks.check_primary_key(df, ["v"])) == [("a", 2), (None, 2)]
    assert rows(checks.check_primary_key(df, ["k", "v"])) == [(1, "a", 2), (2, None, 2), (None, "d", 1)]


def test_texts_are_picked_by_hash_before_they_are_grouped(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = checks.check_unique(df, ["text"])._jdf.queryExecution().executedPlan().toString()
    first = plan.index("Exchange hashpartitioning(text")
    assert plan.index("LeftSemi") > first and "Exchange hashpartitioning(_hash" in plan


def test_not_null_in_one_scan(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "x")], "a int, b string")
    assert rows(checks.check_not_null(df, ["a", "b"])) == [("a", 1), ("b", 2)]


def test_foreign_key_passes_null_and_counts_orphans(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (9, 9), (9, 9)], "a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert rows(checks.check_foreign_key(child, parent, ["a", "b"], ["x", "y"])) == [(1, 2, 1), (9, 9, 2)]
    assert rows(checks.orphan_rows(child, parent, ["a", "b"], ["x", "y"])) == [(1, 2), (9, 9), (9, 9)]


def test_foreign_key_shuffles_the_child_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        child = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
        parent = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
        checked = checks.check_foreign_key(child, parent, ["user_id"], ["c_custkey"])
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(user_id") == 1
        assert plan.count("Exchange hashpartitioning(") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unreferenced_parents(spark):
    parent = spark.createDataFrame([(1,), (2,)], "x int")
    child = spark.createDataFrame([(1,), (1,), (None,)], "a int")
    assert rows(checks.unreferenced_parents(parent, child, ["x"], ["a"])) == [(2,)]


def test_report(spark):
    tables = {
        "p": spark.createDataFrame([(1, "ab"), (1, None)], "id int, name string"),
        "c": spark.createDataFrame([(1,), (5,), (None,)], "pid int"),
    }
    design = {
        "p": TableRules(["id"], unique=[["name"]], not_null=["name"], sized=[DeclaredColumn("name", "VARCHAR(1)")]),
        "c": TableRules(foreign_keys=[ForeignKey(["pid"], "p", ["id"])]),
    }
    assert rows(check_all(tables, design)) == [
        ("c", "foreign key", "pid", 1), ("p", "length", "name", 1), ("p", "not null", "name", 1),
        ("p", "primary key", "id", 1), ("p", "unique", "name", 0),
    ]


def test_conform_splits_rows_and_rejects(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "x"), ("b", "2024-01-03", "y"), (None, "no", "z")], "n string, d string, t string")
    declared = [DeclaredColumn("d", "DATE"), DeclaredColumn("n", "INT"), DeclaredColumn("t", "VARCHAR(3)")]
    out = conform(df, declared)
    assert rows(out.rows) == [(datetime.date(2024, 1, 2), 1, "x")]
    assert out.rows.columns == ["d", "n", "t"]
    assert rows(out.rejects) == [("b", "2024-01-03", "y", ["n"]), (None, "no", "z", ["d"])]


def test_length_and_scale(spark):
    df = spark.createDataFrame([("abc", "12.345"), ("ab", "12.3"), (None, None), ("a", "12345.1")], "s string, n string")
    declared = [DeclaredColumn("s", "VARCHAR(2)"), DeclaredColumn("n", "DECIMAL(5,2)")]
    assert rows(check_length(df, declared)) == [("n", "DECIMAL(5,2)", 2), ("s", "VARCHAR(2)", 1)]
    assert rows(check_length(df, [DeclaredColumn("s", "MEDIUMTEXT")])) == []


def test_defaults(spark):
    df = spark.createDataFrame([(1, None, None)], "a int, b int, c string")
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    declared = [
        DeclaredColumn("a", "INT", nullable=False, default="9"),
        DeclaredColumn("b", "INT", nullable=False, default="9"),
        DeclaredColumn("c", "VARCHAR(9)", nullable=False),
        DeclaredColumn("d", "VARCHAR(9)", default="NULL"),
        DeclaredColumn("e", "DATETIME", default="current_timestamp"),
    ]
    assert rows(fill_defaults(df, declared, now=now)) == [(1, 9, "", None, now)]


def test_ids_continue_and_start_at_one(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert rows(assign_ids(df, "id", [F.col("k")])) == [("a", 1), ("b", 2), ("c", 3)]
    existing = spark.createDataFrame([(41,)], "id bigint")
    assert rows(assign_ids(df, "id", [F.col("k")], existing)) == [("a", 42), ("b", 43), ("c", 44)]
    assert rows(assign_ids(df, "id", [F.desc("k")], existing.limit(0))) == [("a", 3), ("b", 2), ("c", 1)]


def test_types(spark):
    assert spark_type("postgresql", "SERIAL") == "INT"
    assert spark_type("mssql", "TinyInt") == "SMALLINT"
    assert spark_type("mysql", "decimal(12, 2)") == "DECIMAL(12,2)"
    assert spark_type("mysql", "DECIMAL") == "DECIMAL(38,18)"
    assert spark_type("postgresql", "REAL") == "FLOAT"
    assert spark_type("mysql", "NO SUCH TYPE") == "STRING"
    df = spark.createDataFrame([("varchar(20)",), ("numeric(10,2)",), ("int2",)], "data_type string")
    assert rows(map_types(df, "postgresql")) == [
        ("int2", "STRING", False), ("numeric(10,2)", "DECIMAL(10,2)", True), ("varchar(20)", "STRING", True),
    ]


def test_every_type_is_known_to_spark(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        for dialect, names in DIALECT_TYPES.items():
            for name in names:
                spark.range(1).select(F.lit(None).cast(spark_type(dialect, name)))
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")
