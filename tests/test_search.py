import json

import pytest
from pyspark.sql import functions as F

from keyweave.functions.text import comma_list, parse_list, parse_type, quote_identifier, safe_name, split_path
from keyweave.operators.search import search_tables, search_values, searched_columns


@pytest.fixture(scope="module")
def words(spark):
    rows = [
        (1, "100% wool", "it's", None, 5),
        (2, "100 wool", "IT", "x", 6),
        (3, "a_b", "axb", "x", 7),
        (4, None, None, None, 8),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, `odd name` string, code string, n int")


def hits(result):
    return {r.column_name: r.match_count for r in result.hits.collect()}


def test_only_string_columns_less_the_excluded(words):
    assert searched_columns(words) == ["name", "odd name", "code"]
    assert searched_columns(words, " name , ,odd name") == ["code"]
    assert searched_columns(words, ["code"]) == ["name", "odd name"]


def test_contains_is_literal_and_like_has_wildcards(words):
    assert hits(search_values(words, "0%")) == {"name": 1}
    assert hits(search_values(words, "a_b")) == {"name": 1}
    assert hits(search_values(words, "a_b", mode="like")) == {"name": 1, "odd name": 1}
    assert hits(search_values(words, "1%wool", mode="like")) == {"name": 2}
    assert hits(search_values(words, "it's")) == {"odd name": 1}


def test_equals_and_case(words):
    assert hits(search_values(words, "x", mode="equals")) == {"code": 2}
    assert hits(search_values(words, "it", ignore_case=True)) == {"odd name": 2}
    assert hits(search_values(words, "X", mode="equals", ignore_case=True)) == {"code": 2}
    with pytest.raises(ValueError):
        search_values(words, "x", mode="sounds like")


def test_row_filter_is_a_whole_condition(words):
    assert hits(search_values(words, "wool", row_filter="id = 1 OR id = 3")) == {"name": 1}


def test_hits_are_in_name_order(words):
    found = search_values(words, "x", row_filter="id = 3").hits.collect()
    assert [r.column_name for r in found] == ["code", "odd name"]


def test_no_match_no_text_columns_and_no_rows(words):
    assert hits(search_values(words, "zzz")) == {}
    assert hits(search_values(words.select("id"), "1")) == {}
    assert hits(search_values(words.limit(0), "x")) == {}


def test_samples_per_column_in_key_order(spark):
    df = spark.range(100).select(F.col("id"), F.lit("abc").alias("a"), F.when(F.col("id") > 95, "b").alias("b"))
    result = search_values(df, "b", key=["id"], samples=5)
    assert [r.id for r in result.sample_rows.where("column_name = 'a'").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert [r.id for r in result.sample_rows.where("column_name = 'b'").orderBy("id").collect()] == [96, 97, 98, 99]
    first = json.loads(result.samples.where("column_name = 'a'").collect()[0].row_json)
    assert first == {"id": 0, "a": "abc"}  # NULL fields are left out


def test_samples_are_cut_before_the_shuffle(spark):
    df = spark.range(10).select("id", F.lit("abc").alias("a"))
    plan = search_values(df, "b", key=["id"]).samples._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_summary_and_report(words):
    result = search_values(words, "x", row_filter="id > 0", table="words")
    assert tuple(result.summary.collect()[0]) == ("words", "id > 0", "x", 3)
    assert {r.search_value for r in result.report().collect()} == {"x"}


def test_many_tables(words, spark):
    other = spark.createDataFrame([("x",), ("y",)], "letter string")
    found = search_tables({"words": words, "letters": other}, "x").collect()
    assert [tuple(r) for r in found] == [("letters", "letter", 1), ("words", "code", 2), ("words", "odd name", 1)]


def test_counts_come_from_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = search_values(df, "a").hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "p_retailprice" not in plan


def test_equality_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = search_values(df, "ECONOMY", mode="equals").hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(Or(EqualTo(p_name,ECONOMY),EqualTo(p_brand,ECONOMY)),EqualTo(p_type,ECONOMY))]" in plan


def test_text_functions(spark):
    row = spark.range(1).select(
        safe_name(F.lit("_héllo wörld!9_")).alias("safe"),
        safe_name(F.lit("--")).alias("none"),
        comma_list(F.lit(" a, ,b ,")).alias("list"),
        split_path(F.lit("s-t-c-d-e")).alias("path"),
        split_path(F.lit("s-t")).alias("short"),
        parse_type(F.lit("numeric(10,0)")).alias("whole"),
        parse_type(F.lit("Decimal(10, 2)")).alias("sized"),
        parse_type(F.lit("text")).alias("plain"),
    ).first()
    assert row.safe == "héllo_wörld_9" and row.none == "value" and row.list == ["a", "b"]
    assert tuple(row.path) == ("s", "t", "c-d-e") and row.short is None
    assert tuple(row.whole) == ("NUMERIC", "10") and tuple(row.sized) == ("DECIMAL", "10, 2") and tuple(row.plain) == ("TEXT", None)
    assert parse_list(" a, ,b") == ["a", "b"] and parse_list(None) == []
    assert quote_identifier("a`b") == "`a``b`"
