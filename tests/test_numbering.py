import random

from pyspark.sql import functions as F

from keyweave.operators import numbering
from keyweave.operators.numbering import number_rows, running_sums


def test_numbers_within_groups_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.random(), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v double, id bigint")
    got = {(r.g, r.id): r.position for r in number_rows(df, [F.desc("v")], within=["g"], distinct_rows=True).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for n, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]), start=1):
            expected[g, row[2]] = n
    assert got == expected


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((str(r.g), r.position) for r in number_rows(df, [F.col("v")], within=["g"]).collect()) == [
        ("None", 1), ("None", 2), ("a", 1),
    ]


def test_copies_get_numbers_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(numbering, "COPIES_PER_TASK", 10)
    df = spark.createDataFrame([("a",)] * 95 + [("b",)] * 3 + [("c",)] * 10, "k string")
    got = number_rows(df, [F.col("k")]).collect()
    assert sorted(r.position for r in got) == list(range(1, 109))
    assert sorted(r.position for r in got if r.k == "b") == [96, 97, 98]


def test_the_hot_group_is_spread_over_ranges(spark):
    df = spark.range(10_000).select(F.lit("one").alias("g"), "id")
    ranged = df.repartitionByRange(8, "g", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert ranged.agg(F.max("count")).first()[0] < 3_000
    got = running_sums(df.withColumn("v", F.lit(2)), [F.col("id")], ["g"], {"s": "v"})
    assert got.where("s <> 2 * (id + 1)").count() == 0


def test_no_rows(spark):
    assert number_rows(spark.range(0), [F.col("id")]).count() == 0


def test_tables_written_in_a_scope_are_removed(spark, tmp_path):
    import os

    from keyweave.lineage import cut, new_folder, shared_folder, written_tables

    with written_tables(spark):
        kept = cut(spark.range(3), "scoped")
        folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file:").replace("///", "/"))
        assert os.path.isdir(folder) and kept.count() == 3
        with written_tables(spark):
            inner = new_folder(spark, "inner")
            spark.range(1).write.parquet(inner)
        assert not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(folder) and os.path.isdir(shared_folder(spark).removeprefix("file:"))
    assert cut(spark.range(2), "unscoped").count() == 2
