"""The given tables with their keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from keyweave.plans.check_report import ForeignKey, TableRules
from keyweave.operators.conform import DeclaredColumn

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Foreign keys in edge order: (child, child_column, parent, parent_column).
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]

RULES = {
    "nation": TableRules(["n_nationkey"], not_null=["n_name"], foreign_keys=[ForeignKey(["n_regionkey"], "region", ["r_regionkey"])]),
    "customer": TableRules(
        ["c_custkey"],
        not_null=["c_name"],
        foreign_keys=[ForeignKey(["c_nationkey"], "nation", ["n_nationkey"])],
        sized=[DeclaredColumn("c_name", "VARCHAR(18)"), DeclaredColumn("c_mktsegment", "VARCHAR(8)")],
    ),
    "part": TableRules(["p_partkey"], unique=[["p_name"]], not_null=["p_name", "p_brand"]),
    "orders": TableRules(["o_orderkey"], not_null=["o_custkey", "o_orderdate"], foreign_keys=[ForeignKey(["o_custkey"], "customer", ["c_custkey"])]),
    "lineitem": TableRules(
        ["l_orderkey", "l_linenumber"],
        not_null=["l_shipdate"],
        foreign_keys=[
            ForeignKey(["l_orderkey"], "orders", ["o_orderkey"]),
            ForeignKey(["l_partkey"], "part", ["p_partkey"]),
            ForeignKey(["l_suppkey"], "supplier", ["s_suppkey"]),
        ],
    ),
    "labels": TableRules(["doc_id"], foreign_keys=[ForeignKey(["doc_id"], "documents", ["doc_id"])]),
    "documents": TableRules(["doc_id"], unique=[["text"]], foreign_keys=[ForeignKey(["doc_id"], "labels", ["doc_id"])]),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables(Mapping):
    """The given tables by name; a table is opened when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)

    def __iter__(self):
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)


def foreign_keys(spark: SparkSession) -> DataFrame:
    rows = [(i, *fk) for i, fk in enumerate(FOREIGN_KEYS, start=1)]
    return spark.createDataFrame(rows, "edge_ord bigint, child string, child_column string, parent string, parent_column string")
