"""Catalogue of live DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def catalog_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type, nullable) from the schemas; no data is read."""
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean"
    )
