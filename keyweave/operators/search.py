"""Search a value in all string columns of one or many tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.text import column, parse_list
from keyweave.operators.catalog import find_tables

HITS = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("match_count", T.LongType())])


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    sample_rows: DataFrame | None
    samples: DataFrame | None
    summary: DataFrame
    parameters: dict[str, Column]

    def report(self) -> DataFrame:
        """Hits with the parameters of the run beside them."""
        return self.hits.withColumns(self.parameters)


def searched_columns(df: DataFrame, exclude: Iterable[str] | str = ()) -> list[str]:
    """String columns in table order, less the excluded ones (a list or a comma list)."""
    skip = set(parse_list(exclude) if isinstance(exclude, str) else exclude)
    text_types = (T.StringType, T.VarcharType, T.CharType)
    return [f.name for f in df.schema if isinstance(f.dataType, text_types) and f.name not in skip]


def matches(text: Column, value: str, mode: str = "contains", ignore_case: bool = False) -> Column:
    """contains: literal fragment; like: `%` and `_` are wildcards; equals: the whole value."""
    wanted = F.lit(value)
    if ignore_case:
        text, wanted, value = F.lower(text), F.lower(wanted), value.lower()
    if mode == "contains":
        return text.contains(wanted)
    if mode == "like":
        return text.like("%" + value.replace("\\", "\\\\") + "%")
    if mode == "equals":
        return text == wanted
    raise ValueError(f"unknown search mode: {mode}")


def search_values(
    df: DataFrame,
    value: str,
    *,
    mode: str = "contains",
    row_filter: str | None = None,
    exclude: Iterable[str] | str = (),
    key: Sequence[str] = (),
    samples: int = 5,
    ignore_case: bool = False,
    table: str = "",
) -> SearchResult:
    """Count the matching rows of each string column, and keep up to `samples` rows of each in `key` order.

    The counts of all columns come from one scan. Samples need a `key`, because without an order the
    choice would be arbitrary; without a key only the counts are given.
    """
    names = searched_columns(df, exclude)
    rows = df.where(F.expr(row_filter)) if row_filter else df
    tests = {n: matches(column(n), value, mode, ignore_case) for n in names}
    if mode == "equals" and tests and not ignore_case:
        rows = rows.where(reduce(lambda a, b: a | b, tests.values()))

    sample_rows = samples_json = None
    if key:
        top = _sample_rows(rows, tests, key, samples)
        # Named `column_name`, with underscores before it where the table has such a column.
        name = "column_name"
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        sample_rows = top.select(F.col("_hit").alias(name), "_row.*")
        samples_json = top.select(F.col("_hit").alias("column_name"), F.to_json("_row").alias("row_json"))
    parameters = {
        "target_table": F.lit(table),
        "row_filter": F.lit(row_filter or "1 = 1"),
        "search_value": F.lit(value),
        "columns_scanned": F.lit(len(names)).cast("bigint"),
    }
    summary = df.sparkSession.range(1).select(*[c.alias(n) for n, c in parameters.items()])
    return SearchResult(_hits(rows, tests), sample_rows, samples_json, summary, parameters)


def search_tables(tables: Mapping[str, DataFrame], value: str, **options) -> DataFrame:
    """Hits over many tables, the table name in front and in name order; one job, tables scanned side by side."""
    found = [
        search_values(df, value, **options).hits.select(F.lit(name).alias("table_name"), "column_name", "match_count")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class TableSearch:
    """How one table is searched: each has its own filter, key for samples and columns to leave out."""

    row_filter: str | None = None
    exclude: tuple[str, ...] | str = ()
    key: tuple[str, ...] = ()
    mode: str = "contains"
    ignore_case: bool = False


def search_indexed(
    index: DataFrame, fragment: str, tables: Mapping[str, DataFrame], value: str, searches: Mapping[str, TableSearch] | None = None, samples: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Hits and samples over the tables of a catalogue whose qualified name holds the fragment.

    `tables` and `searches` go by `source.schema.table`; a table of the index that is not in `tables` is left out, one that is not
    in `searches` is searched by the defaults. (table_name, column_name, match_count), and (table_name, column_name, row_json)
    of the tables with a key. The names found are read by the driver, for a plan has a branch for each table.
    """
    named = [r["qualified_name"] for r in find_tables(index, fragment).select("qualified_name").distinct().orderBy("qualified_name").collect()]
    hits = index.sparkSession.createDataFrame([], T.StructType([T.StructField("table_name", T.StringType()), *HITS]))
    found = index.sparkSession.createDataFrame([], "table_name string, column_name string, row_json string")
    for name in named:
        if name not in tables:
            continue
        how = (searches or {}).get(name, TableSearch())
        result = search_values(
            tables[name], value, mode=how.mode, row_filter=how.row_filter, exclude=how.exclude, key=how.key, samples=samples, ignore_case=how.ignore_case, table=name
        )
        hits = hits.union(result.hits.select(F.lit(name).alias("table_name"), "column_name", "match_count"))
        if result.samples is not None:
            found = found.union(result.samples.select(F.lit(name).alias("table_name"), "column_name", "row_json"))
    return hits, found


def _hits(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    if not tests:
        return rows.sparkSession.createDataFrame([], HITS)
    counts = rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    # One row of counts, turned into rows in name order: sorted without a sort.
    long = counts.unpivot([], [column(n) for n in sorted(tests)], "column_name", "match_count")
    return long.where("match_count > 0")


def _row_hash(rows: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash of their own, count as their text."""
    is_map = lambda kind: "map<" in kind
    return F.xxhash64(*[F.to_json(F.struct(column(c))) if is_map(kind) else column(c) for c, kind in rows.dtypes])


def _sample_rows(rows: DataFrame, tests: Mapping[str, Column], key: Sequence[str], samples: int) -> DataFrame:
    """(_hit, _row): up to `samples` rows of each column in key order; equal keys in the order of a hash of the row.

    Only keys and hashes are ranked. The rows they belong to are then fetched from a second scan: the list of them is as long
    as `samples` times the number of columns at most, so it is sent to all tasks and no whole row is sorted.
    """
    hit_columns = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    keys = {f"_k{i}": column(k) for i, k in enumerate(key)} | {"_hash": _row_hash(rows)}
    if not tests:
        return rows.select(F.lit("").alias("_hit"), F.struct(*[column(c) for c in rows.columns]).alias("_row")).where(F.lit(False))
    per_hit = rows.select(F.explode(hit_columns).alias("_hit"), *[c.alias(n) for n, c in keys.items()])
    # A limit on row_number is applied in each map task first, so at most `samples` rows of a column
    # leave a task however many rows match.
    order = Window.partitionBy("_hit").orderBy(*keys)
    top = per_hit.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= samples)
    chosen = top.groupBy("_hit", *keys).agg(F.count(F.lit(1)).alias("_copies"))
    wanted = chosen.select("_hit", "_copies", *[F.col(n).alias(f"{n}_") for n in keys])
    named = rows.where(reduce(lambda a, b: a | b, tests.values())).select(*[c.alias(n) for n, c in keys.items()], F.struct(*[column(c) for c in rows.columns]).alias("_row"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in keys])
    met = named.join(F.broadcast(wanted), same)
    # Copies are one row here; `collect_set` has one element and makes the grouping one by hash.
    found = met.groupBy("_hit", *keys).agg(F.first("_row").alias("_row"), F.collect_set("_copies").alias("_n"))
    return found.select("_hit", F.explode(F.array_repeat("_row", F.element_at("_n", 1).cast("int"))).alias("_row"))
