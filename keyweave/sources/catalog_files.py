"""Catalogue files: column lists, the merged index, primary- and foreign-key exports.

Files are read as text lines, split by size like any other text, and parsed with the separator of their own file. A quoted cell
may hold line breaks: whether a line begins inside one follows from the lines before it, and `records` finds that by
running sums, so a large file needs no task of its own. Records have any number of cells; those beyond the named
columns are kept in `more`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.text import delimiter_of
from keyweave.lineage import cut
from keyweave.operators.catalog import INDEX_COLUMNS, INDEX_KEY, clean_rows, index_order
from keyweave.operators.numbering import running_sums

COLUMN_FIELDS = INDEX_COLUMNS[1:]
HEADER_OF_COLUMNS = ("TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME")
HEADER_OF_INDEX = ("SOURCE_SCHEMA", *HEADER_OF_COLUMNS)
WHITE_SPACE = " \t\n\r\f\v"

# File names of the key exports, current ones before older ones.
PRIMARY_KEY_FILES = ("keys-primary.csv", "primary_keys.csv")
FOREIGN_KEY_FILES = ("keys-foreign.csv", "foreign_keys.csv")

# The text between two quotes, quotes in it doubled. Nothing is given back, so long cells cost one pass.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _lines(spark: SparkSession, paths: str | Sequence[str], pattern: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    text = F.replace(F.make_valid_utf8("value"), F.lit("﻿"), F.lit(""))
    return reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        text.alias("line"),
    )


def _first_lines(lines: DataFrame) -> DataFrame:
    """(path, first_line): the first line of each file, found in its first block only."""
    first_block = lines.where("block = 0").withColumn("_at", F.monotonically_increasing_id())
    return first_block.groupBy("path").agg(F.min_by("line", "_at").alias("first_line"))


def detect_delimiters(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, sep) of each file, decided by its first line."""
    first = _first_lines(_lines(spark, paths, pattern))
    return first.select("path", delimiter_of(F.col("first_line")).alias("sep"))


def _for_separator(build) -> Column:
    """`build(class without the separator, separator)` for the separator of the file."""
    return F.when(F.col("sep") == ",", build("[^,]", ",")).otherwise(build(r"[^\t]", r"\t"))


def _ends_open(text: Column) -> Column:
    """Whether text that begins outside quotes ends within a quoted cell."""

    def test(other: str, sep: str) -> Column:
        cell = rf'(?: *+"{_QUOTED}"{other}*+|(?! *"){other}*+)'
        return text.rlike(rf'^(?:{cell}{sep})*+ *+"{_QUOTED}$')

    return _for_separator(test)


def _still_open(line: Column) -> Column:
    """Whether a line that begins within a quoted cell ends within one."""
    closing = rf'^{_QUOTED}"'
    rest = _for_separator(lambda other, _: F.regexp_replace(line, rf"{closing}{other}*+", ""))
    return ~line.rlike(closing) | ((rest != "") & _ends_open(F.substring(rest, 2, 2**31 - 1)))


def records(lines: DataFrame) -> DataFrame:
    """(path, sep, record) of lines (path, sep, block, at, line): lines are joined where a quoted cell goes on.

    A line maps the state before it (outside or inside quotes) to the one after it. It keeps the state, turns it, or sets it
    whatever it was; so the state follows from the last line that sets it and the turns since, two running sums. Files in
    which no line ends within quotes are left as they are. An unclosed quote goes on to the end of its file.
    """
    opened = F.col("line").contains('"') & _ends_open(F.col("line"))
    torn = cut(lines.where(opened).select("path").distinct(), "torn")
    whole = lines.join(torn, "path", "left_anti").select("path", "sep", F.col("line").alias("record"))
    outside = F.when(_ends_open(F.col("line")), 1).otherwise(0)
    inside = F.when(_still_open(F.col("line")), 1).otherwise(0)
    mapped = lines.join(torn, "path", "left_semi").withColumns({"_out": outside, "_in": inside})
    steps = mapped.withColumns(
        {"_turns": ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("bigint"), "_sets": (F.col("_out") == F.col("_in")).cast("bigint")}
    )
    place = [F.col("block"), F.col("at")]
    summed = cut(running_sums(steps, place, ["path"], {"_turned": "_turns", "_set": "_sets"}), "states")
    setters = summed.where("_sets = 1").select("path", F.col("_set").alias("_before"), F.pmod(F.col("_out") + F.col("_turned"), F.lit(2)).alias("_base"))
    before = summed.withColumn("_before", F.col("_set") - F.col("_sets")).join(setters, ["path", "_before"], "left")
    state = F.pmod(F.coalesce("_base", F.lit(0)) + F.col("_turned") - F.col("_turns"), F.lit(2))
    starts = before.select("path", "sep", "block", "at", "line", (state == 0).cast("bigint").alias("_starts"))
    numbered = running_sums(starts, place, ["path"], {"_record": "_starts"})
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    joined = numbered.groupBy("path", "_record").agg(F.any_value("sep").alias("sep"), parts.alias("_parts"))
    return whole.union(joined.select("path", "sep", F.array_join("_parts.line", "\n")))


def split_record(record: Column) -> Column:
    """The cells of a record, as many as it has: quotes taken off, outer white space trimmed.

    Without a quote in the record, every separator ends a cell.
    """

    def cells(other: str, sep: str) -> Column:
        text = F.concat(F.lit("," if sep == "," else "\t"), record)
        pattern = F.lit(rf'\G{sep}(?: *+"({_QUOTED})"?+({other}*+)|({other}*+))')
        quoted, after, plain = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3))
        unquoted = F.transform(quoted, lambda c: F.replace(c, F.lit('""'), F.lit('"')))
        whole = F.zip_with(F.zip_with(unquoted, after, lambda a, b: F.concat(a, b)), plain, lambda a, b: F.concat(a, b))
        found = F.when(record.contains('"'), whole).otherwise(F.split(record, sep, -1))
        return F.transform(found, lambda c: F.btrim(c, F.lit(WHITE_SPACE)))

    return _for_separator(cells)


def read_records(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, sep: str | None = None) -> DataFrame:
    """(path, cells, first): the records of delimited files; `first` marks a record that is the first line of its file.

    Each file has its own separator, decided by its first line, unless `sep` names one for all. A line break in a cell is
    a line feed.
    """
    lines = _lines(spark, paths, pattern)
    firsts = cut(_first_lines(lines), "firsts")
    decided = delimiter_of(F.col("first_line")) if sep is None else F.lit(sep)
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    named = placed.join(firsts.select("path", "first_line", decided.alias("sep")), "path")
    kept = cut(named.select("path", "sep", "block", "at", "line"), "lines")
    found = records(kept).join(firsts, "path")
    return found.select("path", split_record(F.col("record")).alias("cells"), (F.col("record") == F.col("first_line")).alias("first"))


def _named(names: Sequence[str]) -> list[Column]:
    """The first cells under their names, empty where a record has fewer, and `more` for all others."""
    own = [F.coalesce(F.get("cells", i), F.lit("")).alias(n) for i, n in enumerate(names)]
    return [*own, F.slice("cells", len(names) + 1, F.greatest(F.size("cells") - len(names), F.lit(0))).alias("more")]


def _is_header(names: Sequence[str], fields: Sequence[str]) -> Column:
    """True for the first line of a file if its cells hold all header names, in any case and order."""
    shown = F.transform(F.slice("cells", 1, len(fields)), lambda c: F.upper(c))
    return F.col("first") & (F.size(F.array_except(F.array(*map(F.lit, names)), shown)) == 0)


def read_columns(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = "columns.csv") -> DataFrame:
    """Column lists as (table_schema, table_name, column_name, ..., more): positional, header optional, cells trimmed."""
    rows = read_records(spark, paths, pattern).where(~_is_header(HEADER_OF_COLUMNS, COLUMN_FIELDS))
    return clean_rows(rows.select(*_named(COLUMN_FIELDS)), COLUMN_FIELDS[:3])


def read_index(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, sep: str | None = None) -> DataFrame:
    """The merged index with its further cells in `more`, in index order; columns are positional even below a header."""
    rows = read_records(spark, paths, pattern, sep).where(~_is_header(HEADER_OF_INDEX, INDEX_COLUMNS))
    return clean_rows(rows.select(*_named(INDEX_COLUMNS)), INDEX_KEY).orderBy(*index_order())


def _sourced(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, source, cells) of the records of all column lists in folders below `root`, blank ones left out."""
    rows = read_records(spark, root, pattern)
    prefix = _raw_path(spark, root) + "/"
    path = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    outside = F.raise_error(F.concat(F.lit("not below the root: "), F.col("path")))
    below = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(outside.cast("string"))
    folder = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(F.lit(""))
    value = _decoded(F.regexp_replace(_decoded(folder), "^[^=]+=", ""))
    source = F.when(folder.contains("="), value).otherwise(_decoded(folder))
    sourced = rows.select("path", source.alias("source"), "cells")
    return sourced.where((F.col("source") != "") & F.exists("cells", lambda c: c != ""))


def _starts_with_header_word() -> Column:
    return F.lower(F.get("cells", 0)) == "table_schema"


def build_index(spark: SparkSession, root: str, pattern: str = "columns.csv") -> DataFrame:
    """All column lists below `root` as one catalogue of distinct rows, the source in front, further cells in `more`.

    The source is the first folder below the root (`name=value` folders count by their value). Files in the
    root itself are skipped, as are blank rows and every row that starts with the header word.
    """
    rows = _sourced(spark, root, pattern).where(~_starts_with_header_word())
    return rows.select(F.col("source").alias("source_schema"), *_named(COLUMN_FIELDS)).distinct()


def index_header(spark: SparkSession, root: str, pattern: str = "columns.csv") -> list[str]:
    """The names for the index of `root`: those of the first header there is, by path, or else the usual ones."""
    headers = _sourced(spark, root, pattern).where(_starts_with_header_word())
    first = headers.agg(F.min(F.struct("path", "cells")).alias("first")).first()["first"]  # one row
    return ["SOURCE_SCHEMA", *(first["cells"] if first else [c.upper() for c in COLUMN_FIELDS])]


def _decoded(text: Column) -> Column:
    """`%xx` decoded; a plus sign in a path is a plus sign."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _raw_path(spark: SparkSession, root: str) -> str:
    """The root's path as its file system names it, percent-encoded like the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(path).toUri().getRawPath().rstrip("/")


def _csv_line(cells: Column) -> Column:
    """Cells joined by commas; those that need it are quoted, quotes in them doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(cells, lambda c: F.when(c.rlike(r'[,"\t\r\n]|^\s|\s$'), quoted(c)).otherwise(c)), ",")


def write_index(index: DataFrame, path: str, header: Sequence[str] | None = None) -> None:
    """Distinct rows in order, as comma-separated text below one header, by default the names of the columns.

    Rows with further cells in `more` are written with all of them.
    """
    names = [c for c in index.columns if c != "more"]
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    if "more" in index.columns:
        cells = F.concat(cells, F.coalesce("more", F.array().cast("array<string>")))
    rows = index.select(F.lit(1).alias("below"), cells.alias("cells")).distinct()
    top = index.sparkSession.range(1).select(F.lit(0).alias("below"), F.array(*map(F.lit, header or [c.upper() for c in names])).alias("cells"))
    top.union(rows).orderBy("below", "cells").select(_csv_line(F.col("cells"))).write.text(path)


def read_primary_keys(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(table_name, column_name, key_order) from a tab file; columns are found by their header names."""
    raw = spark.read.csv(paths, sep="\t", header=True, inferSchema=False)
    return raw.select(
        F.col("TableName").alias("table_name"),
        F.col("ColumnName").alias("column_name"),
        F.col("KeyOrder").cast("int").alias("key_order"),
    )


def read_foreign_keys(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(child, child_column, parent, parent_column) from a tab file; columns are found by their header names."""
    raw = spark.read.csv(paths, sep="\t", header=True, inferSchema=False)
    return raw.select(
        F.col("ParentTable").alias("child"),
        F.col("ParentColumn").alias("child_column"),
        F.col("ReferencedTable").alias("parent"),
        F.col("ReferencedColumn").alias("parent_column"),
    )


def find_datasets(spark: SparkSession, root: str, kind: str = "columns") -> DataFrame:
    """(dataset, files) of the child folders that hold a column list, or a complete pair of key files.

    Only the listing is used, no file is opened. Ordered by lower-case name.
    """
    listed = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.csv").select("path")
    named = listed.select(
        F.element_at(F.split("path", "/"), -2).alias("dataset"), F.element_at(F.split("path", "/"), -1).alias("file")
    )
    wanted = ["columns.csv"] if kind == "columns" else [*PRIMARY_KEY_FILES, *FOREIGN_KEY_FILES]
    held = named.where(F.col("file").isin(wanted)).groupBy("dataset").agg(
        *[F.count_if(F.col("file") == w).alias(w) for w in wanted]
    )
    if kind == "columns":
        return held.select("dataset", F.array(F.lit("columns.csv")).alias("files")).orderBy(F.lower("dataset"))
    pair = [_first_present(PRIMARY_KEY_FILES), _first_present(FOREIGN_KEY_FILES)]
    complete = held.select("dataset", F.array(*pair).alias("files")).where(F.forall("files", lambda f: f.isNotNull()))
    return complete.orderBy(F.lower("dataset"))


def _first_present(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f"`{n}`") > 0, F.lit(n)) for n in names])
