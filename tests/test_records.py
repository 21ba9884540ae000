"""Records of delimited files against the csv module."""

import csv
import io
import random

import pytest

from keyweave.sources import catalog_files as files


def plain(text, sep):
    if not text:
        return []
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    return [[c.strip(files.WHITE_SPACE) for c in row] or [""] for row in rows]


def found(df):
    return sorted(r.cells for r in df.collect())


@pytest.mark.parametrize("sep", [",", "\t"])
def test_random_files(spark, tmp_path, sep):
    rng = random.Random(7)
    expected = []
    for k in range(60):
        cells = [rng.choice(["a", "", '"', '""', f'"{sep}"', '"x\n', "\n", '"\n\n"', f'b"c{sep}', f'"{sep}', "\n\n", f'"q""{sep}\n']) for _ in range(rng.randrange(1, 40))]
        text = "".join(x if rng.random() < 0.5 else x + sep for x in cells)
        (tmp_path / f"{k}.csv").write_text(text, newline="")
        expected += plain(text, sep)
    assert found(files.read_records(spark, str(tmp_path), sep=sep)) == sorted(expected)


def test_a_large_torn_file_is_split(spark, tmp_path):
    """Cells that go on over many lines and splits: no line knows by itself whether it is within quotes."""
    rng = random.Random(8)
    rows = [["dbo", f"t{i}", rng.choice(["c", 'say "hi"', "a\nb\n", ",\n,", "\n" * rng.randrange(40)]), "int", *["x"] * rng.randrange(4)] for i in range(4000)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "columns.csv").write_text(out.getvalue(), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert found(files.read_records(spark, str(tmp_path))) == sorted([c.strip(files.WHITE_SPACE) for c in row] for row in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_index_keeps_all_cells_and_the_first_header(spark, tmp_path):
    root = tmp_path / "data"
    for name, text in {
        "b/columns.csv": 'TABLE_SCHEMA\tTABLE_NAME\tCOLUMN_NAME\tLATER\ndbo\tt\tc\tint\n',
        "a/columns.csv": 'table_schema,Table_Name,column_name,data_type,size,null,note\ndbo,t,c,int,4,NO,"one\nnote"\ndbo,t,c,int,4,NO,other\ndbo,t,c,int,4,NO,other\n',
        "a/deep/columns.csv": "dbo,t,c,int,4,NO,other,and more\n",
        "c/columns.csv": "",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, newline="")
    header = files.index_header(spark, str(root))
    assert header == ["SOURCE_SCHEMA", "table_schema", "Table_Name", "column_name", "data_type", "size", "null", "note"]
    index = files.build_index(spark, str(root))
    assert sorted(r.more for r in index.collect()) == [[], ["one\nnote"], ["other"], ["other", "and more"]]
    path = str(tmp_path / "index.csv")
    files.write_index(index, path, header)
    text = "".join(p.read_text() for p in sorted((tmp_path / "index.csv").glob("part-*")))
    assert text.splitlines()[0] == ",".join(header) and text.count("Table_Name") == 1
    assert list(csv.reader(io.StringIO(text, newline="")))[1] == ["a", "dbo", "t", "c", "int", "4", "NO", "one\nnote"]
    assert sorted(map(str, files.read_index(spark, path, "part-*", ",").collect())) == sorted(map(str, index.collect()))
    assert files.index_header(spark, str(root / "c")) == ["SOURCE_SCHEMA", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "CHARACTER_MAXIMUM_LENGTH", "IS_NULLABLE"]


def test_a_long_cell(spark, tmp_path):
    cell = 'x"' * 100_000
    (tmp_path / "columns.csv").write_text('a,b,"' + cell.replace('"', '""') + '",d\n')
    assert found(files.read_records(spark, str(tmp_path))) == [["a", "b", cell, "d"]]


def test_records_are_found_in_one_reading_of_the_files(spark, tmp_path):
    """First lines are found beforehand; plain records keep empty cells, white space goes."""
    (tmp_path / "a.csv").write_text('a, b ,,\n"x,y", c ,\n \n')
    df = files.read_records(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert " text" not in plan and "Relation" in plan
    assert found(df) == [[""], ["a", "b", "", ""], ["x,y", "c", ""]]
