"""CSV records in byte ranges against the csv module of the standard library."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from flatwork.sources import csv_records, readers


@pytest.fixture()
def small_ranges(spark):
    """Files are cut into ranges of about 200 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def table(rng, rows, share):
    cell = lambda: "".join(rng.choices('abcé ",\n\r', weights=[5, 5, 5, 3, 3, share, share, share, share], k=rng.randint(0, 12)))
    return [[str(i), cell(), cell()] for i in range(rows)]


def written(rows, end="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("share", [0, 0.3, 3])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_cut_files(spark, tmp_path, small_ranges, share, end):
    rng = random.Random(share)
    files = {"a.csv": table(rng, 300, share), "b.csv": table(rng, 1, share), "c.csv": []}
    files["a.csv"][40][1] = "a cell\nover\nmany ranges " * 100
    files["a.csv"][41][1] = 'x"\n' * 300
    for name, rows in files.items():
        (tmp_path / name).write_bytes(written([["id", "first\nname", "second"], *rows], end).encode())
    records = csv_records.csv_records(spark, str(tmp_path))
    got = [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in records.collect()]
    assert sorted(got) == sorted(r for rows in files.values() for r in rows)
    if share == 3:
        pieces = spark.read.text(str(tmp_path / "a.csv"), lineSep="\n")
        assert pieces.select("_metadata.file_block_start").distinct().count() > 10


def test_table_of_a_cut_file(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    rows = [[i, "" if i % 7 == 0 else f'n"{i}\nx', rng.random() if i % 5 else "NA"] for i in range(400)]
    path = tmp_path / "t.csv"
    path.write_text(written([["id", "note", "dotted.value"], *rows], "\n"))
    df = readers.read_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "dotted.value": "double"}
    got = {r["id"]: (r["note"], r["dotted.value"]) for r in df.collect()}
    assert got == {i: (n or None, None if v == "NA" else v) for i, n, v in rows}
    typed = readers.read_table(spark, str(path), df.schema)
    assert typed.where("id = 8").first()["note"] == 'n"8\nx' and typed.schema == df.schema


def test_stray_quotes_blank_lines_and_open_ends(spark, tmp_path, small_ranges):
    text = 'id,size\n\n1,5" pipe\n   \n2,"6"" pipe"\n3,"a"b"\n4,x"y"z\n' + "".join(f'{i},9" tube\n' for i in range(5, 200)) + '200,"never closed\n201,rest'
    (tmp_path / "t.csv").write_text(text)
    got = sorted(r["record"] for r in csv_records.csv_records(spark, str(tmp_path / "t.csv")).collect())
    want = ['1,5" pipe', '2,"6"" pipe"', '3,"a"b"', '4,x"y"z', *[f'{i},9" tube' for i in range(5, 200)], '200,"never closed\n201,rest']
    assert got == sorted(want)
    sizes = {r["id"]: r["size"] for r in readers.read_table(spark, str(tmp_path / "t.csv")).collect()}
    assert sizes[1] == '5" pipe' and sizes[2] == '6" pipe' and sizes[199] == '9" tube' and len(sizes) == 200


LINES = [b"a,b", b'a,"b', b'a,"b"', b'"a""', b'x""y",z', b'a"b,c', b'"', b'""', b'",""",', b'q",",', b"", b'"a"b",c', b'",,"x', b'"",""","']


@pytest.mark.parametrize("line", LINES)
def test_open_quotes_at_the_end_of_a_line(line):
    tests = csv_records.open_tests()
    expected = []
    for state in (False, True):  # the state machine, one character after another
        where = "in" if state else "start"
        i = 0
        while i < len(line):
            c = line[i : i + 1]
            if where == "in":
                if c == b'"' and line[i + 1 : i + 2] == b'"':
                    i += 1
                elif c == b'"':
                    where = "cell"
            elif c == b",":
                where = "start"
            else:
                where = "in" if where == "start" and c == b'"' else "cell"
            i += 1
        expected.append(where == "in")
    got = [t.fullmatch(line) is not None if b'"' in line else bool(s) for s, t in enumerate(tests)]
    assert got == expected


def test_one_range_plan_reads_in_parallel(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_text(written([["a", "b"], *[[i, 'x\ny"'] for i in range(500)]], "\n"))
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "t.csv"))
    assert lines.select(F.spark_partition_id()).distinct().count() > 3
    assert readers.read_table(spark, str(tmp_path / "t.csv")).count() == 500
