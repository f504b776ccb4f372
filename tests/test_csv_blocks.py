"""CSV files cut at any place give the rows of the reader that takes a whole file."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.sources.csv_blocks import csv_records, cut_records, read_csv_blocks

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


def _quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def _write(path, rows, end="\n", title='id,"te\nxt",n'):
    path.write_bytes((title + end + "".join(f"{i},{_quoted(t)},{n}{end}" for i, t, n in rows)).encode())


@pytest.fixture
def rows():
    dice = random.Random(5)
    parts = ["word", '"', "\n", ",", "\r\n", "é", '""\n', "\n\n", " "]
    return [(i, "x" + "".join(dice.choices(parts, k=dice.randrange(60))), i % 7) for i in range(3000)]


@pytest.mark.parametrize("block", ["4k", "40k", "128m"])
def test_blocks_equal_the_whole_file_reader(spark, tmp_path, rows, block):
    _write(tmp_path / "a.csv", rows[:2900])
    _write(tmp_path / "b.csv", rows[2900:])
    # One record over many blocks, and a file with nothing but its title.
    _write(tmp_path / "c.csv", [(9000, "y" + "\nline" * 2000, 1), (9001, "end", 2)])
    _write(tmp_path / "d.csv", [])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = sorted(map(tuple, read_csv_blocks(spark, str(tmp_path), SCHEMA).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    reader = spark.read.schema(SCHEMA).options(header=True, multiLine=True, quote='"', escape='"')
    assert got == sorted(map(tuple, reader.csv(str(tmp_path)).collect()))
    assert got[:3000] == rows


def test_line_ends_blank_lines_and_no_title(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'1,"a\r\nb",1\r\n\r\n2,,\r\n3,"",4')
    got = sorted(map(tuple, read_csv_blocks(spark, str(tmp_path), SCHEMA, header=False).collect()))
    assert got == [(1, "a\r\nb", 1), (2, None, None), (3, None, 4)]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert csv_records(spark, str(tmp_path)).count() == 0


def test_cut_records():
    assert cut_records(b'1,a\n2,"x\ny"\n3,"z', False) == ([b"1,a", b'2,"x\ny"', b'3,"z'], True)
    assert cut_records(b'x\ny"\n2,b', True) == ([b'x\ny"', b"2,b"], False)
    assert cut_records(b"", True) == ([b""], True)


def test_batches_of_chunks_are_bounded(spark, tmp_path):
    """F8: Python got 10,000 chunks of 32 KB at a time, however large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        path = str(tmp_path / "raw")
        text = F.concat(F.repeat(F.concat(F.col("id").cast("string"), F.lit("\n")), 400))
        rows = spark.range(2_000).select("id", text.alias("t"))
        rows.coalesce(2).write.option("header", True).option("escape", '"').csv(path)
        records = csv_records(spark, path)
        assert records.count() == 2_000
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
