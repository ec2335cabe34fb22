"""CSV files read in byte ranges, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import plan
from sparkfeat.sources import read_table
from sparkfeat.sources.records import csv_records

SCHEMA = "id int, text string, x double, last string"


def written(folder, name, rows, end="\n", header="id,text,x,last"):
    """A CSV file as other programs write it: fields quoted where they have to be, and sometimes where not."""
    def field(value, always):
        if value is None:
            return ""
        quoted = '"' + value.replace('"', '""') + '"'
        return quoted if always or value == "" or any(c in value for c in '",\n\r') else value
    lines = [",".join(field(v, (i + k) % 5 == 0) for k, v in enumerate(row)) for i, row in enumerate(rows)]
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes((end.join([header, *lines]) + (end if name < "c" else "")).encode())


def records(seed, n=400, inner=("\n", '"', ",", "\n\n", "a", "é ", ' "" ', "b c", "\\", "\n,\n")):
    random.seed(seed)
    text = lambda: None if random.random() < 0.1 else "".join(random.choices(inner, k=random.randint(0, 12)))
    return [(str(i), text(), str(random.random()), text()) for i in range(n)]


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)


def whole(spark, path, schema=SCHEMA):
    return read_table(spark, str(path), schema=schema, split_bytes=1 << 60)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_equal_whole_files(small_ranges, tmp_path, end):
    inner = ("\n", '"', ",", "a", "é", " ", "\n\n", "\r\n") if end == "\n" else ("\r\n", '"', ",", "a", " ", "\r\n\r\n")
    for k, name in enumerate(["a.csv", "b.csv", "c.csv"]):
        written(tmp_path / "t", name, records(k, inner=inner), end)
    ours = read_table(small_ranges, str(tmp_path / "t"), schema=SCHEMA, split_bytes=0)
    assert collected(ours) == collected(whole(small_ranges, tmp_path / "t"))
    assert small_ranges.read.text(str(tmp_path / "t"), lineSep="\n").rdd.getNumPartitions() > 50
    assert "multiLine" not in plan(ours)


def test_fields_longer_than_ranges(small_ranges, tmp_path):
    long = "line, \"quoted\"\n" * 300
    rows = [("1", long, "1.5", "x"), ("2", "y", "2.5", None), ("3", "no end", "0.5", long), ("4", "z" * 5000, "1", "\n"), ("5", "", "7", "end")]
    written(tmp_path / "t", "a.csv", rows)
    ours = read_table(small_ranges, str(tmp_path / "t"), schema=SCHEMA, split_bytes=0)
    assert collected(ours) == collected(whole(small_ranges, tmp_path / "t"))
    assert {r["id"]: r["text"] for r in ours.collect()}[1] == long


def test_headers_types_and_empty_files(small_ranges, tmp_path):
    rows = records(9, 60)
    written(tmp_path / "t", "a.csv", rows, header='id,"two\nlines",x,"la""st"')
    (tmp_path / "t" / "b.csv").write_bytes(b"")
    ours = read_table(small_ranges, str(tmp_path / "t"), split_bytes=0)
    theirs = read_table(small_ranges, str(tmp_path / "t"), split_bytes=1 << 60)
    assert ours.columns == ["id", "two\nlines", "x", 'la"st']
    assert ours.dtypes == theirs.dtypes and [t for _, t in ours.dtypes] == ["int", "string", "double", "string"]
    assert collected(ours) == collected(theirs)
    assert csv_records(small_ranges, str(tmp_path / "t")).count() == len(rows)


def test_only_large_files_are_split(spark, tmp_path):
    written(tmp_path / "t", "a.csv", records(2, 20))
    path = str(tmp_path / "t")
    assert "FileScan csv" in plan(read_table(spark, path, schema=SCHEMA), "simple")
    assert "FileScan csv" not in plan(read_table(spark, path, schema=SCHEMA, split_bytes=10), "simple")
    assert read_table(spark, path, schema=SCHEMA, split_bytes=10).where(F.col("id") >= 0).count() == 20


def test_files_of_the_query_do_not_grow_with_the_table(spark, monkeypatch):
    """Each file is written by one task, which took the whole table when there was only one."""
    import checks.rows as queries
    sizes = []
    monkeypatch.setattr(queries, "CSV_FILE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(queries, "table", lambda *a: spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(16))

    def read(spark, path, **options):
        sizes.extend(r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect())
        return read_table(spark, path, **options)

    monkeypatch.setattr(queries, "read_table", read)
    frame = queries.csv_multi_line(spark, "/root/testdata/sf0.001")
    assert len(sizes) > 3 and max(sizes) < 250_000
    assert frame.select("doc_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
