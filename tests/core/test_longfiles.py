"""Files that many tasks write side by side, against the same files written in one go."""

import json
import os
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomfold.operators import export, longfiles, sinks
from tests.core.test_operators import run_rows

AT = datetime(2024, 3, 2, 7, 8, 10)


@pytest.mark.parametrize(("separator", "foot", "headed"), [("", "", False), (", é", "\n]", True), ("\n", "", False)])
def test_long_files_are_the_serial_join(spark, tmp_path, separator, foot, headed):
    some = random.Random(len(separator))
    rows = [(f"{some.choice('abc')}/f.txt", i, some.choice([None, "", "é", "x" * 3000, f"row {i}"])) for i in range(500)] + [("one.txt", 0, ""), ("two.txt", 0, None), ("two.txt", 1, "")]
    some.shuffle(rows)
    head = (lambda n: F.concat(F.lit("[ü"), n.cast("string"))) if headed else None
    out = longfiles.write_long(spark.createDataFrame(rows, "name string, pos int, content string").repartition(5), str(tmp_path), separator=separator, foot=foot, head=head)
    got = {r.name: (r.n_items, r.n_bytes, r.error) for r in out.collect()}
    for name in {r[0] for r in rows}:
        own = [c or "" for n, _, c in sorted(rows, key=lambda r: r[1]) if n == name]
        want = ((f"[ü{len(own)}" if headed else "") + separator.join(own) + foot).encode()
        assert (tmp_path / name).read_bytes() == want
        assert got[name] == (len(own), len(want), None)
    assert sorted(f for _, _, names in os.walk(tmp_path) for f in names) == ["f.txt", "f.txt", "f.txt", "one.txt", "two.txt"]
    assert longfiles.write_long(spark.createDataFrame([], "name string, pos int, content string"), str(tmp_path)).count() == 0


def test_a_store_of_whole_streams_gets_the_same(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id") % 2).alias("name"), F.col("id").alias("pos"), F.col("id").cast("string").alias("content"))
    monkeypatch.setattr(longfiles.fs, "LocalFileSystem", longfiles.fs.SubTreeFileSystem)
    longfiles.write_long(rows, str(tmp_path), separator=",")
    assert (tmp_path / "f1").read_text() == ",".join(map(str, range(1, 300, 2)))


def test_one_file_of_a_million_items(spark, tmp_path):
    """The longest file is written by many tasks, each line at its place."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("long.csv").alias("name"), F.col("id").alias("pos"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("content")).repartition(6)
    (done,) = longfiles.write_long(rows, str(tmp_path), separator="\n", foot="\n", head=lambda n: F.concat(F.lit("of "), n.cast("string"), F.lit("\n"))).collect()
    assert done.n_items == n
    with open(tmp_path / "long.csv") as f:
        assert next(f) == f"of {n}\n"
        assert all(line == f"line {i}\n" for i, line in enumerate(f))


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 2000])
def test_archives_are_the_serial_ones(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    rows = [("a.zip", i, f"{'é' if i % 5 == 0 else 'n'}{i}.md", f"text {i} ü" * (i % 7)) for i in range(200)] + [("b.zip", 0, "x/only.txt", "")]
    out = longfiles.write_zip(spark.createDataFrame(rows, "archive string, pos int, name string, content string").repartition(4), str(tmp_path), AT, limit=limit)
    got = {r.name: (r.n_items, r.n_bytes, r.error) for r in out.collect()}
    for name in ("a.zip", "b.zip"):
        entries = [(n, c) for a, _, n, c in rows if a == name]
        want = export.zipped(entries, AT)
        assert (tmp_path / name).read_bytes() == want
        assert got[name] == (len(entries), len(want), None)
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.testzip() is None and [(i.filename, z.read(i).decode()) for i in z.infolist()] == entries


def test_an_archive_of_more_entries_than_the_short_form_counts(spark, tmp_path):
    n = 70_000
    rows = spark.range(n).select(F.lit("many.zip").alias("archive"), F.col("id").alias("pos"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content"))
    longfiles.write_zip(rows, str(tmp_path), AT)
    assert (tmp_path / "many.zip").read_bytes() == export.zipped([(f"{i}.txt", str(i)) for i in range(n)], AT)


@pytest.mark.parametrize("fmt", ["md", "txt", "html", "json", "csv"])
def test_a_combined_file_is_the_one_made_in_memory(spark, tmp_path, fmt):
    rows = run_rows(spark, 7).withColumn("run", F.lit("r")).withColumn("name", F.lit(f"all.{fmt}"))
    sinks.write_combined(rows, str(tmp_path), fmt, export.Options())
    (want,) = export.combined_files(rows, "run", "pos", fmt, export.Options()).select("content").collect()
    assert (tmp_path / f"all.{fmt}").read_text() == want[0]
    if fmt == "json":
        assert len(json.loads(want[0])) == 7
