"""Names given by rounds over all of a run, against the walk that gives them one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from loomfold.operators import names
from loomfold.operators.ledger import Names

SCHEMA = "run string, pos long, name string, unique_name string, key int, c0 int"


def walked(rows):
    out, runs = {}, {}
    for run, pos, name in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out[run, pos] = runs.setdefault(run, Names()).give(name)
    return out


def given(spark, rows):
    frame = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = names.unique_names(frame, "name", "run", "pos", "made")
    assert got.columns == [*frame.columns, "made"]
    read = got.collect()
    assert len(read) == len(rows)
    return {(r["run"], r["pos"]): r["made"] for r in read}


@pytest.mark.parametrize("seed", range(6))
def test_names_are_those_of_a_walk(spark, seed):
    some = random.Random(seed)
    stems = ["a", "A", "a-2", "a-3", "a-2-2", "A-2-3", "a-2-2-2", "a-4", "a-02", "a-1", "b", "b-3", "-2", "c-7", ".x", ".x-2"]
    rows = [(some.choice(["r", "r", "s", None]), pos, some.choice([None, "", *[s + e for s in some.sample(stems, 5) for e in (".md", ".md", ".MD", "", ".tar.md")]])) for pos in range(300)]
    rows = [(r, p, n) for r, p, n in rows if n != ""]
    assert given(spark, rows) == walked(rows)


def test_one_hot_name_with_gaps(spark):
    some = random.Random(9)
    asked = ["img.png"] * 900 + [f"img-{k}.png" for k in some.sample(range(2, 1200), 300)] + ["img-5.png"] * 200 + ["img-5-3.png", "img-99999999999.png"]
    some.shuffle(asked)
    rows = [("r", pos, n) for pos, n in enumerate(asked)]
    assert given(spark, rows) == walked(rows)
    assert given(spark, []) == {}
    assert given(spark, [("r", 1, None), (None, 1, "a")]) == {("r", 1): None, (None, 1): "a"}


def test_one_run_of_many_names_takes_many_tasks(spark):
    """A million names in one run, a third of them the same, and one literal in its numbering."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot.md").when(F.col("id") == 1000, "hot-500.md").otherwise(F.concat(F.col("id").cast("string"), F.lit(".md"))).alias("name"))
    laid = names.numbered(rows.withColumn("key", F.lower("name")), ["run", "key"], ["pos"])
    files = [r[0] for r in laid.where("key = 'hot.md'").select("_metadata.file_path").distinct().collect()]
    assert len(files) > 1
    got = names.unique_names(rows, "name", "run", "pos", "made")
    nth = F.floor(F.col("pos") / 3) + 1
    # The 499th of the name comes at 1494, after the literal, so its number is left out.
    number = nth + F.when(nth >= 500, 1).otherwise(0)
    want = F.when(F.col("name") != "hot.md", F.col("name")).when(nth == 1, "hot.md").otherwise(F.concat(F.lit("hot-"), number.cast("string"), F.lit(".md")))
    assert got.where(F.col("made") == want).count() == n
