"""The order of a run's output, which is numbered without one task for all of it."""

from pyspark.sql import functions as F

from loomfold.operators import ledger


def test_places_run_on_over_ranges_of_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).repartition(7)
    made = ledger.ordered_output(rows.where("pos % 3 = 1"), rows.where("pos % 3 <> 1"), "pos")
    want = sorted(range(3000), key=lambda n: (n % 3 != 1, n))
    assert [(r.place, r.pos) for r in made.collect()] == list(enumerate(want, 1))
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "pos int, key string")
    assert [(r.place, r.pos) for r in ledger.ordered_output(same.limit(0), same, "pos").collect()] == [(1, None), (2, 1), (3, 1)]
    assert ledger.ordered_output(same.limit(0), same.limit(0), "pos").columns == ["pos", "key", "place"]
