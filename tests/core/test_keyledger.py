"""The ledger in runs against a set of keys, and the exporter that stands on it."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loomfold.operators import keyledger
from loomfold.operators.keyledger import KeyLedger
from loomfold.streaming.incremental import Exporter, Rules


def frame(spark, rows, schema="key string, seq long"):
    return spark.createDataFrame(rows, schema)


def files_read(df):
    """Files of runs in the buckets that the scan's partition filter lets through."""
    found = re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = (\d+)\)\]|PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)\]", df._jdf.queryExecution().executedPlan().toString())
    buckets = set((found[1] or found[2]).split(","))
    return sum("/runs/" in f and re.search(r"/bucket=(\d+)/", f)[1] in buckets for f in df.inputFiles())


def test_ledger_is_a_set(spark, tmp_path):
    some, ledger, known = random.Random(1), KeyLedger(str(tmp_path / "l"), buckets=4, fan=3), set()
    for n in range(8):
        keys = [f"k{some.randrange(60)}" for _ in range(8)]
        items = frame(spark, [(k, i) for i, k in enumerate(keys)] + [(None, 9)])
        left = ledger.exclude(items, "key", n)
        assert sorted(r.key or "" for r in left.collect()) == sorted([""] + [k for k in keys if k not in known])
        for _ in range(1 + (n == 5)):  # one batch is run again
            ledger.add(ledger.exclude(items, "key", n), n, note=f"n{n}")
        known |= set(keys)
        assert sorted(r.key for r in ledger.entries(spark).collect()) == sorted(known)
        assert ledger.manifest(spark)["note"] == f"n{n}"
    assert ledger.entries(spark, before=0).count() == 0
    assert len(ledger.manifest(spark)["runs"]) <= 6
    assert len(os.listdir(tmp_path / "l" / "runs")) <= 9


def test_a_batch_costs_the_same_after_many(spark, tmp_path, monkeypatch):
    """New keys read no run at all, and known ones the files of their buckets, of a number of runs that grows with the logarithm of batches."""
    ledger, read, was = KeyLedger(str(tmp_path / "l"), buckets=4, fan=3), [], keyledger.ledger.exclude
    monkeypatch.setattr(keyledger.ledger, "exclude", lambda items, there, *a: read.append(files_read(there)) or was(items, there, *a))
    counts = []
    for n in range(10):
        items = frame(spark, [(f"b{n}-{i}", n) for i in range(5)])
        ledger.add(ledger.exclude(items, "key", n), n)
        ledger.exclude(frame(spark, [("b0-0", 1)]), "key").collect()
        counts.append(read[-1])
    assert len(read) <= 12  # ten for b0-0, hardly any for new keys
    assert max(counts) <= 6, counts
    assert sum(1 for _, _, names in os.walk(tmp_path / "l" / "runs") for x in names if x.startswith("part-")) <= 60


def test_filter_grows_and_rules_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyledger, "PIECE_KEYS", 50)
    ledger = KeyLedger(str(tmp_path / "l"), "bigint", buckets=2)
    ledger.add(spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("seq")), 0)
    assert ledger.manifest(spark)["pieces"] == 32
    ledger.add(spark.range(1000, 1010).select(F.col("id").alias("key"), F.col("id").alias("seq")), 1)
    left = ledger.exclude(spark.range(500, 5000).select(F.col("id").alias("key")), "key")
    assert sorted(r.key for r in left.collect()) == list(range(1010, 5000))
    bits = spark.read.parquet(str(tmp_path / "l" / "filter" / "1")).withColumnRenamed("piece", "at")
    probe = spark.range(10_000, 20_000).select(F.col("id").alias("key"), keyledger.spot(F.col("id"), 32).alias("at")).join(bits, "at")
    assert probe.where(keyledger.may_hold(F.col("bits"), F.col("key"))).count() < 100


def test_tail_lets_old_entries_go(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "l"), buckets=2, fan=2, tail=3)
    for n in range(5):
        ledger.add(frame(spark, [(f"k{n}", n)]), n)
    assert sorted(r.key for r in ledger.exclude(frame(spark, [(f"k{n}", 0) for n in range(6)]), "key").collect()) == ["k0", "k1", "k5"]
    assert ledger.entries(spark).count() <= 4
    ledger.add(frame(spark, [("k0", 9)]), 5)
    assert sorted(r.key for r in ledger.exclude(frame(spark, [(f"k{n}", 0) for n in range(6)]), "key").collect()) == ["k1", "k2", "k5"]


SCHEMA = "key string, seq long"


def keys_by_batch(exporter, spark):
    return sorted(((r.batch, r.key, r.seq) for r in exporter.output(spark).collect()), key=str)


@pytest.mark.parametrize("tail", [None, 2])
def test_held_rows_come_once(spark, tmp_path, tail):
    """Batches after one that held rows: nothing comes again, neither rows without a key nor, with a short tail, those with one."""
    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"), Rules(most_items=2, ledger_tail=tail))
    exporter.write(frame(spark, [("a", 1), ("b", 2), (None, 3), ("x", 4)]), 0)
    for n in range(1, 5):
        exporter.write(frame(spark, [(f"n{n}", 10 + n)] if n > 2 else []), n)
    exporter.write(frame(spark, [(f"n{n}", 10 + n) for n in (4,)]), 4)  # run again
    want = [(0, "a", 1), (0, "b", 2), (1, None, 3), (1, "x", 4), (3, "n3", 13), (4, "n4", 14)]
    assert sorted(keys_by_batch(exporter, spark), key=str) == sorted(want, key=str)


def test_backlog_leads_the_next_batch(spark, tmp_path):
    """Incomplete items are tried again first: found ones come past rules and cap, gone ones are settled, others stay."""
    seen = []

    def again(pending):
        seen.append(sorted(r.key for r in pending.collect()))
        outcome = F.when(F.col("key") == "p1", "found").when(F.col("key") == "p2", "gone")
        return pending.select("key", "seq", F.lit(True).alias("complete"), outcome.alias("outcome")).where("outcome IS NOT NULL")

    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"), Rules(most_items=3), again=again)
    batch = lambda *rows: frame(spark, list(rows), "key string, seq long, complete boolean")
    exporter.write(batch(("p1", 1, False), ("p2", 2, False), ("p3", 3, False)), 0)
    for _ in range(2):
        exporter.write(batch(("a", 4, True), ("b", 5, True), ("c", 6, True), ("d", 7, True)), 1)
    exporter.write(batch(("p1", 8, True), ("e", 9, True)), 2)
    assert seen == [[], ["p1", "p2", "p3"], ["p1", "p2", "p3"], ["p3"]]
    assert sorted((r.batch, r.key) for r in exporter.output(spark).where("status = 'done'").collect()) == [(1, "a"), (1, "b"), (1, "c"), (1, "p1"), (2, "d"), (2, "e")]
    assert [r.key for r in exporter.pending(spark).collect()] == ["p3"]


def test_counts_of_batches_are_those_of_the_tables(spark, tmp_path):
    """A stream of three files and more batches, with a cap, incomplete items, items that come again, some of the backlog found and some gone."""
    schema = "key string, seq long, complete boolean"
    files = [[("a", 1, True), ("b", 2, False), ("c", 3, True), ("d", 4, False), (None, 5, True)], [("a", 6, True), ("c", 7, True), ("e", 8, True)], [("e", 9, True), ("f", 10, True), ("a", 11, True)]]
    asked = []

    def again(pending):
        asked.append(1)
        outcome = F.when(F.col("key") == "b", "found").when(F.col("key") == "d", "gone")
        return pending.select("key", "seq", F.lit(True).alias("complete"), outcome.alias("outcome")).where("outcome IS NOT NULL")

    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"), Rules(most_items=3), again=again)
    for rows in files:
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        exporter.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    exporter.write(frame(spark, files[2], schema), 2)  # run again
    told = {r.batch: r.asDict() for r in exporter.progress(spark).collect()}
    out = exporter.output(spark).groupBy("batch").pivot("status", ["done", "incomplete"]).count().na.fill(0).collect()
    assert {r.batch: (r.done, r.incomplete) for r in out} == {b: (t["completed"], t["incomplete"]) for b, t in told.items() if t["completed"] + t["incomplete"]}
    assert sum(t["failed"] for t in told.values()) == exporter.given_up.entries(spark).select("key").distinct().count() == 1
    assert [(t["skipped"], t["held"], t["percent"]) for _, t in sorted(told.items())] == [(0, 2, 40), (2, 0, 75), (2, 0, 100)] and len(asked) == 4
    exporter.write(frame(spark, [], schema), 3)
    assert {r.batch: tuple(r)[1:] for r in exporter.progress(spark).collect()}[3] == (0, 0, 0, 0, 0, 0)
