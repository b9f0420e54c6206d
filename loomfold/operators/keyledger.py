"""A ledger of keys whose batches cost the same however many there have been.

Entries lie in runs, each split by a hash of the key into buckets. A batch adds one run; where ``fan`` runs of a level have come
together, they are merged into one of the next level, so an entry is rewritten once a level and there are few runs. Beside them lies a
Bloom filter in pieces of 32768 bits: a key has one piece, and some bits in it. Items meet the filter where they are read; only
those that it doesn't rule out are looked for, and only in the buckets that they belong to.

What a batch leaves is named by its manifest, which is written last. A batch that is run again starts from the manifest before its
own and replaces what it left; folders that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger, shared

#: Bits of a piece, bits of a key in its piece, and keys a piece at which the filter is made anew with twice the pieces.
PIECE_BITS, KEY_BITS, PIECE_KEYS = 32768, 4, 3000
#: Pieces up to which the filter is broadcast, 64 MB; beyond that items and pieces meet by a shuffle of keys.
BROADCAST_PIECES = 16384


def spot(key: Column, pieces: int) -> Column:
    """The piece of a key."""
    return F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")


def positions(key: Column) -> list[Column]:
    """The places of a key's bits in its piece."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(PIECE_BITS - 1)) for k in range(KEY_BITS)]


def may_hold(bits: Column, key: Column) -> Column:
    """Whether all bits of a key are set; false without a piece."""
    byte = lambda p: F.conv(F.hex(F.substring(bits, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    all_set = F.lit(True)
    for p in positions(key):
        all_set &= F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1
    return F.coalesce(all_set, F.lit(False))


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    rows: int


class KeyLedger:
    """Entries (key, seq, batch) in a folder. With ``tail``, only the last so many by seq count, and merging drops those before them."""

    def __init__(self, folder: str, key_type: str = "string", buckets: int = 32, fan: int = 8, tail: int | None = None):
        self.folder, self.buckets, self.fan, self.tail = folder.rstrip("/"), buckets, fan, tail
        self.schema = f"key {key_type}, seq bigint, batch bigint, bucket int"

    # Manifests

    def _numbers(self, spark: SparkSession, of: str) -> list[str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{of}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict:
        """The newest manifest of a batch before a number, an empty one if there is none."""
        found = [n for n in self._numbers(spark, "manifest") if before is None or int(n) < before]
        for name in reversed(found):
            rows = spark.read.text(f"{self.folder}/manifest/{name}").collect()
            if rows:  # else its batch ended while it was being written
                return json.loads(rows[0][0])
        return {"batch": None, "runs": [], "filter": None, "pieces": 0, "note": None}

    def entries(self, spark: SparkSession, before: int | None = None, among: list[int] | None = None) -> DataFrame:
        """key, seq, batch of all entries, or of those in some buckets."""
        runs = self.manifest(spark, before)["runs"]
        if not runs:
            return spark.createDataFrame([], self.schema).drop("bucket")
        return self._read(spark, [Run(**r) for r in runs], among)

    # Looking up

    def met(self, items: DataFrame, key: str = "key", before: int | None = None) -> DataFrame | None:
        """The entries of the keys of items; None if none can have one. Runs are read only for items that the filter doesn't rule out."""
        spark = items.sparkSession
        now = self.manifest(spark, before)
        if not now["runs"]:
            return None
        keys = items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
        pieces = spark.read.schema("piece int, bits binary").parquet(f"{self.folder}/filter/{now['filter']}")
        met = keys.withColumn("piece", spot(F.col("key"), now["pieces"])).join(F.broadcast(pieces) if now["pieces"] <= BROADCAST_PIECES else pieces, "piece")
        maybe = shared.kept(met.where(may_hold(F.col("bits"), F.col("key"))).select("key", F.pmod(F.col("piece"), F.lit(self.buckets)).alias("bucket")).distinct())
        touched = [r[0] for r in maybe.select("bucket").distinct().collect()]  # at most as many as buckets
        if not touched:
            return None
        # With a tail, what counts depends on all entries, of which merging leaves few.
        there = self.entries(spark, before, touched) if self.tail is None else ledger.tail(self.entries(spark, before), self.tail, "seq")
        return there.join(maybe.select("key"), "key", "left_semi")

    def exclude(self, items: DataFrame, key: str = "key", before: int | None = None) -> DataFrame:
        """items whose key has no entry; items without a key stay."""
        found = self.met(items, key, before)
        return items if found is None else ledger.exclude(items, found, key, "key")

    # Adding

    def add(self, entries: DataFrame, number: int, note: str | None = None) -> None:
        """Enters (key, seq) of one batch, null keys left out; of a key twice the greatest seq counts. ``note`` is kept in the manifest."""
        spark = entries.sparkSession
        was = self.manifest(spark, number)
        once = entries.where("key IS NOT NULL").groupBy("key").agg(F.max("seq").alias("seq")).withColumn("batch", F.lit(number).cast("bigint"))
        rows = self._write(once, f"{number}")
        fresh = Run(f"{number}", 0, rows)
        runs = [Run(**r) for r in was["runs"]] + ([fresh] if rows else [])
        pieces, name = was["pieces"] or self.buckets, was["filter"]
        total = sum(r.rows for r in runs)
        if rows:
            grown = pieces
            while total > grown * PIECE_KEYS:
                grown *= 2
            known = self._read(spark, runs if grown != pieces else [fresh])
            bits = self._bits(known, grown)
            if grown == pieces and was["filter"] is not None:
                bits = spark.read.schema("piece int, bits binary").parquet(f"{self.folder}/filter/{was['filter']}").unionByName(bits).groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits"))
            pieces, name = grown, f"{number}"
            bits.write.mode("overwrite").parquet(f"{self.folder}/filter/{name}")
        runs = self._merged(spark, runs, number)
        left = {"batch": number, "runs": [r.__dict__ for r in runs], "filter": name, "pieces": pieces, "note": note}
        spark.createDataFrame([(json.dumps(left),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{number:012d}")
        self._clean(spark, [was, left])

    def _read(self, spark: SparkSession, runs: list[Run], among: list[int] | None = None) -> DataFrame:
        every = spark.read.schema(self.schema).option("basePath", f"{self.folder}/runs").parquet(*[f"{self.folder}/runs/run={r.name}" for r in runs])
        return (every if among is None else every.where(F.col("bucket").isin(among))).select("key", "seq", "batch")

    def _write(self, entries: DataFrame, name: str) -> int:
        """One file a bucket, more where a bucket has many entries; how many entries there are."""
        path = f"{self.folder}/runs/run={name}"
        # The number of pieces is a multiple of that of buckets, so a key keeps its bucket when the filter grows.
        split = entries.withColumn("bucket", F.pmod(spot(F.col("key"), self.buckets), F.lit(self.buckets)))
        split.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(path)
        return entries.sparkSession.read.schema(self.schema).parquet(path).count()

    def _bits(self, entries: DataFrame, pieces: int) -> DataFrame:
        each = entries.select(spot(F.col("key"), pieces).alias("piece"), F.explode(F.array(*positions(F.col("key")))).alias("bit"))
        return each.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def _merged(self, spark: SparkSession, runs: list[Run], number: int) -> list[Run]:
        """runs, with each level's merged into one of the next where ``fan`` of them have come together."""
        level = 0
        while any(r.level >= level for r in runs):
            own = [r for r in runs if r.level == level]
            if len(own) >= self.fan:
                # Of a key the last entry: an earlier one has fallen off the tail, else the key wouldn't have been entered again.
                every = self._read(spark, own).groupBy("key").agg(F.max(F.struct("seq", "batch")).alias("e")).select("key", "e.seq", "e.batch")
                if self.tail is not None:
                    every = ledger.tail(every, self.tail, "seq")
                name = f"{number}.{level + 1}"
                runs = [r for r in runs if r.level != level] + [Run(name, level + 1, self._write(every, name))]
            level += 1
        return runs

    def _clean(self, spark: SparkSession, manifests: list[dict]) -> None:
        named = {"manifest": {f"{m['batch']:012d}" for m in manifests if m["batch"] is not None}, "filter": {m["filter"] for m in manifests}, "runs": {f"run={r['name']}" for m in manifests for r in m["runs"]}}
        newest = max(m["batch"] for m in manifests if m["batch"] is not None)
        for of, keep in named.items():
            for name in self._numbers(spark, of):
                # What a later batch has left belongs to a run that is being replayed, and is replaced in its turn.
                if name not in keep and int(name.removeprefix("run=").split(".")[0]) <= newest:
                    shared.remove(spark, f"{self.folder}/{of}/{name}")
