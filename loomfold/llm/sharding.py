"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the order of ids. The permutation is a Feistel network over pairs
(l, r) with l below a and r below b, where a*b is the least such product that holds all rows, so
walking past the end is rare: a number that the network sends past the last row is sent through it
again until it lands on a row. Shard and slot follow from the permuted number by a division, so
either can be computed for any row without a pass over the others.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

#: Fixed values of the round function: multipliers below 2^31 and two primes.
ROUND_A, ROUND_P, ROUND_B, ROUND_Q = 1597334677, 2147483647, 1181783497, 2147483629
ROUNDS = 6
#: Steps that the walk may take. A step stays past the end with a chance of about 1 / sqrt(rows).
WALK = 64


class Feistel:
    """The permutation of 0..n-1 that a seed gives; ``at`` computes it for one number without Spark."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.a = n, max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        source = random.Random(seed)
        self.keys = [source.randrange(1 << 30) for _ in range(ROUNDS)]

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, k in enumerate(self.keys):
            if i % 2 == 0:
                left = (left + (right + k) * ROUND_A % ROUND_P * ROUND_B % ROUND_Q) % self.a
            else:
                right = (right + (left + k) * ROUND_A % ROUND_P * ROUND_B % ROUND_Q) % self.b
        return left * self.b + right

    def at(self, x: int) -> int:
        x = self.once(x)
        while x >= self.n:
            x = self.once(x)
        return x

    def mixed(self, value: Column, key: Column) -> Column:
        return (value + key) * F.lit(ROUND_A) % F.lit(ROUND_P) * F.lit(ROUND_B) % F.lit(ROUND_Q)

    def columns(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """df with the permuted number; one projection a round, so no expression is computed twice."""
        a, b, n = F.lit(self.a), F.lit(self.b), F.lit(self.n)
        df = df.withColumns({"_l": F.floor(F.col(number) / b).cast("long") if self.n < 1 << 52 else F.expr(f"{number} div {self.b}"), "_r": F.col(number) % b})
        for i, k in enumerate(self.keys):
            if i % 2 == 0:
                df = df.withColumn("_l", (F.col("_l") + self.mixed(F.col("_r"), F.lit(k).cast("long"))) % a)
            else:
                df = df.withColumn("_r", (F.col("_r") + self.mixed(F.col("_l"), F.lit(k).cast("long"))) % b)
        keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(self.keys)])

        def one_round(acc, x):
            return F.struct(
                F.when(x["left"], (acc["l"] + self.mixed(acc["r"], x["k"])) % a).otherwise(acc["l"]).alias("l"),
                F.when(x["left"], acc["r"]).otherwise((acc["r"] + self.mixed(acc["l"], x["k"])) % b).alias("r"),
            )

        def again(x):
            start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
            return F.aggregate(keys, start, one_round, lambda acc: acc["l"] * b + acc["r"])

        df = df.withColumn("_x", F.col("_l") * b + F.col("_r"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_x"), lambda x, _: F.when(x < n, x).otherwise(again(x)))
        df = df.withColumn(out, F.when(F.col("_x") < n, F.col("_x")).otherwise(walked))
        return df.drop("_l", "_r", "_x").withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("the walk did not end"))))


def numbered(rows: DataFrame, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """rows with gapless numbers from 0 in the order given, and how many there are.

    Rows are range-partitioned and sorted; a row's place in its partition plus the rows before that
    partition is its number. No task holds more than its range, and a last, arbitrary key splits rows
    that are alike in all columns, which may take any of their numbers. The sorted rows are pinned,
    since ranges are sampled and a second run could cut them elsewhere.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = pinned(spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row a partition.
    before = sizes.select("_part", "_n", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(number, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_n", "_before", "_at"), total


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, row_number, position, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 16 (null text: 16, and the checksum of empty text).
    Shards' row counts differ by one at most; slots of a shard are gapless from 0. Null ids come
    first in the numbering; rows with the same id follow by size and checksum, and rows alike in all
    three may take each other's place. Equal texts are not held together: a group of a third of all
    rows could not keep the counts even. An empty table gives an empty result.
    """
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted, total = numbered(rows, ["id", "size", "text_crc32"])
    dealt = Feistel(total, seed).columns(counted, "row_number", "position")
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32", "row_number", "position",
        (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )
