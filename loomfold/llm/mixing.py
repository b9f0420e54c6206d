"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w with u from a hash of its id and w its quality
weight. Within a source documents are taken in the order of keys until the source's budget of tokens
is spent; where the budget holds the whole source once or more, complete epochs come first and the
selection is for the rest.

No source is ever sorted as a whole. A key's place among keys is a number of 47 bits; sums over its
first bits show in which slot the budget ends, sums over more bits of the rows in that slot alone show
where in it, and so on. Slots before the last are taken whole, and only what is left in the last one,
rows whose keys agree in 36 bits, is put in order. That holds for any weights, however far apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bounded, pinned, released, running_sums, texts_of

#: Bits of a key's place, and how many of them each round of sums adds to a slot.
PLACE_BITS, ROUND_BITS = 47, (12, 12, 12)
#: Sources up to which what is known of each, a few numbers, is settled on the driver; of more it is settled by tables.
FEW_SOURCES = 4096
#: Words in a stretch of which the share of distinct ones is taken.
STRETCH = 64


@arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """How many runs of characters other than space and U+0009 to U+000D; null text has none."""
    return pa.array([len(t.split()) for t in texts_of(text)], pa.int64())


def variety(words: list[bytes]) -> float:
    """The share of words in a stretch of 64 that are no repeats, on average over stretches that cover the text; so it doesn't fall with a text's length."""
    if len(words) <= STRETCH:
        return len(set(words)) / max(1, len(words))
    starts = [*range(0, len(words) - STRETCH, STRETCH), len(words) - STRETCH]
    return sum(len(set(words[i : i + STRETCH])) for i in starts) / (STRETCH * len(starts))


@arrow_udf(StructType([StructField("size", LongType()), StructField("quality", DoubleType())]))
def words_and_quality(text: pa.Array) -> pa.Array:
    """``word_count``, and the default quality weight: a tenth plus the text's ``variety``."""
    sizes, weights = [], []
    for t in texts_of(text):
        words = t.split()
        sizes.append(len(words))
        weights.append(0.1 + variety(words))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], ["size", "quality"])


def uniform(column: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(column.cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def place_of(key: Column) -> Column:
    """A key's place as a whole number of 47 bits that grows with the key: its logarithm, of which keys from 1e-27 to 1e27 have all bits."""
    most = (1 << PLACE_BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.log(key) + 64) * float(1 << (PLACE_BITS - 7))))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with ``target``, pinned.

    In the order of code points, null last, sources weigh ``weights`` in turn and share ``share`` of
    all sizes; no target exceeds ``cap`` times its source, the excess going to the others by weight.
    That ends where every source has the lesser of its cap and its weight times one level, so the
    level is found by running sums over sources in the order in which they reach their caps. Sums run
    over ranges of sources side by side, and then over the ranges. Sizes and weights that are whole numbers sum up exactly, in any order.
    """
    ranked = running_sums(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"}).drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("level", F.col("source_size") * F.lit(cap) / F.col("weight"))
    sums = running_sums(ranked, [F.col("level"), F.col("rank")], {"size_upto": "source_size", "weight_upto": "weight"})
    size, heavy = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    # The level if this source and those after it stay under their caps; the first source for which that holds has the right one.
    before = (F.col("size_upto") - F.col("source_size")) * F.lit(cap)
    common = (F.lit(float(size or 0) * share) - before) / (F.lit(float(heavy or 0)) - F.col("weight_upto") + F.col("weight"))
    first = sums.withColumn("common", common).where("common <= level").agg(F.min(F.struct("level", "rank", "common"))).first()[0]
    full = F.col("source_size") * F.lit(cap)
    return sums.select("source", "source_size", (full if first is None else F.least(full, F.col("weight") * F.lit(first["common"]))).cast("double").alias("target"))


def few_targets(sources: list, weights: tuple[int, ...], share: float, cap: float) -> list[tuple]:
    """(source, source_size, target) of a few sources (source, source_size), as ``targets`` has them."""
    order = sorted(sources, key=lambda r: (r[0] is None, r[0] if r[0] is not None else ""))
    known = [(size * cap / float(weights[k % len(weights)]), k, float(weights[k % len(weights)]), size) for k, (_, size) in enumerate(order)]
    before, heavy, total, common = 0.0, sum(x[2] for x in known), float(sum(x[3] for x in known)) * share, None
    for level, _, weight, size in sorted(known):
        if (total - before) / heavy <= level:
            common = (total - before) / heavy
            break
        before, heavy = before + size * cap, heavy - weight
    return [(source, size, size * cap if common is None else min(size * cap, known[k][2] * common)) for k, (source, size) in enumerate(order)]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality_col: str | None = None, seed: int = 0, cut_last: bool = True, broadcast_sources: int = 200_000) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, epochs, selected, taken.

    ``size`` is the number of words; ``taken`` how many of a document's words the mix takes, repeats
    counted: ``epochs`` times its size, plus the size of documents that the rest of the budget
    selects. The document at which the budget ends gives as many of its first words as are left, or,
    without ``cut_last``, comes whole if more than half of it fits and else not at all. The quality
    weight is ``quality_col`` (null or not positive counts as the least weight, 1e-6) or, without one, the
    share of words that are no repeats, in stretches of 64. Null text has size 0 and takes nothing; null sources are a source of
    their own, the last; rows without an id are told apart by a hash of their text. Rows that repeat an id, or a text without one, have the same key and are taken one after the other; they are put
    in order by one task where the budget ends among them. A rerun gives the same
    result, wherever rows lie. An empty table gives an empty result; other columns of docs are not read, whatever their names.
    """
    read = words_and_quality(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), read.alias("read"), F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col])).alias("text_hash"), (F.lit(None).cast("double") if quality_col is None else docs[quality_col].cast("double")).alias("given"))
    weight = F.col("read.quality") if quality_col is None else F.greatest(F.coalesce(F.nanvl("given", F.lit(0.0)), F.lit(0.0)), F.lit(1e-6))
    key = -F.log(uniform(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\u0000"), F.col("text_hash").cast("string"))), seed)) / weight
    keyed = pinned(rows.select("id", "source", F.col("read.size").alias("size"), key.alias("key")).withColumn("place", place_of(F.col("key"))))
    shift = PLACE_BITS - ROUND_BITS[0]
    slots = pinned(keyed.groupBy("source", F.shiftright("place", shift).alias("slot")).agg(F.sum("size").alias("slot_size")))
    sizes = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    first_few = sizes.limit(FEW_SOURCES + 1).collect()
    few = len(first_few) <= FEW_SOURCES
    spark = docs.sparkSession
    # What has a row a source: of a few sources a local table, which costs no job to read, else one in the shared folder.
    settle = (lambda df: spark.createDataFrame(df.collect(), df.schema)) if few else pinned
    small = F.broadcast if few else lambda df: bounded(df, broadcast_sources)
    if few:
        schema = StructType([slots.schema["source"], StructField("source_size", LongType()), StructField("target", DoubleType())])
        sources = spark.createDataFrame(few_targets(first_few, weights, share, cap), schema)
    else:
        sources = targets(sizes, weights, share, cap)
    budget = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = settle(budget.withColumns({"rest": F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"), "taken_before": F.lit(0).cast("long")}).withColumnRenamed("source", "of"))
    for r, bits in enumerate(ROUND_BITS):
        if r:
            shift -= bits
            at_last = keyed.join(small(plan.select("of", "slot")), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("place", shift + bits) == F.col("slot")))
            slots = at_last.groupBy("source", F.shiftright("place", shift).alias("slot")).agg(F.sum("size").alias("slot_size"))
        # At most 4096 rows a source.
        running = slots.withColumn("before", F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size"))
        meets = running.join(small(plan.select("of", "rest", "taken_before")), F.col("source").eqNullSafe(F.col("of")))
        meets = meets.withColumn("before", F.col("before") + F.col("taken_before")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("slot_size") >= F.col("rest")))
        last = meets.groupBy(F.col("source").alias("source")).agg(F.min(F.struct("slot", "before")).alias("last"))
        was = plan
        plan = plan.drop("slot", "taken_before").join(small(settle(last)), F.col("of").eqNullSafe(F.col("source")), "left")
        plan = settle(plan.select("of", "source_size", "target", "epochs", "rest", F.col("last.slot").alias("slot"), F.col("last.before").alias("taken_before")))
        if not few:
            released(was)
    all_rows = keyed.join(small(plan), keyed["source"].eqNullSafe(plan["of"])).drop("of").withColumn("own", F.shiftright("place", shift))
    # Without a last slot nothing is left to select.
    at_last = F.coalesce(F.col("own") == F.col("slot"), F.lit(False))
    ahead = F.coalesce(F.col("own") < F.col("slot"), F.lit(False))
    whole = all_rows.where(~at_last).withColumns({"extra": F.when(ahead, F.col("size")).otherwise(F.lit(0).cast("long")), "selected": ahead})
    edge = all_rows.where(at_last).withColumn("left", F.col("rest") - F.col("taken_before") - (F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")))
    if cut_last:
        edge = edge.withColumns({"selected": F.col("left") > 0, "extra": F.greatest(F.lit(0), F.least("size", "left"))})
    else:
        fits = (F.col("left") > 0) & (F.col("left") * 2 > F.col("size"))
        edge = edge.withColumns({"selected": fits, "extra": F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long"))})
    return whole.unionByName(edge.select(whole.columns)).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs", "selected", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 500_000, **kwargs) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes each: ``epochs`` times, and once more if selected.

    Documents come whole (``cut_last`` is off); those with null text or source come as their source's others do, and an empty table
    stays empty. Rows that repeat an id all come as often as the one that is taken most. No column's name matters but those read.
    """
    counted = mix(docs, id_col=id_col, cut_last=False, **kwargs)
    times = pinned(counted.groupBy(F.col(id_col).alias("of")).agg(F.max(F.col("epochs") + F.col("selected").cast("long")).alias("times")).where("times > 0"))
    columns = docs.columns
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    joined = plain.join(bounded(times, broadcast_rows), plain[f"c{columns.index(id_col)}"].eqNullSafe(times["of"]))
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
