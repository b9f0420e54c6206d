"""Exact deduplication by progressive refinement.

Rows are grouped by length, the groups that survive by a hash of the first characters as well, and
only rows of groups that still have company get a hash of the full content.

Which groups survive goes to the scan of the texts as a bitmap of a fixed number of bits, so the
same plan serves any number of groups, and texts are never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import bounded, id_text, lower_az, lowered, pinned, released, texts_of


@arrow_udf(StringType())
def content_sha256(text: pa.Array) -> pa.Array:
    """Lowercase hex SHA-256 of the UTF-8 of the text with A-Z lower-cased; null stays null."""
    there = text.is_valid().to_pylist()
    return pa.array([hashlib.sha256(x).hexdigest() if ok else None for x, ok in zip(texts_of(lowered(text)), there, strict=True)], pa.string())


#: Pieces of the bitmap of surviving groups, of 32768 bits each: 2^27 bits, 16 MB, are the most that is broadcast.
PIECES = 4096


def bitmap_spot(n_bytes: Column, prefix: Column) -> tuple[Column, Column]:
    """The piece of the bitmap and the bit in it of a (length, prefix hash)."""
    h = F.xxhash64(n_bytes, prefix)
    return F.pmod(h, F.lit(PIECES)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(32768)).cast("int")


def bitmap_of(keys: DataFrame) -> DataFrame:
    """piece, bits of (n_bytes, prefix); pieces without a bit are left out."""
    piece, bit = bitmap_spot(F.col("n_bytes"), F.col("prefix"))
    return keys.select(piece.alias("piece"), bit.cast("long").alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))


def refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, broadcast_keys: int, digest_all: bool) -> DataFrame:
    """id, n_bytes, prefix, full, digest of every row; ``full`` is empty and ``digest`` null where no other row has the same length and prefix.

    The two coarse levels are decided on a narrow table (three numbers a row). The keys that survive
    them go to the scan of the texts as a bitmap, and only texts whose key is marked in it are hashed. With k keys about k in 2^27 of the
    others are marked by chance and hashed too; the keys themselves, joined to the narrow rows that come of the scan, take them out again.
    ``digest_all`` has the hash of every row in ``digest``, for callers that ask for it; the groups come from ``full`` all the same.
    """
    rows = id_text(docs, id_col, text_col).select(
        "id", "text", F.octet_length("text").alias("n_bytes"), F.xxhash64(lower_az(F.substring("text", 1, prefix_chars))).alias("prefix")
    )
    narrow = pinned(rows.drop("text"))
    lengths = pinned(narrow.groupBy("n_bytes").count().where("count > 1").select("n_bytes"))
    keys = pinned(narrow.join(bounded(lengths, broadcast_keys), "n_bytes").groupBy("n_bytes", "prefix").count().where("count > 1").select("n_bytes", "prefix", F.lit(True).alias("alike")))
    released(narrow)
    released(lengths)
    text = F.col("text")
    if not digest_all:
        piece, bit = bitmap_spot(F.col("n_bytes"), F.col("prefix"))
        rows = rows.withColumns({"piece": piece, "bit": bit}).join(F.broadcast(bitmap_of(keys)), "piece", "left")
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        text = F.when(F.getbit(byte, F.col("bit") % 8) == 1, text)
    # Pinned, so that the join reads from a table and a hot key can be split.
    hashed = pinned(rows.select("id", "n_bytes", "prefix", content_sha256(text).alias("digest"))).join(bounded(keys, broadcast_keys), ["n_bytes", "prefix"], "left")
    full = F.when(F.col("alike"), F.col("digest"))
    return hashed.select("id", "n_bytes", "prefix", F.coalesce(full, F.lit("")).alias("full"), (F.col("digest") if digest_all else full).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, broadcast_keys: int = 500_000, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id stays; a null id is the smallest. Null text counts as empty, and empty texts equal each other.
    Of rows with the same id and text exactly one is kept. ``digest`` (SHA-256) is null where length
    and prefix alone showed that a row has no equal, unless ``digest_all``. An empty table gives an
    empty result; other columns of docs are not read, whatever their names.
    """
    key = ["n_bytes", "prefix", "full"]
    rows = refined(docs, id_col, text_col, prefix_chars, broadcast_keys, digest_all)
    counted = pinned(rows.groupBy(*key, "id").agg(F.count("*").alias("n"), F.first("digest").alias("digest")))
    # Pinned, so that the join reads both sides straight from an exchange and a hot group can be split.
    groups = pinned(counted.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1"))
    out = counted.join(groups, key, "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    out = out.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest"
    )


def keep_one_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, broadcast_keys: int = 500_000) -> DataFrame:
    """The rows of docs, all columns, that ``exact_dedup`` keeps.

    Rows are dropped by an anti-join with the ids of the others, or, where ids repeat, with their numbers: a row's partition and
    place in it. So docs has then to lie in the same partitions each time it is read, as a table does. Of rows with the same id
    and text the last one stays. Which rows go is decided on narrow rows either way; a text is hashed in full only as in ``exact_dedup``.
    """
    nth = "_nth"
    while nth in docs.columns:
        nth += "_"
    numbered = docs.withColumn(nth, F.monotonically_increasing_id())
    rows = numbered.select(F.struct(numbered[id_col].alias("id"), numbered[nth].alias("nth")).alias("row"), numbered[text_col].alias("text"))
    decided = pinned(exact_dedup(rows, "row", "text", prefix_chars, broadcast_keys, digest_all=False))
    repeats = not decided.groupBy("row.id").count().where("count > 1").isEmpty()
    if repeats:
        dropped = decided.where("NOT kept").select(F.col("row.nth").alias("_gone"))
        return numbered.join(bounded(dropped, broadcast_keys), numbered[nth] == dropped["_gone"], "left_anti").drop(nth)
    dropped = decided.where("NOT kept").select(F.col("row.id").alias("_gone"))
    return docs.join(bounded(dropped, broadcast_keys), docs[id_col].eqNullSafe(dropped["_gone"]), "left_anti")
