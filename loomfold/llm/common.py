"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..operators.shared import small_batches  # noqa: F401  the queries take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only on one machine, as in tests, may that be unset: a
    temporary folder is taken then and set as the checkpoint folder. On a cluster an error is raised, as a
    folder of the driver's own wouldn't be seen by executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomfold-checkpoint-"))
    return named or context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared folder: a lost executor costs no rerun of what made it, and plans stay short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the table of a pinned df that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.pinned_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that a broadcast side has at most, as its values count.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows and ``most_bytes`` bytes; beyond that it is left to a shuffled join.

    Numbers count eight bytes, strings and binaries their length and sixteen. df should be cheap to
    count: pinned, or a small aggregate.
    """
    long = [f.name for f in df.schema if isinstance(f.dataType, StringType | BinaryType)]
    size = F.lit(8 * len(df.columns) + 16 * len(long)).cast("long")
    for c in long:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df, pinned, with a column for each of ``sums`` (name: column): the sum of the column up to and with the row, in ``order``.

    Rows are laid out in ranges of ``order``, summed up range by range side by side, and moved by the
    sums of the ranges before; of these there are as many as shuffle partitions. Order has to tell rows apart.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = pinned(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = laid.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ahead = ahead.select("_range", *[F.coalesce(F.sum(f"_{n}").over(whole), F.lit(0)).alias(f"_{n}") for n in sums])
    moved = laid.join(F.broadcast(ahead), "_range").select(*df.columns, *[(F.sum(c).over(upto) + F.col(f"_{n}")).alias(n) for n, c in sums.items()])
    out = pinned(moved)
    released(laid)
    return out


def lean(run: Callable) -> Callable:
    """run, giving back to the system at its end the memory that a worker would otherwise keep for the next task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def lower_az(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under names of their own; null text counts as empty."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lowered(column: pa.Array) -> pa.Array:
    """A-Z lower-cased; null counts as empty."""
    return pc.ascii_lower(column.fill_null(""))


def train_row(id_column: Column) -> Column:
    """Whether a row may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return ~held_out(id_column)


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2
