"""Tables between the rounds of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder where that is unset and Spark runs on one machine, else an error."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomfold-shared-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as a table and read again: plans of rounds stay short, and a lost executor costs no earlier round."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def gone(df: DataFrame) -> None:
    """Deletes the table of a kept df that nothing reads any more."""
    remove(df.sparkSession, df.kept_at)


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows, kept, with the sum of ``value`` over those of the same keys up to and with each, in order, which tells them apart.

    Rows are summed up range by range and moved by the sums of the ranges before, of which a key has as many as it fills; so a key may have any
    number of rows.
    """
    laid = kept(rows.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = laid.groupBy("_range", *keys).agg(F.sum(value).alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL").drop("_n")
    made = laid.withColumn(out, F.sum(value).over(own)).join(ahead, ["_range", *keys], "left")
    done = kept(made.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_range", "_before"))
    gone(laid)
    return done


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, in the session that it is given: 1000 rows or 8 MB a batch, whichever is less."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, a few tasks each, for steps that cost far more than reading: narrow rows that compress well fill few splits, however many they are."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(4 * cores, 32))))
