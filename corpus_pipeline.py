"""A corpus pipeline over ``documents``: toxicity, exact dedup, near-dedup, mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from loomfold.llm.common import shared_dir, small_batches, train_row
from loomfold.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows that aren't held out.

    Rows with a null id teach nothing and are judged like others; null text counts as empty; repeated rows stay or
    go together; without labels of both kinds every document has the same score. An empty table stays empty.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs.where(train_row(F.col("doc_id"))), labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, and one of rows that repeat it.

    Null and empty texts equal each other; a null id is the smallest. An empty table stays empty.
    """
    small_batches(spark)
    return exact_dedup.keep_one_of_equals(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their shingles of five words, the one with the smallest id of each group stays.

    Documents without words, or with null text, all stay. Rows that repeat the id that stays all stay; a row with a null id goes if a row
    with an id has its set. An empty table stays empty.
    """
    small_batches(spark)
    return near_dedup.keep_one_of_near(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document that is taken twice comes as two rows.

    Null is a source of its own; null and empty texts have no words, and come as often as their source's epochs. Rows that repeat an id
    all come as often as the one that is taken most. An empty table stays empty.
    """
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to the text.

    Null and empty texts have none. Null and repeated ids are kept. An empty table stays empty.
    """
    small_batches(spark)
    encoded = bpe.encode_and_verify(docs, tokenizer_path())
    return encoded.select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Learned models, samples by a hash and tokenizer files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
