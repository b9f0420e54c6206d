"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, hard_negatives, language_id, merkle, mixing, near_dedup, ogg, sentence_pieces, sharding, toxicity, url_filter, warc
from .common import held_out, small_batches, train_row

#: The rules of op2, as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SHARDS = 40


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return read.select(number("record").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(train_row(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(train_row(F.col("doc_id"))))
    return language_id.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.with_media(table(spark, sf_dir, "documents")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf_hash([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in columns])
    made = merkle.build(docs, columns, "lang", "doc_id", carry={"claimed": F.when(tampered, changed)})
    found = merkle.verify(merkle.proofs(made), made.root, F.coalesce("claimed", "h"))
    return found.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(made.root).alias("root"), F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", moved.alias("label"), (F.col("vec_id") % 50 == 0).alias("asked"))
    return hard_negatives.mine(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_bpe, op4_warc, op5_near_dedup, op6_mixing, op7_toxicity, op8_sharding, op9_language_id, op10_ogg, op11_sentencepiece, op12_merkle, op13_hard_negatives)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_OP2 = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id,
             CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1)")} ELSE '' END AS host,
             CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
m AS (SELECT u.page_id, u.host, u.path, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY u.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth
      FROM u LEFT JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""

_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
bits AS (SELECT *, CAST(CAST(unhex(s) AS BIT) AS VARCHAR) AS z, max(page_id) OVER (PARTITION BY s, n) AS keeper FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(16 * CAST(substr(z, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(z, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(z, 5 * i + 3, 1) AS INT)
                + 2 * CAST(substr(z, 5 * i + 4, 1) AS INT) + CAST(substr(z, 5 * i + 5, 1) AS INT) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM bits
"""


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: crc32 of digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""
_OP12 = f"""
WITH RECURSIVE l AS (
    SELECT doc_id, lang, leaf, coalesce(CASE WHEN {_CRC} % 7 = 0 THEN changed END, leaf) AS claimed, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM (SELECT *, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS changed FROM documents)),
nodes AS (
    SELECT tree, 0 AS level, pos, n AS width, leaf AS h FROM l
    UNION ALL
    SELECT tree, level + 1, pos // 2, (any_value(width) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE width > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree AS pos, h, count(*) OVER () AS n FROM nodes WHERE width = 1),
tops AS (
    SELECT 0 AS level, pos, n AS width, h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (any_value(width) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE width > 1 GROUP BY level, pos // 2),
way AS (
    SELECT doc_id, leaf, tree, 0 AS level, pos, n AS width, claimed AS h, '' AS siblings, l.tree AS own, pos AS place FROM l
    UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.pos // 2, (w.width + 1) // 2,
           sha256(CASE WHEN s.h IS NULL THEN w.h WHEN s.pos < w.pos THEN s.h || w.h ELSE w.h || s.h END), w.siblings || coalesce(s.h, ''), w.own, w.place
    FROM way w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.width > 1),
high AS (
    SELECT w.doc_id, w.leaf, 0 AS level, w.tree AS pos, s.n AS width, w.h, w.siblings, s.h AS subroot FROM way w JOIN subroots s ON s.pos = w.tree WHERE w.width = 1
    UNION ALL
    SELECT w.doc_id, w.leaf, w.level + 1, w.pos // 2, (w.width + 1) // 2,
           sha256(CASE WHEN s.h IS NULL THEN w.h WHEN s.pos < w.pos THEN s.h || w.h ELSE w.h || s.h END), w.siblings || coalesce(s.h, ''), w.subroot
    FROM high w LEFT JOIN tops s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.width > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(siblings) AS proof_sha256, high.h AS folded_root, high.h = r.h AS verified
FROM high JOIN (SELECT h FROM tops WHERE width = 1) r ON high.width = 1
"""

_OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": _OP13, "op12_merkle": _OP12, "op1_exact_dedup": _OP1, "op2_url_filter": _OP2, "op4_warc": _OP4}
