"""The pipeline's stages on a small corpus, and the registered queries on the smallest tables."""

import collections
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfold.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
            assert 0 < len(kept) <= before
            before = len(kept)
        if name == "exact_dedup":
            texts = [r.text.lower() for r in out.collect()]
            assert len(texts) == len(set(texts))
        if name == "mixing":
            assert max(collections.Counter(r.doc_id for r in out.collect()).values()) <= 2
        docs = out
    assert docs.where("NOT round_trip").count() == 0
    assert docs.count() > 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, SF)
        want = con.sql(sql)
        order = sorted(found.columns)
        assert order == sorted(want.columns)
        at = [want.columns.index(c) for c in order]
        assert collections.Counter(tuple(r[c] for c in order) for r in found.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())


ODD = [
    (1, "the same words in a row here and there", "en", "a", 1), (1, "the same words in a row here and there", "en", "a", 1), (2, "The SAME words in a row here and there", None, None, None), (None, "the same words in a row here and there", "en", "a", 2),
    (None, None, None, None, None), (None, "", "", "", 0), (3, None, "de", "b", None), (4, "word " * 60_000, "fr", "b", 300_000), (5, "a b c d e f g h i j k l m n o p q r s t", "en", "c", 1), (6, "a b c d e f g h i j k l m n o p q r s t u", "en", "c", 1),
]
CLASHING = ["label", "draw", "kept", "keep_id", "rep", "grp", "slot", "place", "size", "taken", "nth", "digest", "pick", "of"]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_nulls_repeats_and_clashing_names(spark, tmp_path, rows):
    """Every stage, on rows with nulls in every column, repeated and empty and long ones, and with columns named like the operators' own."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([(5, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns
            assert all(r[c] == c for r in docs.collect() for c in CLASHING)
            kept[name] = collections.Counter((r.doc_id, (r.text or "").lower()) for r in docs.collect())
    if not rows:
        assert docs.count() == 0
        return
    same = "the same words in a row here and there"
    assert sum(kept["toxicity"].values()) == len(rows)
    assert {k[0]: n for k, n in kept["exact_dedup"].items() if k[1] == same} == {2: 1}
    assert [k[0] for k in kept["exact_dedup"] if k[1] == ""] == [3]
    assert {k[0] for k in kept["near_dedup"]} == {2, 3, 4, 5}
    assert docs.where("NOT round_trip").count() == 0


def test_stages_on_copies_are_brute_force(spark, tmp_path):
    """The deduplicating stages keep what their definitions say, on the smallest table with its copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = corpus_pipeline.drop_copies(spark, docs, SF)
    largest = {}
    for r in docs.collect():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        largest[key] = max(largest.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(largest.values())
    exact.write.parquet(str(tmp_path / "exact"))
    exact = spark.read.parquet(str(tmp_path / "exact"))
    sets, root = {}, {}
    for r in exact.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        root[r.doc_id] = r.doc_id

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    near = corpus_pipeline.drop_near_copies(spark, exact, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i in ids if find(i) == i)
