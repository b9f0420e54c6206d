"""Exact and near deduplication against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from loomfold.llm import common, components, near_dedup
from loomfold.llm import exact_dedup as exact_dedup_module
from loomfold.llm.exact_dedup import exact_dedup, keep_one_of_equals

SCHEMA = "doc_id long, text string"


def az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_documents(n=300, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.5:
            base = (r.choice(docs)[1] or "").split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
                base[r.randrange(len(base))] = r.choice(words)
            text = " ".join(base)
            text = text.upper() if r.random() < 0.1 else text
        else:
            text = " ".join(r.choice(words) for _ in range(r.randrange(1, 120)))
        docs.append((i, text))
    return docs + [(n, None), (n + 1, ""), (n + 2, "   "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "É"), (n + 6, "é"), (n + 7, "x " * 50_000)]


def expected_exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[az(t)].append(i)
    return {i: (max(groups[az(t)]), len(groups[az(t)])) for i, t in docs}


@pytest.mark.parametrize("keys", [500_000, 0])
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_is_brute_force(spark, keys, digest_all):
    docs = some_documents()
    want = expected_exact(docs)
    rows = exact_dedup(spark.createDataFrame(docs, SCHEMA), broadcast_keys=keys, digest_all=digest_all).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == want
    assert {r.doc_id for r in rows if r.kept} == {k for k, _ in want.values()}
    texts = dict(docs)
    for r in rows:
        if digest_all or r.group_size > 1:
            assert r.digest == hashlib.sha256(az(texts[r.doc_id]).encode()).hexdigest()


def test_exact_dedup_digests_do_not_depend_on_the_bound(spark):
    docs = spark.createDataFrame([(1, "alone"), (2, "a pair"), (3, "A pair"), (4, "b pair"), (5, None), (6, "")], SCHEMA)
    small, large = ({(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in exact_dedup(docs, broadcast_keys=n).collect()} for n in (100, 0))
    assert small == large
    assert {r[0] for r in large if r[4] is None} == {1, 4}


@pytest.mark.parametrize("keys", [500_000, 0])
def test_only_surviving_texts_are_hashed(spark, keys, tmp_path, monkeypatch):
    """On both sides of the bound on broadcast keys, the texts that reach the hash are those with company in length and prefix."""
    seen = tmp_path / "seen"

    @arrow_udf(StringType())
    def spying(text: pa.Array) -> pa.Array:
        out = [None if t is None else hashlib.sha256(az(t).encode()).hexdigest() for t in text.to_pylist()]
        with open(seen, "a") as f:
            f.writelines(f"{t}\n" for t in text.to_pylist() if t is not None)
        return pa.array(out, pa.string())

    monkeypatch.setattr(exact_dedup_module, "content_sha256", spying)
    r = random.Random(4)
    docs = [(i, "".join(r.choice("abcdef") for _ in range(r.randrange(2, 60)))) for i in range(400)]
    docs += [(400 + i, text.upper()) for i, (_, text) in enumerate(docs[:60])]
    groups = collections.Counter((len(t), az(t)[:64]) for _, t in docs)
    exact_dedup(spark.createDataFrame(docs, SCHEMA), broadcast_keys=keys).count()
    assert collections.Counter(seen.read_text().split()) == collections.Counter(t for _, t in docs if groups[len(t), az(t)[:64]] > 1)


def test_near_dedup_recall_at_the_threshold(spark):
    """Pairs at exactly 8 of 10, each of words of its own; the docstring's recall leaves 0.0004 misses to expect among 4000."""
    r = random.Random(11)
    docs = []
    for n in range(4000):
        words = [f"p{n}w{k}" for k in range(10)]
        docs += [(2 * n, " ".join(words[:9])), (2 * n + 1, " ".join(r.sample(words[:8] + words[9:], 9)))]
    rows = near_dedup.near_dedup(spark.createDataFrame(docs, SCHEMA), words=1).collect()
    found = sum(x.component_id == x.doc_id - 1 for x in rows if x.doc_id % 2)
    assert found == 4000


def test_trees_count_the_coordinates_that_they_share():
    """The chance of a miss over all numbers of agreeing coordinates, by drawing them."""
    r = np.random.default_rng(1)
    for recall in (0.9, 0.99):
        trees = near_dedup.trees_for(recall, 80)
        s = r.binomial(128, 0.8, 200_000) / 128
        q = np.ones_like(s)
        for _ in range(near_dedup.LEVELS - 1):
            q = 1 - (1 - s * q) ** 2
        assert ((1 - s * q) ** trees).mean() <= (1 - recall) * 1.05
        assert ((1 - s * q) ** (trees - 1)).mean() > (1 - recall) * 0.95
    with pytest.raises(ValueError, match="recall"):
        near_dedup.trees_for(1 - 1e-7, 10)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 0.9])
def test_sketches_and_trees_keep_the_recall(threshold):
    miss = 1e-7
    bits = near_dedup.plausible_bits(threshold, miss / 2)
    p = (1 + threshold) / 2
    fewer = lambda b: sum(math.comb(128, i) * p**i * (1 - p) ** (128 - i) for i in range(b))
    assert fewer(bits) <= miss / 2 < fewer(bits + 1)


def test_exact_dedup_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0
    assert keep_one_of_equals(empty).count() == 0
    rows = [(1, "a", "k"), (1, "a", "k"), (1, "b", "k"), (None, "a", None), (None, None, None), (None, "", "x"), (7, "same", "1"), (8, "SAME", "2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = exact_dedup(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.keep_id is None, r.keep_id or 0, r.group_size) for r in out if r.kept) == [(False, 1, 1), (False, 1, 3), (False, 8, 2), (True, 0, 2)]
    left = keep_one_of_equals(docs)
    assert left.columns == ["doc_id", "text", "kept"]
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in left.collect()) == [(0, ""), (1, "a"), (1, "b"), (8, "same")]


def test_keep_one_without_repeated_ids(spark):
    docs = some_documents()
    want = {k for k, _ in expected_exact(docs).values()}
    assert {r.doc_id for r in keep_one_of_equals(spark.createDataFrame(docs, SCHEMA)).collect()} == want


def test_keep_one_moves_no_texts_where_ids_repeat(spark, monkeypatch, tmp_path):
    """One repeated id, and a third of all rows with the same empty text: nothing but narrow rows is pinned or exchanged."""
    docs = [(i, t, "x", 1) for i, t in some_documents()] + [(7, None, "y", 2), (7, "", "z", 3), (None, "", "z", 4), (7, "text of its own", "z", 5)] + [(1000 + i // 2, "", "w", i) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, _nth string, row int").repartition(3).write.parquet(str(tmp_path / "d"))
    kept, was = [], exact_dedup_module.pinned
    monkeypatch.setattr(exact_dedup_module, "pinned", lambda df: kept.append(df) or was(df))
    out = keep_one_of_equals(spark.read.parquet(str(tmp_path / "d")))
    assert all("text" not in df.columns for df in kept)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan
    got = [(r["doc_id"], az(r["text"])) for r in out.collect()]
    want = {}
    for i, t, *_ in docs:
        want[az(t)] = max(want.get(az(t), -1), -1 if i is None else i)
    assert sorted(got) == sorted((i, t) for t, i in want.items())
    assert out.columns == ["doc_id", "text", "_nth", "row"]


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", az(text)) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def expected_near(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

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
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("words", "leaf", "levels", "block"), [(2, 2000, 6, 2000), (5, 2000, 6, 2000), (2, 4, 2, 7), (2, 2, 3, 5)])
def test_near_dedup_is_brute_force(spark, words, leaf, levels, block):
    """Small leaves, few levels and small blocks take the paths of large data."""
    docs = some_documents(260, seed=words + leaf)
    want = expected_near(docs, words)
    rows = near_dedup.near_dedup(spark.createDataFrame(docs, SCHEMA), words=words, leaf=leaf, levels=levels, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_dedup_chains_and_threshold(spark):
    """A chain of documents of which only neighbours are similar, and pairs at and just under the threshold."""
    base = [f"t{i}" for i in range(101)]
    chain = [(i, " ".join(base[i * 5 : i * 5 + 60])) for i in range(8)]
    at = [(100, " ".join(f"a{i}" for i in range(10))), (101, " ".join(f"a{i}" for i in range(9)))]  # 8 of 9 shingles
    under = [(200, " ".join(f"b{i}" for i in range(6))), (201, " ".join([*(f"b{i}" for i in range(5)), "z"]))]  # 4 of 6
    docs = chain + at + under
    rows = near_dedup.near_dedup(spark.createDataFrame(docs, SCHEMA), words=2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in expected_near(docs, 2).items()}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id < 10} == dict.fromkeys(range(8), 0)


def test_near_dedup_edge_cases(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], SCHEMA), words=2).count() == 0
    docs = spark.createDataFrame([(None, "a b c", "q"), (None, "x y", None), (5, "a b c", None), (5, "d e f", "q"), (6, "D E F", "q"), (9, None, None)], "doc_id long, text string, rep string")
    rows = near_dedup.near_dedup(docs, words=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (6, 5, False), (9, 9, True)]
    assert near_dedup.keep_one_of_near(docs, words=2).columns == ["doc_id", "text", "rep"]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2064)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_agree_on_both_sides(spark):
    a = np.array([-1, 5, -(2**62)], np.int64)
    b = np.array([3, -5, 2**61], np.int64)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "x long, y long").select(near_dedup.agreement(F.col("x"), F.col("y"), F.col("y"), F.col("x")).alias("n")).collect()
    assert [r.n for r in rows] == near_dedup.agreement(a, b, b, a).tolist()


def test_broadcast_bound_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k long, t string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.bounded(df, 50)) and not hinted(common.bounded(df, 49))
    assert hinted(common.bounded(df, 50, 50 * (100 + 16 + 16))) and not hinted(common.bounded(df, 50, 50 * (100 + 16 + 16) - 1))
    assert hinted(common.bounded(df.limit(0), 0))


def test_a_cluster_has_to_name_the_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(10), r.choice(["a", "b", None])) for i in r.sample(range(500), 500)]
    out = common.running_sums(spark.createDataFrame(rows, "k long, n long, s string"), [F.col("s").asc_nulls_last(), F.col("k")], {"upto": "n"}).collect()
    total, want = 0, {}
    for k, n, _ in sorted(rows, key=lambda x: (x[2] is None, x[2] or "", x[0])):
        total += n
        want[k] = total
    assert {x.k: x.upto for x in out} == want
    assert common.running_sums(spark.createDataFrame([], "k long, n long"), [F.col("k")], {"upto": "n"}).count() == 0
