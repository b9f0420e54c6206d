"""The Merkle manifest against trees built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomfold.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, pos int, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    values = [*row[:3], None if row[3] is None else row[3] + add, row[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(bottom):
    out = [bottom]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, pos):
    out = []
    for level in tree[:-1]:
        other = pos ^ 1
        out.append((other < pos, level[other] if other < len(level) else None))
        pos >>= 1
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for pos, r in enumerate(groups[g]):
            way = path(trees[g], pos) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(tampered))
            for left, other in way:
                h = sha(h) if other is None else sha(other, h) if left else sha(h, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[o for _, o in way if o]), h, h == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle(spark, str(folder)).collect()), key=str)


def some_rows(n, langs, seed=1):
    some = random.Random(seed)
    return [(some.choice([i, i, i, 5, None]), some.choice(["a", None, "b:c"]), some.choice(langs), some.choice([None, 3, 70]), some.choice([None, "", "é" * 9, f"text {i}"])) for i in range(n)]


@pytest.mark.parametrize("span", [1, 2, 10])
@pytest.mark.parametrize("langs", [["de", "en", None, "é", "z"], ["en"]])
def test_manifest_is_brute_force(spark, tmp_path, monkeypatch, span, langs):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = some_rows(75, langs) + [(7, "s", "only", 1, "alone")] * (len(langs) > 1)
    assert got(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1025])
def test_sizes(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    assert got(spark, rows, tmp_path) == expected(rows) if n else got(spark, rows, tmp_path) == []


def test_rows_alike_long_texts_and_many_groups(spark, tmp_path):
    rows = [(1, "s", "en", 4, "same")] * 400 + [(2, "s", "en", 9, "long " * 300_000)] + [(i, None, f"l{i}", None, None) for i in range(40)]
    assert got(spark, rows, tmp_path) == expected(rows)


def test_the_store_has_each_level_once(spark):
    docs = spark.createDataFrame([(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(docs)
    sizes = {(r["tree"], r["level"]): r["count"] for r in made.nodes().groupBy("tree", "level").count().collect()}
    want = {(t, k): merkle.width(n, k) for t, n in ((0, 100), (1, 200), (merkle.TOP, 2)) for k in range(1, (n - 1).bit_length() + 1)}
    assert sizes == want
    sides = {r["sides"] for r in merkle.proofs(made).select("sides").collect()}
    assert {len(s) for s in sides} == {8, 9}
    assert made.nodes().select(F.count_distinct("h")).first()[0] == sum(want.values())
