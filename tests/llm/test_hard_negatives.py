"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest

from loomfold.llm import hard_negatives
from loomfold.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, norm int, part int, top string"


def brute(rows):
    known = []
    for i, (vec_id, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in ints) < 1 << 62:
            known.append((i, vec_id, label, ints))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, vec_id, label, v in known:
        if vec_id is None or vec_id % 50:
            continue
        others = [(dot(v, w), other, own) for j, other, own, w in known if j != i]
        near = sorted((x for x in others if x[2] == label), key=order)[:5]
        for score, other, _ in near:
            far = sorted((x for x in others if x[2] != label and 50 * score <= 100 * x[0] <= 95 * score), key=order)[:3]
            out += [(vec_id, other, k + 1, x[1], score, x[0]) for k, x in enumerate(far)]
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in op13_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def some(n, dims=6, seed=1, scale=lambda r: 1.0):
    r = random.Random(seed)
    return [(i * 5, [scale(r) * round(r.uniform(-0.3, 1), 1) for _ in range(dims)], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("bucket", "pack", "slices", "groups"), [(1024, 256, 8, 4), (7, 3, 2, 2), (1, 1, 1, 1)])
def test_search_is_brute_force(spark, tmp_path, monkeypatch, bucket, pack, slices, groups):
    for name, value in (("BUCKET_ROWS", bucket), ("PACK_ROWS", pack), ("SLICE_BUCKETS", slices), ("GROUP_PACKS", groups)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some(120, scale=lambda r: r.choice([0.1, 1.0, 4.0]))
    found = got(spark, rows, tmp_path)
    assert len(found) > 50
    assert found == brute(rows)


def test_nulls_ties_repeats_and_odd_vectors(spark, tmp_path):
    rows = some(60, seed=2) + [(50, [1.0] * 6, 1)] * 30 + [(50, [0.7] * 6, 2)] * 8 + [(None, [0.9] * 6, 1), (None, [0.6] * 6, 3)]
    rows += [(100, None, 1), (100, [0.5, None], 1), (100, [float("nan")], 1), (150, [float("inf")], 2), (200, [0.5] * 6, None), (100, [], 1), (150, [0.8], 2), (150, [0.9] * 9, 2), (1, [-1.0] * 6, 3)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark, tmp_path):
    r = random.Random(4)
    rows = [(i * 10, [r.uniform(0, 1) * 2.0**21 for _ in range(5)], i % 3) for i in range(40)] + [(0, [3e30], 1), (50, [1e7] * 5, 1)]
    found = got(spark, rows, tmp_path)
    assert max(x[4] for x in found) > 1 << 53
    assert found == brute(rows)


@pytest.mark.parametrize("rows", [[], [(50, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(50, [1.0], 1), (51, [1.0], 1), (52, [0.7], 2)], [(50, [0.0], 1), (51, [0.0], 1), (52, [0.0], 2)], [(50, [1.0], 1), (51, [-1.0], 1), (52, [-0.7], 2)]])
def test_few_rows(spark, tmp_path, rows):
    assert got(spark, rows, tmp_path) == brute(rows)


def test_buckets_below_the_bound_are_not_scored(monkeypatch):
    pack = lambda rows, low=None, high=None: {
        "top": max(np.sqrt(v @ v) for _, _, v in rows), "uids": np.array([u for u, _, _ in rows], "<i8").tobytes(), "ids": np.array([u for u, _, _ in rows], "<i8").tobytes(), "labels": np.array([x for _, x, _ in rows], "<i8").tobytes(),
        "norms": np.array([np.sqrt(v @ v) for _, _, v in rows], "<f8").tobytes(), "dims": 2, "vecs": np.array([v for _, _, v in rows], "<i8").tobytes(), "lows": b"" if low is None else np.array([[low]], "<i8").tobytes(), "highs": b"" if high is None else np.array([[high]], "<i8").tobytes(),
    }
    anchor = (0, 1, np.array([10, 0]))
    buckets = [pack([(10 * b + i, i % 2, np.array([100 - 10 * b, i])) for i in range(1, 9)]) for b in range(9)]
    for search in (hard_negatives.Search([pack([anchor])], 2, True, 1), hard_negatives.Search([pack([anchor], 650, 2000)], 3, False, 1)):
        for b in buckets:
            search.take(b)
        assert search.scored < 40 if search.same_label else search.scored <= 40
        assert search.score[0, 0].tolist() == ([1000, 1000] if search.same_label else [1000, 1000, 1000])
        assert search.found[0, 0].tolist() == ([1, 3] if search.same_label else [2, 4, 6])
