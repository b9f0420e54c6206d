"""Hard negatives by norm-bucketed search.

Vectors are sorted by norm and cut into buckets of neighbours. A search takes buckets from the largest
norm down: by Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the bucket's largest,
so a bucket is left out for a window where that is below the window's lower limit or the k-th
score that the window has so far. Buckets are dealt to slices and anchors to groups, so that each task searches a few
buckets for a few hundred anchors; what slices find for an anchor is merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, pinned

#: Rows of a bucket and of a pack of anchors; buckets of a slice and packs of a group; groups up to which their limits are broadcast.
BUCKET_ROWS, PACK_ROWS, SLICE_BUCKETS, GROUP_PACKS, BROADCAST_GROUPS = 1024, 256, 8, 4, 200_000
#: No id, and no score: below all that a row can have.
NO_ID, NO_SCORE = (1 << 63) - 1, -(1 << 62)
_VECTOR = "uid bigint, id bigint, label bigint, asked boolean, norm double, vec binary"
_PACK = "part int, pack int, top double, need double, uids binary, ids binary, labels binary, norms binary, dims int, vecs binary, lows binary, highs binary"


def quantised(rows: DataFrame) -> DataFrame:
    """uid, id, label, asked, norm, vec of rows (uid, id, label, asked, embedding): components floor(256 x) as 64-bit integers; rows whose squared norm reaches 2**62 are left out, as scores are to fit 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, norms, vecs = [], [], []
            for i, v in enumerate(batch.column(4).to_pylist()):
                x = np.floor(256.0 * np.array(v, np.float64))
                with np.errstate(over="ignore"):
                    square = float(x @ x)
                if square < float(1 << 62):
                    kept.append(i)
                    norms.append(np.sqrt(square))
                    vecs.append(x.astype("<i8").tobytes())
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[taken.column(k) for k in range(4)], pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], ["uid", "id", "label", "asked", "norm", "vec"])

    return rows.mapInArrow(lean(run), _VECTOR)


def packed(vectors: DataFrame, rows: int, parts: int, windows: bool = False) -> DataFrame:
    """Vectors by falling norm, ``rows`` of them a row, those of a pack in the order of ids; ``windows`` (lows, highs) of anchors go with them.

    ``top`` is the largest norm of a pack, ``need`` the least norm that a partner must have for any of its windows.
    """
    ordered = vectors.repartitionByRange(parts, F.col("norm").desc(), F.col("uid")).sortWithinPartitions(F.col("norm").desc(), "uid")
    extra = ["lows", "highs"] if windows else []
    ordered = ordered.select("uid", "id", "label", "norm", "vec", *extra)

    def pack(part: int, k: int, held: list[dict]) -> list:
        held.sort(key=lambda r: (r["id"], r["uid"]))
        vecs = [np.frombuffer(r["vec"], "<i8") for r in held]
        dims = max(len(v) for v in vecs)
        flat = np.zeros((len(held), dims), "<i8")
        for i, v in enumerate(vecs):
            flat[i, : len(v)] = v
        norms = np.array([r["norm"] for r in held])
        lows, highs, need = b"", b"", -np.inf
        if windows:
            low, high = np.array([r["lows"] for r in held], "<i8"), np.array([r["highs"] for r in held], "<i8")
            least = np.where(low <= high, low, np.inf).min(axis=1)
            need = np.where(np.isinf(least), np.inf, np.where(least > 0, least / np.maximum(norms, 1e-300), -np.inf)).min()
            lows, highs = low.tobytes(), high.tobytes()
        numbers = [np.array([r[c] for r in held], "<i8").tobytes() for c in ("uid", "id", "label")]
        return [part, k, norms.max(), float(need), *numbers, norms.astype("<f8").tobytes(), dims, flat.tobytes(), lows, highs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                if len(held) == rows:
                    yield _rows([pack(part, k, held)])
                    k, held = k + 1, []
        if held:
            yield _rows([pack(part, k, held)])

    return ordered.mapInArrow(lean(run), _PACK)


_PACK_TYPES = {"part": pa.int32(), "pack": pa.int32(), "top": pa.float64(), "need": pa.float64(), "uids": pa.binary(), "ids": pa.binary(), "labels": pa.binary(), "norms": pa.binary(), "dims": pa.int32(), "vecs": pa.binary(), "lows": pa.binary(), "highs": pa.binary()}


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACK_TYPES.values(), strict=True)], list(_PACK_TYPES))


class Search:
    """The best scores of some anchors in their windows, over buckets that come by falling norm."""

    def __init__(self, packs: list[dict], best: int, same_label: bool, windows: int):
        self.best, self.same_label = best, same_label
        number = lambda c, t="<i8": np.concatenate([np.frombuffer(p[c], t) for p in packs])
        self.uid, self.id, self.label, self.norm = number("uids"), number("ids"), number("labels"), number("norms", "<f8")
        n, dims = len(self.uid), max(p["dims"] for p in packs)
        self.vec = np.zeros((n, dims), np.int64)
        at = 0
        for p in packs:
            block = np.frombuffer(p["vecs"], "<i8").reshape(-1, p["dims"]) if p["dims"] else np.zeros((len(p["uids"]) // 8, 0), np.int64)
            self.vec[at : at + len(block), : p["dims"]] = block
            at += len(block)
        if packs[0]["lows"]:
            self.low, self.high = number("lows").reshape(n, windows), number("highs").reshape(n, windows)
        else:
            self.low, self.high = np.full((n, windows), NO_SCORE + 1), np.full((n, windows), -NO_SCORE)
        self.score = np.full((n, windows, best), NO_SCORE)
        self.found = np.full((n, windows, best), NO_ID)
        self.as_float = self.vec.astype(np.float64)
        #: Pairs of anchor and bucket row that were scored.
        self.scored = 0

    def take(self, bucket: dict) -> None:
        """Scores the bucket for those windows that its norms can still serve."""
        most = self.norm * bucket["top"] * (1 + 1e-9) + 1e-6
        need = np.maximum(self.low, self.score[:, :, -1])
        open_ = (self.low <= self.high) & (most[:, None] >= need)
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return
        ids, labels, dims = np.frombuffer(bucket["ids"], "<i8"), np.frombuffer(bucket["labels"], "<i8"), bucket["dims"]
        other = np.frombuffer(bucket["vecs"], "<i8").reshape(len(ids), dims)
        d = min(dims, self.vec.shape[1])
        self.scored += len(rows) * len(ids)
        # Sums of at most 2**53 are exact as doubles, whatever their order; larger ones are taken as integers.
        if self.norm[rows].max() * bucket["top"] < float(1 << 52):
            score = (self.as_float[rows, :d] @ other[:, :d].T.astype(np.float64)).astype(np.int64)
        else:
            score = self.vec[rows, :d] @ other[:, :d].T
        fits = (self.label[rows, None] == labels) == self.same_label
        if self.same_label:
            fits &= self.uid[rows, None] != np.frombuffer(bucket["uids"], "<i8")
        score[~fits] = NO_SCORE
        for w in range(self.low.shape[1]):
            own = np.flatnonzero(open_[rows, w])
            if not len(own):
                continue
            at = rows[own]
            left = score[own]
            left[(left < self.low[at, w, None]) | (left > self.high[at, w, None])] = NO_SCORE
            self.merge(at, w, left, ids)

    def merge(self, at: np.ndarray, w: int, left: np.ndarray, ids: np.ndarray) -> None:
        """The best of what is left of a bucket's scores, the least id first among equals, go in among the best so far."""
        better = np.flatnonzero(left.max(axis=1) >= np.maximum(self.score[at, w, -1], NO_SCORE + 1))
        if not len(better):
            return
        at, left, line = at[better], left[better], np.arange(len(better))
        scores, found = [self.score[at, w]], [self.found[at, w]]
        for _ in range(min(self.best, left.shape[1])):
            spot = left.argmax(axis=1)  # the first of equals has the least id
            value = left[line, spot]
            scores.append(value[:, None])
            found.append(np.where(value > NO_SCORE, ids[spot], NO_ID)[:, None])
            left[line, spot] = NO_SCORE
        scores, found = np.concatenate(scores, axis=1), np.concatenate(found, axis=1)
        order = np.lexsort((found, -scores), axis=-1)[:, : self.best]
        self.score[at, w], self.found[at, w] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)

    def rows(self) -> pa.RecordBatch:
        """uid, id, win, found, score of what was found."""
        a, w, k = np.nonzero(self.score > NO_SCORE)
        return pa.RecordBatch.from_arrays([pa.array(self.uid[a]), pa.array(self.id[a]), pa.array(w.astype(np.int32)), pa.array(self.found[a, w, k]), pa.array(self.score[a, w, k])], ["uid", "id", "win", "found", "score"])


def searched(packs: DataFrame, buckets: DataFrame, best: int, same_label: bool, windows: int) -> DataFrame:
    """uid, id, win, found, score: for each anchor and window the ``best`` of each slice of buckets."""
    n_buckets, n_parts = buckets.agg(F.count("*"), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    last = packs.agg(F.coalesce(F.max(F.col("part")), F.lit(0)) + 1).first()[0]
    slices = max(1, -(-n_buckets // SLICE_BUCKETS))
    groups = max(1, -(-max(last, packs.count()) // GROUP_PACKS))
    # Both are dealt round: a slice has buckets of all norms, so that its k-th scores are high before its low norms come.
    step = max(1, -(-n_buckets // n_parts))
    grouped = packs.withColumn("grp", ((F.col("part") + F.col("pack") * F.lit(last)) % groups).cast("int"))
    limits = grouped.groupBy("grp").agg(F.min("need").alias("least"))
    # A bucket goes to the groups for which some window's lower limit is within its norms; what is below all of them isn't sent.
    dealt = buckets.withColumn("slc", ((F.col("part") * step + F.col("pack")) % slices).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.join(bounded(limits, BROADCAST_GROUPS), "grp").where(F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("least")).drop("least")
    sent = grouped.withColumn("slc", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    both = sent.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)))
    units = both.repartition("slc", "grp").sortWithinPartitions("slc", "grp", "kind", F.col("top").desc(), "part", "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, search = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if at != (r["slc"], r["grp"]):
                    if search is not None:
                        yield search.rows()
                    at, waiting, search = (r["slc"], r["grp"]), [], None
                if r["kind"] == 0:
                    waiting.append(r)
                elif waiting or search is not None:
                    if search is None:
                        search, waiting = Search(waiting, best, same_label, windows), []
                    search.take(r)
        if search is not None:
            yield search.rows()

    return units.mapInArrow(lean(run), "uid bigint, id bigint, win int, found bigint, score bigint")


def ranked(found: DataFrame, best: int) -> DataFrame:
    """The ``best`` of an anchor and window over all slices, with their rank from 1."""
    order = Window.partitionBy("uid", "win").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has id, label, embedding and asked, which marks the anchors; a row counts for itself, even where ids repeat. An anchor's positives are its best ``positives`` other rows of its label; for each of them the best ``negatives`` rows of other labels
    with a score from low to high, as fractions of the positive's score, both ends included. Scores are inner products of components floor(256 x); equal
    scores come by id, null last. Rows with a null label, a null vector or a null or non-finite component take no part, nor do those whose squared
    norm reaches 2**62. Shorter vectors count as having zeros, empty ones score 0. A positive with a negative score has no negatives.
    An empty table gives an empty result.
    """
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(usable, F.lit(False))
    id_ = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id")
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("uid"), id_, F.col("label").cast("long").alias("label"), F.coalesce("asked", F.lit(False)).alias("asked"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = pinned(quantised(rows))
    asked = known.where("asked")
    n, m = known.count(), asked.count()
    parts = lambda count, size: max(1, -(-count // (8 * size)))
    buckets = pinned(packed(known, BUCKET_ROWS, parts(n, BUCKET_ROWS)))
    packs = pinned(packed(asked, PACK_ROWS, parts(m, PACK_ROWS)))
    near = pinned(ranked(searched(packs, buckets, positives, True, 1), positives))
    # The window of a positive, in whole numbers; one that nothing fits has its ends crossed.
    s = F.col("score")
    bottom = F.expr(f"CASE WHEN score < 0 THEN 1 ELSE score div {low[1]} * {low[0]} + (score % {low[1]} * {low[0]} + {low[1] - 1}) div {low[1]} END")
    upper = F.expr(f"CASE WHEN score < 0 THEN 0 ELSE score div {high[1]} * {high[0]} + (score % {high[1]} * {high[0]}) div {high[1]} END")
    spans = near.select("uid", F.col("rank").alias("nth"), bottom.alias("low"), upper.alias("high"))
    by_rank = F.map_from_entries(F.collect_list(F.struct("nth", F.struct("low", "high"))))  # at most ``positives`` of them
    each = [F.col("w")[F.lit(k)] for k in range(1, positives + 1)]
    windows = spans.groupBy("uid").agg(by_rank.alias("w")).select("uid", F.array(*[F.coalesce(x["low"], F.lit(1)) for x in each]).alias("lows"), F.array(*[F.coalesce(x["high"], F.lit(0)) for x in each]).alias("highs"))
    again = pinned(packed(asked.join(windows, "uid"), PACK_ROWS, parts(m, PACK_ROWS), windows=True))
    far = ranked(searched(again, buckets, negatives, False, positives), negatives)
    given = near.select("uid", (F.col("rank") - 1).alias("win"), F.col("found").alias("positive"), s.alias("positive_score"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return far.join(given, ["uid", "win"]).select(real("id").alias("anchor_id"), real("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
