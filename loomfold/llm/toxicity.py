"""Toxicity by maximum-scoring segments.

Tokens (words and their stems) are scored by log-odds between toxic and clean documents, with a Dirichlet prior in the
proportions of all training text, less a fixed drift. One linear scan over a document's scores finds every segment that
no extension and no shortening improves (Ruzzo and Tompa). Scores of segments follow an extreme-value law, whose two
parameters come from the segments of clean documents. All segments of a document enter its score: the law gives the chance
that so many segments sum up so high in clean text (Karlin and Altschul), and a logistic function, fitted on training
documents, turns this, the best segment and the sum of what is above chance into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_text, lean, pinned, released, texts_of

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: bytes) -> list[str]:
    return _TOKEN.findall(text.decode().lower())


#: Lengths of the beginnings of words that are scored beside whole words, as inflected insults share a stem.
STEMS = (4, 5, 6)
#: Words whose scores a worker remembers, and tokens that a task counts before it hands them on: bounds of memory, not of results.
CACHED_WORDS, COUNTED_TOKENS = 200_000, 400_000


def keys_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def segments(odds: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments of a sequence, in linear time.

    ``odds`` are the (position, log-odds) of positions where these aren't 0. A position scores its
    log-odds plus ``drift``, which is below 0, and every other position ``drift``.

    ``open_`` is a stack of the segments that a later one may still reach back to: their sums before
    them grow from bottom to top, so each segment is put there once and taken off once.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    open_: list[int] = []
    total, at = 0.0, 0
    for position, value in odds:
        total += drift * (position - at)
        at, before = position + 1, total
        total += value + drift
        if total <= before:
            continue
        start = position
        while True:
            while open_ and found[open_[-1]][2] >= before:
                open_.pop()
            if not open_ or found[open_[-1]][3] >= total:
                break
            first = open_.pop()
            start, _, before, _ = found[first]
            del found[first:]
        open_.append(len(found))
        found.append((start, position + 1, before, total))
    return [(a, b, y - x) for a, b, x, y in found]


class ToxicityModel:
    """Log-odds of tokens, the extreme-value law's parameters and the logistic function; picklable.

    The law: in clean text of n tokens, about k * n * exp(-scale * s) segments score s or more.
    """

    def __init__(self, odds: dict[str, float], drift: float, scale: float = 1.0, log_k: float = math.log(0.1)):
        self.odds, self.drift, self.scale, self.log_k = odds, drift, scale, log_k
        self.weights = (0.0, 0.0, 0.0, 0.0)
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def word_odds(self, word: str) -> float:
        """The largest log-odds of the word's keys, 0 if none has any."""
        if len(self._words) >= CACHED_WORDS:
            self._words.clear()
        value = self._words[word] = max((self.odds[k] for k in keys_of(word) if k in self.odds), default=0.0)
        return value

    def segments(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        """The maximal segments of a text, and how many tokens it has."""
        words = tokens(text)
        known, new = self._words, self.word_odds
        found = [(i, s) for i, w in enumerate(words) if (s := known[w] if w in known else new(w))]
        return segments(found, self.drift), len(words)

    def calibrated(self, score: float, n: int) -> float:
        """How far a segment of a text of n tokens is above what chance gives: its p-value in clean text is 1 - exp(-exp(-this))."""
        return self.scale * score - self.log_k - math.log(max(n, 1))

    def features(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        """Of a text's segments: minus the log of the chance of the best so many, the best one's score, the sum of what is above chance.

        The chance that r segments have calibrated scores that sum up to t or more is
        exp(-t) t^(r-1) / (r! (r-1)!); that of the r for which it is least is taken, times 2^r as r was chosen.
        """
        each = sorted((self.calibrated(s, n) for _, _, s in found), reverse=True)
        best = each[0] if each else self.calibrated(0.0, n)
        together = total = 0.0
        for r, e in enumerate(each, 1):
            if e <= 0:
                break
            total += e
            together = max(together, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return max(together, best), self.scale * max((s for _, _, s in found), default=0.0), total

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def score_text(self, text: bytes) -> float:
        return self.score(self.features(*self.segments(text)))

    def p_value(self, score: float, n: int) -> float:
        """The chance that clean text of n tokens has a segment of that score or a higher one."""
        return -math.expm1(-math.exp(min(700.0, -self.calibrated(score, n))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) of a ridge-penalised logistic regression, by Newton's method on scaled columns."""
    spread = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(design.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 10 / max(size, 1e-12))
        if size < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / spread])


def copy_key(words: list[str], run: int = 5) -> int:
    """The least hash of so many words in a row; a shorter text is one such run."""
    starts = range(max(1, len(words) - run + 1))
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + run])) for i in starts) >> 1


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int, merge_copies: bool, id_col: str, text_col: str, label_col: str, seed: int = 0) -> DataFrame:
    """text, label, draw (0 to 1) of labelled documents to learn from, pinned.

    Labels are sampled by a hash of the id, so that what is broadcast is bounded by ``most_rows``. With
    ``merge_copies``, of documents with the same label and least hash of five words in a row, as copies
    have, one is taken: a passage that is copied a thousand times says no more than one that is written once. Rows that repeat
    both id and text are all taken. The chosen are broadcast as a number each if they are at most ``most_rows``; more of them, as rows of a labelled id with different texts can be, are joined by a shuffle.
    """
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("of")).agg(F.max(labels[label_col].cast("int")).alias("label"))
    draw = F.pmod(F.xxhash64(F.col("of").cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    known = known.withColumn("draw", draw)
    cut = min(1.0, most_rows / max(1, known.count()))
    known = known.where(F.col("draw") < cut).withColumn("draw", F.col("draw") / cut)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    joined = rows.join(F.broadcast(known), rows["id"] == F.col("of")).select("text", "label", "draw")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [copy_key(tokens(t)) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["text", "label", "draw", "least"])

    if not merge_copies:
        return pinned(joined)
    # Of a group the row of the least draw goes on by one number, so that no text is shuffled.
    each = pinned(joined.mapInArrow(lean(keys), "text string, label int, draw double, least bigint").withColumn("pick", F.xxhash64("draw", "text")))
    chosen = pinned(each.groupBy("least", "label").agg(F.min(F.struct("draw", "pick")).alias("one")).select("one.pick").distinct())
    out = pinned(each.join(bounded(chosen, most_rows), "pick", "left_semi").select("text", "label", "draw"))
    released(each)
    released(chosen)
    return out


def token_counts(rows: DataFrame) -> DataFrame:
    """token, toxic, clean: how many documents of rows (text, label) have it, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = (Counter(), Counter())

        def handed_on() -> pa.RecordBatch:
            words = list(counted[0] | counted[1])
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in (counted[1], counted[0])]], ["token", "toxic", "clean"])
            for c in counted:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counted[label == 1].update({k for w in set(tokens(text)) for k in keys_of(w)})
                if len(counted[0]) + len(counted[1]) > COUNTED_TOKENS:
                    yield handed_on()
        yield handed_on()

    each = rows.select("text", "label").mapInArrow(lean(run), "token string, toxic bigint, clean bigint")
    return each.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Minus the log of Chernoff's bound on the chance that a token's documents are by luck so far from ``share`` of them being toxic, on the side where they are."""
    n = toxic + clean
    part = lambda x, s: F.when(x > 0, x * F.log(x / (n * F.lit(s)))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def discovery_cut(tested: DataFrame, false_share: float, step: float = 0.05) -> tuple[float, float]:
    """For tokens that are oftener toxic than others and for the rest, the least ``surprise`` at which at most ``false_share`` of those that reach it do so by luck (Benjamini and Hochberg); infinite if there is none.

    Tokens are counted in steps of surprise, so that what comes to the driver is bounded.
    """
    bins = tested.groupBy("more", F.least(F.floor(F.col("surprise") / step), F.lit(round(100 / step))).alias("bin")).count().collect()
    tokens, cuts = sum(r["count"] for r in bins), []
    for more in (True, False):
        reached, cut = 0, math.inf
        for r in sorted((r for r in bins if r["more"] == more), key=lambda r: -r["bin"]):
            reached += r["count"]
            if math.exp(-r["bin"] * step) * tokens <= false_share * reached:
                cut = r["bin"] * step
        cuts.append(cut)
    return cuts[0], cuts[1]


def law_of_islands(clean: DataFrame) -> tuple[float, float]:
    """(scale, log k) of the extreme-value law from clean documents (n, scores of their segments).

    Above the median, scores of segments fall off exponentially: the scale is one over their mean excess, and k how many there are
    a token. Without segments the scale is 1 and k that of half a segment.
    """
    scores = clean.select(F.explode("scores").alias("score"))
    n = max(1, clean.agg(F.sum("n")).first()[0] or 0)
    cut = scores.agg(F.percentile_approx("score", 0.5, 10_000)).first()[0]
    if cut is None:
        return 1.0, math.log(0.5 / n)
    count, excess = scores.where(F.col("score") >= cut).agg(F.count("*"), F.avg(F.col("score") - F.lit(cut))).first()
    scale = min(5.0, 1 / max(excess, 1e-3))
    return scale, math.log((count + 0.5) / n) + scale * cut


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 200_000, calibration_rows: int = 20_000, prior_share: float = 0.03, false_share: float = 0.2, least_documents: int = 3, drift: float = -1.0, merge_copies: bool = True, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from docs that labels mark (1 toxic, 0 clean; null labels and texts are left out, of several labels the largest holds).

    Bounds: at most about ``most_rows`` labelled documents are learned from, and the extreme-value law and logistic function are
    fitted on about ``calibration_rows`` of them. Their words are all counted. ``prior_share`` is the weight of the Dirichlet prior as a
    share of all counts. A token has its log-odds, above 0 or below, if it is one of those of which a share of at most ``false_share``
    differ from the rest by luck, and else 0. How often a token must occur for that depends on the tokens, not on a
    bound, so languages of few documents have their own. Tokens of fewer than ``least_documents`` are not tested. What comes to the
    driver are the tokens that differ: fewer than the bounded sample's distinct words. ``merge_copies`` is described at ``labelled``.
    Without documents of both labels, every score is the share of toxic documents.
    """
    rows = labelled(docs, labels, most_rows, merge_copies, id_col, text_col, label_col)
    counts = pinned(token_counts(rows))
    n1, n0 = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        shares = rows.agg(F.avg("label")).first()[0] or 0.0
        model = ToxicityModel({}, drift)
        model.weights = (math.log(max(shares, 1e-6) / max(1 - shares, 1e-6)), 0.0, 0.0, 0.0)
        released(counts)
        released(rows)
        return model
    prior = prior_share * (n1 + n0)
    toxic, clean = F.col("toxic"), F.col("clean")
    alpha = (toxic + clean) * F.lit(prior_share)
    y1, y0 = toxic + alpha, clean + alpha
    odds = F.log(y1 / (F.lit(n1 + prior) - y1)) - F.log(y0 / (F.lit(n0 + prior) - y0))
    share = n1 / (n1 + n0)
    tested = counts.where(toxic + clean >= least_documents).select("token", odds.alias("odds"), surprise(toxic, clean, share).alias("surprise"), (toxic > (toxic + clean) * F.lit(share)).alias("more"))
    more, less = discovery_cut(tested, false_share)
    differ = tested.where(F.col("surprise") >= F.when(F.col("more"), F.lit(more)).otherwise(F.lit(less)))
    model = ToxicityModel({r["token"]: r["odds"] for r in differ.select("token", "odds").collect()}, drift)
    released(counts)

    found = "label int, n bigint, scores array<double>"
    sample = rows.where(F.col("draw") < calibration_rows / max(1, rows.count()))
    clean_segments = pinned(sample.where("label = 0").mapInArrow(lean(segments_by(model)), found))
    model.scale, model.log_k = law_of_islands(clean_segments)
    released(clean_segments)
    seen = sample.mapInArrow(lean(features_by(model)), "label int, together double, best double, total double").toPandas()
    model.weights = tuple(float(w) for w in logistic(seen[["together", "best", "total"]].to_numpy(float), seen["label"].to_numpy(float)))
    released(rows)
    return model


def segments_by(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(t) for t in texts_of(batch.column(0))]
            scores = pa.array([[s for _, _, s in f] for f, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([n for _, n in found], pa.int64()), scores], ["label", "n", "scores"])

    return run


def features_by(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [model.features(*model.segments(t)) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *[pa.array([x[k] for x in each], pa.float64()) for k in range(3)]], ["label", "together", "best", "total"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, most_p: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score, predicted, passages.

    ``score`` is 0 to 1, higher for likelier toxic, from all segments of the text; ``predicted`` is 1 from ``threshold`` on.
    ``passages`` lists the segments whose p-value is at most ``most_p``: first token, token after the
    last, p-value. Null text counts as empty and gets the score of a text without tokens. Whole
    texts are scanned; equal texts get equal results. Null and repeated ids are kept as they are. An empty table gives an empty
    result; other columns of docs are not read, whatever their names.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in texts_of(batch.column(1)):
                found, n = model.segments(text)
                scores.append(model.score(model.features(found, n)))
                passages.append([{"start": a, "end": b, "p": p} for a, b, s in found if (p := model.p_value(s, n)) <= most_p])
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), predicted, pa.array(passages, spans)], [id_col, "score", "predicted", "passages"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int, passages array<struct<start: bigint, end: bigint, p: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below ``threshold``; decided where they are read, without a shuffle.

    Null text counts as empty: such rows stay unless the model rejects a text without tokens. Repeated
    rows stay or go together. No column's name matters but ``text_col``. An empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score_text(t) < threshold for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
