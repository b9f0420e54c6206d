"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are first merged. Then independent trees
branch the distinct sets: a node picks coordinates of the MinHash signature, and a set goes to the
child that its minwise token at a picked coordinate names. Nodes with few sets are compared
exhaustively by sketches; larger ones branch on. Sets that a sketch finds plausibly similar form
plausible groups, and within these links are confirmed on full sets.

Nothing is capped. A large node is tested against one pivot. The sets that are plausibly similar to
the pivot are in one group then; where few are left over, and at the last level, those are compared
with all sets of the node in blocks, and the node is done. Otherwise it branches on.

Links are confirmed on full sets in three steps, so that few sets travel: each set of a group with the
group's pivot; sets that the pivot isn't linked to with the few partners that they are most like; and
only those of them that have more partners in question with all others of the group, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, pinned, released, texts_of
from .components import components

#: Coordinates of a signature; a sketch has one bit for each.
COORDINATES = 128
#: Sets in a node that is compared exhaustively, which is what fits one block; levels of branching; sets in a side of a block.
LEAF, LEVELS, BLOCK = 2000, 6, 2000
#: Partners that a set which its group's pivot didn't take is tried with before any others.
PARTNERS = 4
BROADCAST_ROWS = 500_000

_source = np.random.default_rng(20240501)
MULTIPLIERS = _source.integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
ROOT_ORDER = _source.permutation(COORDINATES)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit hashes of word shingles; hashes of words are kept in a bounded cache."""

    def __init__(self, words: int, cached: int = 200_000):
        self.words, self.cached, self.cache = words, cached, {}

    def hashes(self, text: bytes) -> np.ndarray:
        """The distinct shingles of a text with A-Z lower-cased, sorted; a text of fewer words is one shingle, an empty one has none."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > self.cached:
            cache.clear()
        try:
            found = [cache[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            found = [cache[w] for w in words]
        h = np.array(found, np.uint64)
        k = min(self.words, len(h))
        out = mixed(h[: len(h) - k + 1] + np.uint64(k))
        for j in range(1, k):
            out = mixed(out * _MIX[2] + h[j : len(h) - k + 1 + j])
        return np.unique(out)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the minwise token at each coordinate as 16 bits, the sketch as two signed 64-bit numbers).

    Sixteen well-mixed bits tell tokens apart well enough to branch on: tokens that differ share them once in 65536 times.
    """
    least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 4096):
        np.minimum(least, np.multiply.outer(MULTIPLIERS, hashes[i : i + 4096]).min(axis=1), out=least)
    spread = mixed(least)
    bits = (spread >> np.uint64(63)).astype(np.uint8)
    return (spread & np.uint64(0xFFFF)).astype("<u2"), np.packbits(bits).view(np.int64)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, k1, k2, sig, s1, s2 of each row; without shingles the last five are null."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            out = []
            for text in texts_of(batch.column(1)):
                hashes = shingler.hashes(text)
                if not len(hashes):
                    out.append((0, None, None, None, None, None))
                    continue
                sig, sketch = signature(hashes)
                out.append((len(hashes), *set_key(hashes), sig.tobytes(), int(sketch[0]), int(sketch[1])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_shingles", "k1", "k2", "sig", "s1", "s2"])

    return rows.mapInArrow(lean(run), "id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, s1 bigint, s2 bigint")


def plausible_bits(threshold: float, miss: float) -> int:
    """Bits of two sketches that agree at least, if the sets are similar enough; a pair at the threshold has fewer with a chance of at most ``miss``."""
    p, fewer = (1 + threshold) / 2, 0.0
    for bits in range(COORDINATES):
        fewer += math.comb(COORDINATES, bits) * p**bits * (1 - p) ** (COORDINATES - bits)
        if fewer > miss:
            return bits
    return COORDINATES


def agreement(a1, a2, b1, b2):
    """Columns or arrays of bits to the number of bits that agree."""
    if isinstance(a1, np.ndarray):
        count = lambda x: np.bitwise_count(x.view(np.uint64)).astype(np.int64)  # noqa: E731  of signed numbers numpy counts the magnitude's bits
        return COORDINATES - count(a1 ^ b1) - count(a2 ^ b2)
    return F.lit(COORDINATES) - F.bit_count(a1.bitwiseXOR(b1)) - F.bit_count(a2.bitwiseXOR(b2))


def child_keys(node: np.ndarray, values: np.ndarray, coordinate: np.ndarray) -> np.ndarray:
    """Keys of the children that values at a coordinate name."""
    return mixed(mixed(node + _MIX[2] * (coordinate.astype(np.uint64) + np.uint64(1))) + values.astype(np.uint64))


def roots(trees: int) -> Callable:
    """Every set's node on the first level of each tree: one coordinate for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, COORDINATES)
            for t in range(trees):
                c = np.full(n, ROOT_ORDER[t % COORDINATES])
                node = child_keys(np.full(n, mixed(np.array([t + 1], np.uint64))[0]), sig[:, c[0]], c)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0), batch.column(2), batch.column(3)], ["node", "rep", "s1", "s2"])

    return run


def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two children of its node that each set goes to; the node picks their coordinates."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        node = np.asarray(batch.column(0)).view(np.uint64)
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(n, COORDINATES)
        first = (node >> np.uint64(8)) % np.uint64(COORDINATES)
        second = (first + np.uint64(1) + (node >> np.uint64(24)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
        for c in (first, second):
            child = child_keys(node, sig[np.arange(n), c.astype(np.int64)], c)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1), batch.column(3), batch.column(4)], ["node", "rep", "s1", "s2"])


def runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for k in range(keys):
            values = np.asarray(table.column(k))
            same &= values == values[-1]
        # Sorted: the last group is the run of rows like the last one.
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position that each of n reaches over pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def edges_of(rep: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    x = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[label[x]])], ["a", "b"])


def compare_leaves(bits: int) -> Callable:
    """Edges that connect what exhaustive comparison of sketches finds plausible in each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            node, rep, s1, s2 = (np.asarray(table.column(k)) for k in range(4))
            alive, d, found = np.arange(len(node)), 0, []
            while True:
                d += 1
                alive = alive[: np.searchsorted(alive, len(node) - d)]
                alive = alive[node[alive] == node[alive + d]]
                if not len(alive):
                    break
                hit = alive[agreement(s1[alive], s2[alive], s1[alive + d], s2[alive + d]) >= bits]
                if len(hit):
                    found.append(np.stack([hit, hit + d]))
            if found:
                i, j = np.concatenate(found, axis=1)
                yield edges_of(rep, least_labels(len(node), i, j))

    return run


def compare_blocks(bits: int) -> Callable:
    """As ``compare_leaves``, for the rows marked odd against all rows of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            keys = [np.asarray(table.column(k)) for k in range(3)]
            rep, s1, s2 = (np.asarray(table.column(k)) for k in range(3, 6))
            odd = np.asarray(table.column(6).combine_chunks()) if table.num_rows else np.zeros(0, bool)
            starts = np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]))
            for a, z in zip(starts, [*starts[1:], len(rep)], strict=True):
                left, right = np.flatnonzero(odd[a:z]) + a, np.flatnonzero(~odd[a:z]) + a
                pairs = [np.stack([np.full(len(hit), x), hit]) for x in left for hit in [right[agreement(s1[right], s2[right], s1[x : x + 1], s2[x : x + 1]) >= bits]]]
                if pairs:
                    i, j = np.concatenate(pairs, axis=1)
                    yield edges_of(rep, least_labels(len(rep), i, j))

    return run


def blocks(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows (key, odd, ...) with left and right, so that every odd row meets every row of its key in some block.

    ``sizes`` has for each key ``n`` rows and ``n_odd`` odd ones. A row takes part as one of all
    (odd false) and, if it is odd, as an odd one; both sides of a block have about ``block`` rows.
    """
    both = rows.join(bounded(sizes, BROADCAST_ROWS), key)
    across, down = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("n_odd") / block).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    as_any = both.withColumns({"across": spot(across), "odd": F.lit(False)}).withColumn("down", F.explode(F.sequence(F.lit(0), down - 1)))
    as_odd = both.where("odd").withColumn("down", spot(down)).withColumn("across", F.explode(F.sequence(F.lit(0), across - 1)))
    return as_any.unionByName(as_odd.select(as_any.columns)).drop("n", "n_odd")


def plausible_edges(reps: DataFrame, trees: int, bits: int, leaf: int, levels: int, block: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that some tree brings together and a sketch finds plausible."""
    kinds = "node bigint, rep bigint, s1 bigint, s2 bigint"
    points = reps.select("rep", "s1", "s2")
    rows = pinned(reps.select("rep", "sig", "s1", "s2").mapInArrow(lean(roots(trees)), kinds))
    found = []

    def leaves(of: DataFrame) -> DataFrame:
        return of.repartition("node").sortWithinPartitions("node").mapInArrow(lean(compare_leaves(bits)), "a bigint, b bigint")

    for level in range(1, levels + 1):
        large = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where(F.col("n") > leaf)
        large = pinned(large.join(points.select(F.col("rep").alias("pivot"), F.col("s1").alias("p1"), F.col("s2").alias("p2")), "pivot").drop("n"))
        if large.isEmpty():
            found.append(pinned(leaves(rows).distinct()))
            released(rows)
            break
        small = leaves(rows.join(bounded(large.select("node"), BROADCAST_ROWS), "node", "left_anti"))
        crowd = rows.join(bounded(large, BROADCAST_ROWS), "node").withColumn("odd", agreement(F.col("s1"), F.col("s2"), F.col("p1"), F.col("p2")) < bits)
        near = crowd.where("NOT odd AND rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        # Nodes in which the pivot leaves sets over, and whether those are few.
        sizes = crowd.groupBy("node").agg(F.count("*").alias("n"), F.count_if("odd").alias("n_odd")).where("n_odd > 0")
        few = (F.col("n_odd") <= leaf) | F.lit(level == levels)
        sizes = pinned(sizes.withColumn("few", few))
        last = sizes.where("few").drop("few")
        dealt = blocks(crowd.select("node", "rep", "s1", "s2", "odd"), "node", last, block)
        dealt = dealt.select("node", "across", "down", "rep", "s1", "s2", "odd").repartition("node", "across", "down").sortWithinPartitions("node", "across", "down")
        rest = dealt.mapInArrow(lean(compare_blocks(bits)), "a bigint, b bigint")
        found.append(pinned(small.unionByName(near).unionByName(rest).distinct()))
        alive = sizes.where("NOT few").select("node")
        if alive.isEmpty():
            released(rows)
            break
        on = rows.join(bounded(alive, BROADCAST_ROWS), "node", "left_semi")
        was, rows = rows, pinned(on.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", "s1", "s2").mapInArrow(lean(branches), kinds))
        released(was)
    return reduce(DataFrame.unionByName, found)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirm_pairs(percent: int) -> Callable:
    """Whether the two full sets in the last columns are linked; the columns before them stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            linked = [jaccard_at_least(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def best_partners(percent: int, bits: int, most: int) -> Callable:
    """For each odd row of a block, the rows of another label that its sketch agrees with most, if sketches and sizes let them be linked; with the first, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            keys = [np.asarray(table.column(k)) for k in range(3)]
            rep, s1, s2, size, label = (np.asarray(table.column(k)) for k in range(3, 8))
            odd = np.array(table.column(8).to_pylist(), bool)
            starts = np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]))
            out = []
            for a, z in zip(starts, [*starts[1:], len(rep)], strict=True):
                right = np.flatnonzero(~odd[a:z]) + a
                for x in np.flatnonzero(odd[a:z]) + a:
                    agreed = agreement(s1[right], s2[right], s1[x : x + 1], s2[x : x + 1])
                    fits = np.flatnonzero((agreed >= bits) & (label[right] != label[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])))
                    out += [(int(rep[x]), int(rep[right[k]]), int(agreed[k]), 0 if n else len(fits)) for n, k in enumerate(fits[np.argsort(-agreed[fits], kind="stable")[:most]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "agreed", "fits"])

    return run


def confirm_blocks(percent: int, bits: int) -> Callable:
    """Confirmed links of each block's odd rows; what is already connected isn't compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3, 2_000):
            keys = [np.asarray(table.column(k)) for k in range(3)]
            rep, s1, s2, label = (np.asarray(table.column(k)) for k in range(3, 7))
            odd, sets = np.array(table.column(7).to_pylist(), bool), table.column(8)
            starts = np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]))
            out: list[tuple[int, int]] = []
            for a, z in zip(starts, [*starts[1:], len(rep)], strict=True):
                joined: dict[int, int] = {}

                def find(x: int) -> int:
                    while (y := joined.get(x, x)) != x:
                        joined[x] = joined.get(y, y)
                        x = y
                    return x

                right = np.flatnonzero(~odd[a:z]) + a
                right_set = {int(x): np.frombuffer(sets[int(x)].as_py(), np.uint64) for x in right}
                for x in np.flatnonzero(odd[a:z]) + a:
                    mine, me = np.frombuffer(sets[int(x)].as_py(), np.uint64), int(label[x])
                    agreed = agreement(s1[right], s2[right], s1[x : x + 1], s2[x : x + 1])
                    for k in np.argsort(-agreed, kind="stable"):
                        if agreed[k] < bits:
                            break
                        y = int(right[k])
                        there = int(label[y])
                        if find(me) != find(there) and jaccard_at_least(mine, right_set[y], percent):
                            joined[find(me)] = find(there)
                            out.append((int(rep[x]), int(rep[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (grp, rep, label) with the least label that each reaches over links (a, b) of reps, pinned."""
    of = lambda end, name: labels.select(F.col("rep").alias(end), F.col("label").alias(name))
    ends = links.join(of("a", "la"), "a").join(of("b", "lb"), "b")
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return pinned(labels.join(joined, labels["label"] == joined["node"], "left").select("grp", "rep", F.coalesce("root", "label").alias("label")))


def trees_for(recall: float, percent: int, levels: int = LEVELS) -> int:
    """Trees that find a pair at the threshold with the chance ``recall``.

    A tree brings a pair together on its first level if it agrees at the root's coordinate, and a node with two
    children that brought it together does so again with chance 1 - (1 - s*q)^2, where s is the share of coordinates at which the pair
    agrees and q the same chance a level below. Trees draw from the same coordinates, so they are
    independent only once s is given: the chance of a miss is taken for each number of coordinates that may agree, and summed up.
    """
    p, each = percent / 100, []
    for agreeing in range(COORDINATES + 1):
        s, q = agreeing / COORDINATES, 1.0
        for _ in range(levels - 1):
            q = 1 - (1 - s * q) ** 2
        each.append((math.comb(COORDINATES, agreeing) * p**agreeing * (1 - p) ** (COORDINATES - agreeing), s * q))
    for trees in range(1, COORDINATES + 1):
        if sum(chance * (1 - found) ** trees for chance, found in each) <= 1 - recall:
            return trees
    raise ValueError(f"{COORDINATES} trees don't find pairs of {percent} % with such a recall")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 1 - 1e-7, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked when 100 times the shingles they share is at least ``percent`` times those
    that either has; ``component_id`` is the smallest id reachable over links, and ``kept`` whether
    that is the row's own. Words are runs of characters other than space and U+0009 to U+000D, with
    A-Z lower-cased; a document with fewer words than a shingle has is one shingle. Without words,
    or with null text, it has none and is linked with nothing. A pair at exactly the threshold is
    found with the chance ``recall`` or better, a more similar one with a greater chance; sketches and
    trees have half of the misses each. Ids are integers. Rows that repeat an id are one vertex. A row with a null id is its own component unless
    its set equals that of a row with an id. An empty table gives an empty result.
    """
    miss = (1 - recall) / 2
    bits = plausible_bits(percent / 100, miss)
    read = pinned(sketches(docs, words, id_col, text_col))
    merged = read.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    reps = pinned(merged.where("rep IS NOT NULL"))
    slim = pinned(read.select("id", "n_shingles", "k1", "k2"))
    released(read)
    groups = components(plausible_edges(reps, trees_for(1 - miss, percent, levels), bits, leaf, levels, block))
    groups = pinned(groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").alias("rep"), F.col("root").alias("grp")))

    # Full sets, of members of plausible groups only.
    texts = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text"))
    member = texts.join(bounded(groups, BROADCAST_ROWS), "rep").select("grp", "rep", "text")
    sets = pinned(member.mapInArrow(lean(full_sets(words)), "grp bigint, rep bigint, s1 bigint, s2 bigint, full binary"))
    linked = "a bigint, b bigint, linked boolean"
    pivots = pinned(sets.where("rep = grp").select("grp", F.col("full").alias("pivot")))
    tested = sets.where("rep <> grp").join(pivots, "grp").select(F.col("grp").alias("a"), F.col("rep").alias("b"), "full", "pivot").mapInArrow(lean(confirm_pairs(percent)), linked)
    taken = tested.groupBy("a", "b").agg(F.max("linked").alias("linked")).select(F.col("a").alias("grp"), F.col("b").alias("rep"), F.when(F.col("linked"), F.col("a")).otherwise(F.col("b")).alias("label"))
    labels = pinned(taken.unionByName(groups.where("rep = grp").select("grp", "rep", F.col("grp").alias("label"))))

    def left_over(marked: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
        """rows of the groups that have odd ones in marked (grp, rep, label, odd), in blocks in which odd ones meet all."""
        sizes = pinned(marked.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("odd").alias("n_odd")).where("n_odd > 0 AND n > 2"))
        left = rows.join(bounded(sizes.select("grp"), BROADCAST_ROWS), "grp", "left_semi").join(marked, ["grp", "rep"])
        dealt = blocks(left, "grp", sizes, block).select("grp", "across", "down", "rep", "s1", "s2", *columns)
        return dealt.repartition("grp", "across", "down").sortWithinPartitions("grp", "across", "down")

    # What its group's pivot isn't linked to is tried with the partners that its sketch is most like. Their full sets come by a join.
    slim_sets = sets.select("grp", "rep", "s1", "s2", (F.octet_length("full") / 8).cast("long").alias("size"))
    marked = labels.withColumn("odd", F.col("label") != F.col("grp"))
    like = left_over(marked, slim_sets, ["size", "label", "odd"]).mapInArrow(lean(best_partners(percent, bits, PARTNERS)), "a bigint, b bigint, agreed bigint, fits bigint")
    like = pinned(like.groupBy("a").agg(F.sum("fits").alias("fits"), F.slice(F.sort_array(F.collect_set(F.struct("agreed", "b")), False), 1, PARTNERS)["b"].alias("best")))
    pairs = pinned(like.select("a", F.explode("best").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pinned(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    one_set = sets.select("rep", "full").join(bounded(ends, BROADCAST_ROWS), "rep", "left_semi")
    tried = pairs.join(one_set.withColumnRenamed("rep", "a"), "a").join(one_set.select(F.col("rep").alias("b"), F.col("full").alias("other")), "b").select("a", "b", "full", "other").mapInArrow(lean(confirm_pairs(percent)), linked)
    labels = relabelled(labels, tried.where("linked").select("a", "b"))

    # What could be linked to more than these, and still isn't one with the pivot, meets all others of its group.
    crowded = like.where(F.col("fits") > PARTNERS).select(F.col("a").alias("rep"), F.lit(True).alias("more"))
    marked = pinned(labels.join(crowded, "rep", "left").select("grp", "rep", "label", (F.col("more").isNotNull() & (F.col("label") != F.col("grp"))).alias("odd")))
    links = left_over(marked, sets, ["label", "odd", "full"]).mapInArrow(lean(confirm_blocks(percent, bits)), "a bigint, b bigint")
    root = relabelled(labels, links).select("rep", F.col("label").alias("root")).where("rep <> root")

    final = pinned(reps.select("k1", "k2", "rep", "copies").join(root, "rep", "left").where("copies > 1 OR root IS NOT NULL").select("k1", "k2", F.coalesce("root", "rep").alias("component")))
    out = slim.join(final, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component"), F.col("id")).eqNullSafe(F.col("id")).alias("kept"))


def full_sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                each = [shingler.hashes(t) for t in texts_of(part.column(2))]
                points = [signature(h)[1] for h in each]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([int(p[0]) for p in points], pa.int64()), pa.array([int(p[1]) for p in points], pa.int64()), pa.array([h.tobytes() for h in each], pa.binary())], ["grp", "rep", "s1", "s2", "full"])

    return run


def keep_one_of_near(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs, all columns, that ``near_dedup`` keeps: one document of each component, and all rows with a null id that equal no other."""
    decided = near_dedup(docs, words, percent, id_col=id_col, text_col=text_col, **kwargs)
    gone = pinned(decided.where("NOT kept").select(F.col(id_col).alias("gone_id")).distinct())
    return docs.join(bounded(gone, BROADCAST_ROWS), docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")
