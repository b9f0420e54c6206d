"""A Merkle manifest of a table, its nodes kept in Parquet by level.

Every row is a leaf. Leaves of a group, in order, are the bottom of the group's tree; the groups' roots
are the bottom of one more tree, whose root stands for the table. No tree is ever held as a whole:
leaves lie in sorted runs by coordinate (tree, place), a run of ``1 << SPAN`` nodes streams through a
task that makes the nodes above it, and these are appended to the store under their level. What the last
of those levels holds is read again as the next runs. Proofs are read off the other way round, from the
top: a merge-scan brings the nodes of a run, the run's own way up and the items of the run together by
coordinate.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import bounded, lean, pinned, released, running_sums, shared_dir

#: Levels that a task makes of one run, so a run has at most 1024 nodes; rows that a task hands on together; groups up to which their few numbers are broadcast.
SPAN, OUT_ROWS, BROADCAST_GROUPS = 10, 4096, 200_000
#: The tree of the groups' roots.
TOP = -1
_NODE = "level int, tree bigint, pos bigint, n bigint, h string"


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    return -(-n >> level)


def height_of(n: Column) -> Column:
    """The level at which a tree of n leaves has one node."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def spelled(column: Column) -> Column:
    """``-`` for null, else the bytes that the value takes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    """The leaf of a row: the hash of its fields as ``spelled`` has them."""
    return F.sha2(F.concat(*[spelled(c) for c in columns]), 256)


@dataclass(frozen=True)
class Manifest:
    """What ``build`` leaves behind.

    ``leaves`` (tree, pos, n, id, h and what was carried) has a row for each row of the table, ``groups`` (tree, n, group, subroot) one for
    each group, ``store`` is the folder of the nodes above the leaves, a partition a level. ``root`` is null for an empty table.
    """

    leaves: DataFrame
    groups: DataFrame
    store: str
    root: str | None
    most_leaves: int
    n_groups: int

    def nodes(self) -> DataFrame:
        return self.leaves.sparkSession.read.schema(_NODE).parquet(self.store)


def climb(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the ``SPAN`` levels above ``level``, from all nodes (tree, pos, n, h) of that level; n is the number of leaves of the tree."""
    runs = nodes.select("tree", "pos", "n", "h").repartition(F.col("tree"), F.shiftright("pos", SPAN)).sortWithinPartitions("tree", "pos")

    def rows_of(tree: int, block: int, n: int, own: list[str]) -> Iterator[tuple]:
        for j in range(1, SPAN + 1):
            if width(n, level + j - 1) <= 1:
                return
            own = [digest(*own[i : i + 2]) for i in range(0, len(own), 2)]
            for i, h in enumerate(own):
                yield level + j, tree, (block << (SPAN - j)) + i, n, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, out = None, [], []
        for batch in batches:
            for tree, pos, n, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (tree, pos >> SPAN, n):
                    if at:
                        out += rows_of(*at, own)
                    at, own = (tree, pos >> SPAN, n), []
                own.append(h)
            if len(out) >= OUT_ROWS:
                yield _batch(out, _NODE_TYPES)
                out = []
        if at:
            out += rows_of(*at, own)
        if out:
            yield _batch(out, _NODE_TYPES)

    return runs.mapInArrow(lean(run), _NODE)


_NODE_TYPES = {"level": pa.int32(), "tree": pa.int64(), "pos": pa.int64(), "n": pa.int64(), "h": pa.string()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def grow(leaves: DataFrame, most: int, store: str, which: Column) -> None:
    """Appends all nodes above these leaves to the store, run by run and ``SPAN`` levels at a time; no tree has more than ``most`` leaves, and ``which`` picks theirs."""
    level, nodes = 0, leaves
    while width(most, level) > 1:
        climb(nodes.where(F.col("n") > (1 << level)), level).write.mode("append").partitionBy("level").parquet(store)
        level += SPAN
        nodes = leaves.sparkSession.read.schema(_NODE).parquet(store).where((F.col("level") == level) & which)


def build(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: leaves over ``columns``, a tree for each ``group_col`` with leaves in the order of ``id_col``, null first.

    Rows with the same group and id follow each other by their leaf; those alike in that too have equal leaves, so their order doesn't
    matter. Groups follow each other bytewise, null first. Two nodes make one by the hash of both, an odd last one by its own. ``carry``
    are further narrow columns that travel with a leaf. Long texts are hashed where they are read and never shuffled; a group of any size
    lies in as many ranges as it fills, rows with one id included. An empty table has no root. Columns not named are not read, whatever their names.
    """
    spark = docs.sparkSession
    carry = carry or {}
    leaf = leaf_hash([docs[c] for c in columns])
    # The number tells rows apart that are alike in everything, so that a range of ids can end among them.
    narrow = docs.select(docs[group_col].cast("string").alias("group"), docs[id_col].alias("id"), leaf.alias("h"), *[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("_nth"))
    narrow = pinned(narrow.withColumn("_one", F.lit(1)))
    placed = running_sums(narrow, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("h"), F.col("_nth")], {"place": "_one"})
    released(narrow)
    counted = pinned(placed.groupBy("group").agg(F.count("*").alias("n"), (F.min("place") - 1).alias("start"), F.lit(1).alias("_one")))
    groups = running_sums(counted, [F.col("start")], {"tree": "_one"})
    released(counted)
    groups = groups.select(F.col("group").alias("_group"), "n", "start", (F.col("tree") - 1).cast("long").alias("tree"))
    leaves = pinned(placed.join(bounded(groups, BROADCAST_GROUPS), F.col("group").eqNullSafe(F.col("_group"))).select("tree", (F.col("place") - 1 - F.col("start")).cast("long").alias("pos"), "n", "id", "h", *carry))
    released(placed)
    most, n_groups = groups.agg(F.max("n"), F.count("*")).first()
    store = f"{shared_dir(spark).rstrip('/')}/merkle-{uuid.uuid4().hex}"
    spark.createDataFrame([], _NODE).write.partitionBy("level").parquet(store)
    grow(leaves, most or 0, store, F.col("tree") != TOP)
    tops = spark.read.schema(_NODE).parquet(store).where("pos = 0").where(F.col("level") == height_of(F.col("n"))).unionByName(leaves.where("n = 1").select(F.lit(0).alias("level"), "tree", "pos", "n", "h"))
    subroots = pinned(tops.select("tree", F.col("h").alias("subroot")))
    known = pinned(groups.join(subroots, "tree").select("tree", "n", F.col("_group").alias("group"), "subroot"))
    # The tree of the groups' roots; what isn't a group's has the number of groups as n.
    bottom = known.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("h"))
    grow(bottom, n_groups, store, F.col("tree") == TOP)
    root = known.select("subroot") if n_groups == 1 else spark.read.schema(_NODE).parquet(store).where(F.col("level") == max(1, (n_groups - 1).bit_length())).where(F.col("tree") == TOP).select("h")
    first = root.first() if n_groups else None
    return Manifest(leaves, known, store, first[0] if first else None, most or 0, n_groups)


def scan(items: DataFrame, nodes: DataFrame, above: DataFrame | None, level: int, payload: list[str]) -> DataFrame:
    """items (tree, pos, n, h, payload), all nodes of a level, with ``sides`` and ``siblings``: their way to the root.

    Run by run: first what the run's top has above it (``above``: tree, block, sides, siblings), then the nodes of the levels between,
    then the items, which are each other's siblings. ``sides`` has a letter a level: L or R for where the sibling stands, - where there
    is none; ``siblings`` are those hashes one after the other.
    """
    key = [F.col("tree"), F.col("block")]
    mine = items.select("tree", F.shiftright("pos", SPAN).alias("block"), F.lit(2).alias("kind"), F.lit(level).alias("level"), "pos", "n", "h", *payload)
    between = nodes.where((F.col("level") > level) & (F.col("level") < level + SPAN))
    between = between.select("tree", F.expr(f"shiftright(pos, {SPAN + level} - level)").alias("block"), F.lit(1).alias("kind"), "level", "pos", "n", "h")
    every = mine.unionByName(between, allowMissingColumns=True)
    if above is not None:
        every = every.unionByName(above.select("tree", "block", F.lit(0).alias("kind"), "sides", "siblings"), allowMissingColumns=True)
    else:
        every = every.withColumns({"sides": F.lit(None).cast("string"), "siblings": F.lit(None).cast("string")})
    names = ["tree", "block", "kind", "level", "pos", "n", "h", "sides", "siblings", *payload]
    runs = every.select(*names).repartition(*key).sortWithinPartitions("tree", "block", "kind", "level", "pos")
    out_schema = items.select("tree", "pos", "n", "h", *payload).schema.add("sides", "string").add("siblings", "string")

    def ways(pos: list[int], n: int, found: dict[int, list[str]], sides: str, siblings: str) -> Iterator[tuple[str, str]]:
        for p in pos:
            letters, hashes = [], []
            for j in range(SPAN):
                wide = width(n, level + j)
                if wide <= 1:
                    break
                other = (p >> j) ^ 1
                letters.append("-" if other >= wide else "L" if other < p >> j else "R")
                if other < wide:
                    hashes.append(found[level + j][other - (pos[0] >> j)])
            yield "".join(letters) + sides, "".join(hashes) + siblings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, up, found, rows = None, ("", ""), {}, []

        def flush() -> pa.RecordBatch | None:
            if not rows:
                return None
            whole = pa.concat_tables(rows).combine_chunks()
            pos = whole["pos"].to_pylist()
            found[level] = whole["h"].to_pylist()
            way = list(ways(pos, whole["n"][0].as_py(), found, *up))
            table = whole.select(["tree", "pos", "n", "h", *payload]).append_column("sides", pa.array([w[0] for w in way], pa.string())).append_column("siblings", pa.array([w[1] for w in way], pa.string()))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            trees, blocks, kinds = (table[c].to_pylist() for c in ("tree", "block", "kind"))
            edges = [i for i in range(len(trees)) if not i or (trees[i], blocks[i], kinds[i]) != (trees[i - 1], blocks[i - 1], kinds[i - 1])]
            for i, j in zip(edges, [*edges[1:], len(trees)], strict=True):
                if at != (trees[i], blocks[i]):
                    if (done := flush()) is not None:
                        yield done
                    at, up, found, rows = (trees[i], blocks[i]), ("", ""), {}, []
                part = table.slice(i, j - i)
                if kinds[i] == 0:
                    up = (part["sides"][0].as_py(), part["siblings"][0].as_py())
                elif kinds[i] == 1:
                    for lv, h in zip(part["level"].to_pylist(), part["h"].to_pylist(), strict=True):
                        found.setdefault(lv, []).append(h)
                else:
                    rows.append(part)
        if (done := flush()) is not None:
            yield done

    return runs.mapInArrow(lean(run), out_schema)


def ways_up(nodes: DataFrame, leaves: DataFrame, most: int, above: DataFrame | None, payload: list[str]) -> DataFrame:
    """leaves with ``sides`` and ``siblings``, from the top down, ``SPAN`` levels at a time; ``above`` (tree, sides, siblings) is what the trees' roots have above them."""
    rounds = max(1, -(-(max(most, 1) - 1).bit_length() // SPAN))
    done: DataFrame | None = None
    for r in reversed(range(rounds)):
        level, ended = SPAN * r, F.col("n") <= (1 << (SPAN * (r + 1)))
        ups = None
        if above is not None:
            ups = above.where(ended).select("tree", F.lit(0).cast("long").alias("block"), "sides", "siblings")
        if done is not None:
            taller = done.select("tree", F.col("pos").alias("block"), "sides", "siblings")
            ups = taller if ups is None else ups.unionByName(taller)
        items = leaves if r == 0 else nodes.where((F.col("level") == level) & (F.col("n") > (1 << level)))
        done = scan(items, nodes, ups, level, payload if r == 0 else [])
    return done


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves of the manifest, each with its way to the root: tree, pos, n, id, h, what was carried, sides, siblings, and its group's root, subroot."""
    nodes = manifest.nodes()
    tops = manifest.groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(manifest.n_groups).cast("long").alias("n"), F.col("subroot").alias("h"), F.col("n").alias("leaves"))
    upper = ways_up(nodes.where(F.col("tree") == TOP), tops, manifest.n_groups, None, ["leaves"])
    above = pinned(upper.select(F.col("pos").alias("tree"), F.col("leaves").alias("n"), "sides", "siblings"))
    payload = [c for c in manifest.leaves.columns if c not in ("tree", "pos", "n", "h")]
    found = ways_up(nodes.where(F.col("tree") != TOP), manifest.leaves, manifest.most_leaves, above, payload)
    return found.join(bounded(manifest.groups.select("tree", "subroot"), BROADCAST_GROUPS), "tree")


@arrow_udf(StringType())
def folded(leaf: pa.Array, sides: pa.Array, siblings: pa.Array) -> pa.Array:
    """The root that a leaf and its siblings give."""
    out = []
    for h, way, hashes in zip(leaf.to_pylist(), sides.to_pylist(), siblings.to_pylist(), strict=True):
        at = 0
        for side in way:
            if side == "-":
                h = digest(h)
                continue
            other, at = hashes[at : at + 64], at + 64
            h = digest(other, h) if side == "L" else digest(h, other)
        out.append(h)
    return pa.array(out, pa.string())


def verify(found: DataFrame, root: str | None, claimed: Column) -> DataFrame:
    """found, as ``proofs`` gives it, with ``folded_root``, from the ``claimed`` leaf up, and ``verified``: whether that is the root."""
    return found.withColumn("folded_root", folded(claimed, F.col("sides"), F.col("siblings"))).withColumn("verified", F.col("folded_root") == F.lit(root))
