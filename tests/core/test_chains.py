"""Ranking of chains against a walk, and the feed that is read by it, as a table and as a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomfold.operators import chains
from loomfold.sources import paged


def walked(links, starts, most=None):
    after = {}
    for node, then in links:
        if node is not None:
            after[node] = min((x for x in (after.get(node), then) if x is not None), default=None)
    out = {}
    for chain, node in starts:
        place, seen = 0, set()
        while node in after and node not in seen and (most is None or place < most):
            seen.add(node)
            out[chain, node] = min(place, out.get((chain, node), place))
            node, place = after[node], place + 1
    return out


def ranked(spark, links, starts, most=None):
    got = chains.places(spark.createDataFrame(links, "node string, then string"), spark.createDataFrame(starts, "chain int, node string"), most=most)
    rows = [((r["chain"], r["node"]), r["place"]) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("most", [None, 1, 5])
def test_places_are_a_walk(spark, most):
    some = random.Random(most)
    nodes = [f"n{i}" for i in range(60)]
    some.shuffle(nodes)
    links = [*zip(nodes[:40], [*nodes[1:40], None], strict=True)]  # one chain
    links += [*zip(nodes[40:50], [*nodes[41:50], nodes[43]], strict=True)]  # a tail into a ring
    links += [(nodes[50], nodes[10]), (nodes[51], nodes[51]), (nodes[52], "nowhere"), (nodes[53], nodes[54]), (nodes[53], nodes[55]), (nodes[54], None), (nodes[55], None), (None, nodes[0]), (nodes[56], None), (nodes[56], nodes[57])]
    starts = [(k, nodes[i]) for k, i in enumerate((0, 5, 39, 40, 50, 51, 52, 53, 56))] + [(99, "nowhere"), (98, None), (97, nodes[3])]
    assert ranked(spark, links, starts, most) == walked(links, starts, most)
    assert ranked(spark, links[:0], starts, most) == {}
    assert ranked(spark, links, starts[:0], most) == {}


def test_a_million_nodes_take_twenty_rounds(spark, monkeypatch):
    """Names tell nothing of the order; every place is that of the row that made it."""
    n = 1_000_000
    name = lambda c: F.sha2(c.cast("string"), 224)
    rows = spark.range(n)
    links = rows.select(name(F.col("id")).substr(1, 16).alias("node"), F.when(F.col("id") < n - 1, name(F.col("id") + 1).substr(1, 16)).alias("then"))
    rounds, was = [], chains.kept
    monkeypatch.setattr(chains, "kept", lambda df: rounds.append(1) or was(df))
    got = chains.places(links, rows.where("id = 0").select(F.lit(0).alias("chain"), name(F.col("id")).substr(1, 16).alias("node")))
    right = got.join(rows.select("id", name(F.col("id")).substr(1, 16).alias("node")), "node").where("id = place")
    assert right.count() == n
    assert len(rounds) <= 2 + 3 * 21


def page(posts, cursor, wide=0, **more):
    entries = [{"content": {"itemContent": {"tweet_results": {"result": {"rest_id": p, "text": "x" * wide}}}}} for p in posts] + ([{"content": {"cursorType": "Bottom", "value": cursor, **more}}] if cursor else [])
    return json.dumps({"data": {"user": {"result": {"timeline": {"timeline": {"instructions": [{"type": "TimelineAddEntries", "entries": entries}]}}}}}})


@pytest.mark.parametrize("text", [page(["1", "2"], "b"), page(["1", "2"], "b", 40_000), page(["1"], "b", 40_000, nested={"x": 1}), page(["1"], None, 40_000), page([], "b"), page(['"cursorType":"Bottom"', "{"], 'é"{}', 20_000), page(["1"], "b", 40_000).replace("TimelineAddEntries", "TimelineReplaceEntry")])
def test_ends_of_a_page_tell_its_cursor(tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    read = paged.feed_page(json.loads(text))
    assert paged.next_cursor(str(tmp_path), "p") == (bool(read["posts"]), read["cursor"])
    assert paged.next_cursor(str(tmp_path), "q") == (False, None)


def test_stored_feed_is_the_walk(spark, tmp_path):
    names = ["start", *[f"c{k:x}" for k in random.Random(1).sample(range(10**6), 40)]]
    for i, name in enumerate(names):
        after = names[i + 1] if i + 1 < len(names) else names[7]  # the last leads back
        (tmp_path / f"{name}.json").write_text(page([f"{i}-{k}" for k in range(i % 3 + 1)], after))
    (tmp_path / "stray.json").write_text(page(["stray"], "start"))
    got = sorted((r["page"], r["pos"], json.loads(r["post"])["rest_id"], r["cursor"]) for r in paged.feed(spark, str(tmp_path)).collect())
    want = [(i, k, f"{i}-{k}", names[i + 1] if i + 1 < len(names) else names[7]) for i in range(len(names)) for k in range(i % 3 + 1)]
    assert got == want
    spark.dataSource.register(paged.PagedFeed)
    loaded = spark.read.format("paged_feed").option("path", str(tmp_path)).load()
    assert sorted((r["page"], r["pos"], json.loads(r["post"])["rest_id"], r["cursor"]) for r in loaded.collect()) == want
    assert loaded.rdd.getNumPartitions() == len(names)


@pytest.mark.parametrize("noted", [True, False])
def test_stream_goes_on_in_the_middle_of_a_feed(spark, tmp_path, noted):
    """Two pages a batch; the query is stopped, pages are added, and it goes on from its checkpoint without a row twice or missing."""
    spark.dataSource.register(paged.PagedFeed)
    folder, out = tmp_path / "pages", str(tmp_path / "out")
    os.makedirs(folder)
    for i in range(5):
        (folder / f"{'start' if not i else f'p{i}'}.json").write_text(page([f"{i}a", f"{i}b"], f"p{i + 1}"))

    def run():
        stream = spark.readStream.format("paged_feed").option("path", str(folder)).option("maxPagesPerTrigger", 2)
        stream = (stream.option("progress", str(tmp_path / "progress")) if noted else stream).load()
        query = stream.select("page", "pos", F.get_json_object("post", "$.rest_id").alias("id")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
            return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        finally:
            query.stop()

    assert run() == ([4, 4, 2] if noted else [10])
    for i in range(5, 9):
        (folder / f"p{i}.json").write_text(page([f"{i}a", f"{i}b"], f"p{i + 1}" if i < 8 else None))
    again = run()
    assert sum(again) == 8
    assert not noted or max(again) == 4
    assert run() == []
    got = sorted((r["page"], r["pos"], r["id"]) for r in spark.read.parquet(out).collect())
    assert got == [(i, k, f"{i}{x}") for i in range(9) for k, x in enumerate("ab")]
