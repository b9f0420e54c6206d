"""Ledger, runs, jobs, export, sources and streams."""

import base64
import io
import json
import random
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.content import columns, posts
from loomfold.operators import checks, export, jobs, ledger, names, routing, runs, sinks
from loomfold.sources import details
from loomfold.sources.paged import PagedFeed, pages
from loomfold.sources.paged import feed as stored_feed
from loomfold.streaming import jobs as job_stream
from loomfold.streaming.incremental import Exporter, Rules, start_cursor

URL = "https://x.com/a/status/"


def values(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_limit_and_exclusion_don_t_commute(spark):
    items = spark.createDataFrame([(i, str(i)) for i in range(10)] + [(10, None)], "pos int, id string")
    seen = spark.createDataFrame([("0",), ("1",), ("1",), (None,)], "id string")
    assert values(ledger.limit_then_exclude(items, seen, "id", 3, "pos"), "pos") == [(2,)]
    assert values(ledger.exclude_then_limit(items, seen, "id", 3, "pos"), "pos") == [(2,), (3,), (4,)]
    assert (10, None) in values(ledger.exclude(items, seen, "id"), "pos", "id")


def test_ledger_tail_and_append(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, seq long")
    new = spark.createDataFrame([("a", 4), ("d", 5)], "id string, seq long")
    assert values(ledger.appended(old, new, "id", "seq", 3), "id", "seq") == [("b", 2), ("c", 3), ("d", 5)]
    settled = spark.createDataFrame([("b",)], "id string")
    assert values(ledger.new_backlog(old, new, settled, "id", "seq", 2), "id") == [("c",), ("d",)]


def test_backlog_and_details(spark):
    backlog = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    details = spark.createDataFrame([("a", True, "full"), ("b", False, None), ("a", False, None)], "id string, found boolean, text string")
    assert values(ledger.backlog_status(backlog, details, "id", "found"), "id", "backlog_status") == [("a", "completed"), ("b", "gone"), ("c", "pending")]
    roots = spark.createDataFrame([("a", "stub"), ("z", "stub")], "id string, text string")
    assert values(ledger.detail_or_root(roots, details.where("found"), "id", ["text"]), "id", "text") == [("a", "full"), ("z", "stub")]


def test_queue_selection_and_snapshots(spark):
    queue, new, done = (spark.createDataFrame(x, "id string, pos int") for x in ([("a", 0)], [("b", 1), ("b", 2), ("c", 3), (None, 4), ("d", 5), ("e", 6)], [("c", 0)]))
    assert values(ledger.appended_to_queue(queue, new, done, "id", "pos", 3), "id", "pos") == [("b", 1), ("d", 5)]
    events = spark.createDataFrame([("u", 1, "add"), ("u", 2, "remove"), ("v", 3, "add")], "url string, seq int, action string")
    assert values(ledger.last_choice(events, "url", "action", "seq", "add"), "url") == [("v",)]
    shots = spark.createDataFrame([("k", 1, 5, "early"), ("k", 2, 5, "late"), ("k", 0, 3, "first")], "k string, seq int, score int, html string")
    assert values(ledger.best_snapshot(shots, "k", ["score"], "seq"), "html", "first_seen") == [("early", 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a.md", "A.md", "a-2.md", "b", ".c", "a-2-2.md"]), max_size=12))
def test_free_names_never_collide(names):
    given, run = set(), ledger.Names()
    for n in names:
        made = run.give(n)
        assert made.lower() not in given
        given.add(made.lower())


def test_unique_names(spark):
    rows = spark.createDataFrame([(1, "r", "a.md"), (2, "r", "A.md"), (3, "r", "a-2.md"), (4, "r", "a.md"), (1, "s", "a.md")], "pos int, run string, name string")
    assert values(names.unique_names(rows, "name", "run", "pos"), "run", "pos", "unique_name") == [("r", 1, "a.md"), ("r", 2, "A-2.md"), ("r", 3, "a-2-2.md"), ("r", 4, "a-3.md"), ("s", 1, "a.md")]
    assert values(ledger.numbered_names(rows, "name", "run", "pos").where("run = 'r'"), "pos", "unique_name")[1] == (2, "A-2.md")


def test_runs(spark):
    rows = spark.createDataFrame([("g", i, a, k) for i, (a, k) in enumerate([("Ana", "1"), ("unknown", "2"), ("ana", "1"), ("ANA", "3"), ("bob", "4"), ("ana", "5")])], "g string, pos int, who string, id string")
    assert values(runs.leading_run(rows, "g", "pos", "who"), "pos") == [(0,)]
    assert values(runs.page_thread(rows, "g", "pos", "who", "id"), "pos") == [(0,), (3,)]
    assert values(runs.focused(rows, "g", "pos", F.col("id") == "4"), "pos") == [(4,)]
    assert values(runs.focused(rows, "g", "pos", F.col("id") == "none"), "pos") == [(0,)]
    kinds = spark.createDataFrame([("g", i, k) for i, k in enumerate(["li", "li", None, None, "q", "li"])], "g string, pos int, kind string")
    assert values(runs.island_lengths(kinds, "g", "pos", "kind").drop("kind"), "island", "run_length", "run_start") == [(1, 2, 0), (2, 2, 2), (3, 1, 4), (4, 1, 5)]
    bad = spark.createDataFrame([("g", i, x) for i, x in enumerate([True, True, False, True, None, True])], "g string, pos int, bad boolean")
    assert [x for _, x in values(runs.failure_runs(bad, "g", "pos", F.col("bad")), "pos", "failures_in_a_row")] == [1, 2, 0, 1, 0, 1]


def test_array_functions(spark):
    one = spark.range(1)
    assert one.select(runs.shares(F.expr("array(30, 10, cast(null as int))")).alias("x")).first().x == [75, 25, 0]
    assert one.select(runs.shares(F.expr("array(0, 0)")).alias("x")).first().x is None
    variant = "named_struct('bitrate', {}, 'content_type', '{}', 'url', '{}')"
    of = lambda *v: one.select(runs.best_variant(F.expr(f"array({', '.join(variant.format(*x) for x in v)})")).alias("x")).first().x
    assert of((1, "video/mp4", "low"), (9, "video/mp4", "b"), (9, "video/mp4", "c"), (99, "hls", "h")) == "b"
    assert of((1, "hls", ""), (1, "hls", "h")) == "h"
    spans = "array(named_struct('start', 5, 'end', 9), named_struct('start', 0, 'end', 6), named_struct('start', 6, 'end', 7), named_struct('start', 6, 'end', 8))"
    assert [(s.start, s.end) for s in one.select(runs.spliced(F.expr(spans)).alias("x")).first().x] == [(0, 6), (6, 7)]


def test_job_transitions():
    job = jobs.created([f"{URL}1/photo/1", "nope", f"{URL}1", f"{URL}2", *[f"{URL}{i}" for i in range(3, 300)]], datetime(2024, 1, 2, 3, 4, 5))
    assert (len(job.urls), job.failures, job.folder) == (200, (("nope", "no address of a post"),), "batch-20240102-030405")
    job, name = jobs.recorded(job, True, "A.md", f"{URL}1?x")
    assert (name, job.completed, job.current) == ("A.md", 1, f"{URL}2")
    assert jobs.recorded(job, True, "a.md", f"{URL}1")[0] is job
    job, name = jobs.recorded(job, True, "a.md")
    assert name == "a-2.md"
    for _ in range(5):
        job, _ = jobs.recorded(job, False, "error")
    assert (job.status, job.failed_in_a_row) == ("paused", 5)
    assert jobs.recorded(job, True, "x.md") == (job, None)
    job = jobs.resumed(job)
    assert (job.status, job.failed_in_a_row, job.pause_reason) == ("running", 0, None)
    assert jobs.appended(job, [f"{URL}999"], set()) == (job, 0)
    assert jobs.paused(jobs.cancelled(job)).status == "cancelled"
    late = jobs.ticked(jobs.dispatched(job, 1000), 1000 + jobs.ITEM_MS)
    assert late.failures[-1][1] == "timed out"
    small = jobs.created([f"{URL}1"], datetime(2024, 1, 1))
    small, n = jobs.appended(small, [f"{URL}1/x", f"{URL}2", "bad", f"{URL}3", f"{URL}2"], {"3"})
    assert (n, small.urls[1:]) == (1, (f"{URL}2",))
    assert jobs.recorded(jobs.recorded(small, True, "a")[0], True, "b")[0].status == "done"


def test_job_fold_is_the_machine(spark):
    r = random.Random(1)
    results = [(f"j{j}", i, r.random() < 0.5) for j in range(20) for i in range(30)]
    got = {x.job: (x.status, x.completed, x.failed) for x in jobs.folded(spark.createDataFrame(results, "job string, seq int, bad boolean"), "job", "seq", F.col("bad"), 4).collect()}
    for j in {x[0] for x in results}:
        job = jobs.Job(j, tuple(f"{URL}{i}" for i in range(30)))
        for _, _, bad in [x for x in results if x[0] == j]:
            job, _ = jobs.recorded(job, not bad, "n.md", pause_at=4)
        assert got[j][1:] == (job.completed, len(job.failures)), j


def test_review_cadence():
    state = jobs.Review()
    for _ in range(29):
        state = state.exported()
    assert not state.due()
    state = state.exported()
    assert state.due()
    state = state.snoozed()
    assert (state.due(), state.next_at) == (False, 80)
    for _ in range(50):
        state = state.exported()
    assert state.due()
    assert not state.snoozed().due()
    assert state.closed().exported().count == 80


def wire(spark, **more):
    base = {"type": "tweet", "author": ("Ana B", "ana"), "title": None, "markdown": "# Ana B (@ana)\n\nHello *world* ![Image](https://pbs.twimg.com/media/P?format=png&name=large)\n\n---\n\n> Source: u\n> Date: d", "source_url": "https://x.com/ana/status/1", "date": "2024-01-02T03:04:05.000Z", "tweet_id": "1", "counts": (1200, None, 5, None, None)} | more
    schema = "type string, author struct<name: string, handle: string>, title string, markdown string, source_url string, date string, tweet_id string, counts struct<likes: bigint, reposts: bigint, replies: bigint, bookmarks: bigint, views: bigint>"
    return spark.createDataFrame([tuple(base.values())], schema)


def test_front_matter(spark):
    plain = export.post_processed(wire(spark), export.Options(fields={"source": False})).first()
    assert plain.filename == "ana-1.md"
    assert plain.markdown.startswith('---\nauthor: "Ana B"\nhandle: "ana"\ndate: 2024-01-02T03:04:05.000Z\ntype: tweet\nlikes: 1200\nreplies: 5\n---\n# Ana B (@ana)\n\nHello')
    notes = export.post_processed(wire(spark), export.Options(for_notes=True, run_date="2024-05-06", filename_template="{date} {datetime} {handle}/{slug}", tags_template="a b, {type}, {nope}, x-{handle}, #")).first()
    assert notes.filename == "2024-01-02 2024-01-02_0304 anahello-world-source-u-date-d.md"
    head = notes.markdown.split("---\n")[1]
    assert head == 'title: "Post by ana on X"\nsource: "https://x.com/ana/status/1"\nauthor: "[[ana]]"\nauthor_name: "Ana B"\nhandle: "ana"\npublished: 2024-01-02\ncreated: 2024-05-06\ntype: tweet\ndescription: "Hello world"\ntags: [a-b, tweet, x-ana]\nlikes: 1200\nreplies: 5\n'


def test_stats_and_images(spark):
    line = "💬 5 · ❤️ 1.2K"
    bare = export.Options(include_metadata=False, inline_stats=True)
    post = export.post_processed(wire(spark, markdown="body\n\n---\n> Source: u\n> Date: d"), bare).first().markdown
    assert post == f"body\n\n{line}\n\n---\n> Source: u\n> Date: d"
    assert export.post_processed(wire(spark, markdown="body  \n"), bare).first().markdown == f"body\n\n{line}\n"
    assert export.post_processed(wire(spark, type="thread", markdown="one\n\n---\n\ntwo"), bare).first().markdown == f"one\n\n\n{line}\n---\n\ntwo"
    assert export.post_processed(wire(spark, type="thread", markdown="one\n\n---\n\ntwo"), export.Options(inline_stats=True)).first().markdown.endswith(f"---\none\n\n\n{line}\n---\n\ntwo")
    local = export.post_processed(wire(spark, markdown="![Image](https://pbs.twimg.com/media/P?format=png) ![Link card preview](https://pbs.twimg.com/c.jpg) ![x](https://e.org/y.png) ![Image](https://pbs.twimg.com/media/P?format=png)"), export.Options(include_metadata=False, download_images=True)).first()
    assert local.markdown == "![Image](ana-1/P.png) ![Link card preview](https://pbs.twimg.com/c.jpg) ![x](https://e.org/y.png) ![Image](ana-1/P.png)"
    assert [(i.url, i.filename) for i in local.images] == [("https://pbs.twimg.com/media/P?format=png", "ana-1/P.png")]


def test_csv(spark):
    rows = wire(spark, author=('Ana, "B"', "ana")).withColumn("body_markdown", F.lit("a **b**\n"))
    assert export.csv_header(export.Options()) == "date,author,handle,type,likes,reposts,replies,bookmarks,views,source,text"
    assert export.csv_lines(rows, export.Options()).first().csv_line == '2024-01-02T03:04:05.000Z,"Ana, ""B""",ana,tweet,1200,,5,,,https://x.com/ana/status/1,a b'
    assert export.csv_columns(export.Options(include_metadata=False)) == ["date", "source", "text"]
    assert export.csv_columns(export.Options(for_notes=True, fields={"tags": False}))[:3] == ["published", "created", "author"]


def test_files(spark):
    assert export.effective_output("csv", "separate", True, False) == ("combined", True)
    assert export.effective_output("md", "both", True, True) == ("both", False)
    rows = spark.createDataFrame([("r", 2, "b.md", " two "), ("r", 1, "a.md", "one\n"), ("s", 1, "é.md", "")], "run string, pos int, name string, markdown string")
    assert values(export.digest(rows, "run", "pos"), "run", "content") == [("r", "one\n\n---\n\ntwo\n"), ("s", "\n")]
    at = datetime(2024, 1, 2, 3, 4, 6)
    made = export.zip_archives(rows, "run", "pos", "name", "markdown", at).withColumn("url", export.data_url(F.col("archive"))).collect()
    for x in made:
        assert base64.b64decode(x.url.partition(",")[2]) == bytes(x.archive)
        with zipfile.ZipFile(io.BytesIO(x.archive)) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert z.namelist() == (["a.md", "b.md"] if x.run == "r" else ["é.md"])
    job = spark.createDataFrame([("r", "done", 2), ("t", "cancelled", 0)], "run string, status string, completed int")
    items = rows.select("run", "pos", F.lit("u").alias("url"), F.col("name").alias("filename"))
    read = {x.run: json.loads(x.manifest) for x in export.manifest(job, items, "run", "pos").collect()}
    assert [i["filename"] for i in read["r"]["items"]] == ["a.md", "b.md"]
    assert read["t"]["items"] == []
    assert values(rows.select(export.item_name(F.col("name"), "html").alias("n")), "n")[0] == ("a.html",)
    assert export.Options.merged({"inline_stats": True, "unknown": 1}, {"run_date": "x"}) == export.Options(inline_stats=True, run_date="x")


def feed(posts, cursor):
    entries = [{"content": {"itemContent": {"tweet_results": {"result": {"rest_id": p}}}}} for p in posts] + ([{"content": {"cursorType": "Bottom", "value": cursor}}] if cursor else [])
    return {"data": {"user": {"result": {"timeline": {"timeline": {"instructions": [{"type": "TimelineAddEntries", "entries": entries}]}}}}}}


def test_paging_stops():
    endless = lambda c: feed(["p"], f"{c}x")
    assert len(list(pages(endless, most=7))) == 7
    assert len(list(pages(lambda c: feed(["p"], None)))) == 1
    assert list(pages(lambda c: feed([], "next"))) == []


def test_paged_source(spark, tmp_path):
    for name, body in {"start": feed(["1", "2"], "b"), "b": feed(["3"], "c"), "c": feed(["4"], None)}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    spark.dataSource.register(PagedFeed)
    ids = F.get_json_object("post", "$.rest_id").alias("id")
    assert values(spark.read.format("paged_feed").option("path", str(tmp_path)).load().select("page", "pos", ids), "page", "pos", "id") == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (2, 0, "4")]
    assert spark.read.format("paged_feed").option("path", str(tmp_path)).option("maxPages", 1).load().count() == 2
    assert values(stored_feed(spark, str(tmp_path)).select("page", "pos", ids), "page", "pos", "id") == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (2, 0, "4")]
    assert stored_feed(spark, f"file://{tmp_path}", most=1).count() == 2 and stored_feed(spark, str(tmp_path), "b").count() == 2 and stored_feed(spark, str(tmp_path), "none").count() == 0
    assert spark.read.format("paged_feed").option("path", str(tmp_path)).option("cursor", "b").load().count() == 2
    stream = spark.readStream.format("paged_feed").option("path", str(tmp_path)).load().select(ids)
    query = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert values(spark.table("feed"), "id") == [("1",), ("2",), ("3",), ("4",)]
    finally:
        query.stop()


def test_incremental_export(spark, tmp_path):
    schema = "key string, seq long, handle string, is_repost boolean, ts timestamp, complete boolean"
    row = lambda key, seq, handle="ana", repost=False, day="2024-01-05", complete=True: (key, seq, handle, repost, datetime.fromisoformat(day), complete)
    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"), Rules(owner="ANA", first_day="2024-01-01", last_day="2024-01-31", most_items=3))
    first = spark.createDataFrame([row("a", 1), row("b", 2, "bob"), row("c", 3, repost=True), row("d", 4, day="2023-01-01"), row("e", 5, complete=False), row("a", 6), row("f", 7), row("g", 8)], schema)
    exporter.write(first, 0)
    exporter.write(first, 0)  # run again after a crash: nothing changes
    assert values(exporter.ledger(spark), "key") == [("a",), ("f",)]
    assert values(exporter.pending(spark), "key") == [("e",)]
    exporter.write(spark.createDataFrame([row("a", 9), row("e", 10), row("g", 11)], schema), 1)
    assert values(exporter.ledger(spark), "key") == [("a",), ("e",), ("f",), ("g",)]
    assert values(exporter.pending(spark), "key") == []
    assert values(exporter.output(spark).where("status = 'done'"), "key") == [("a",), ("e",), ("f",), ("g",)]


def test_incremental_export_loses_nothing_beyond_its_cap(spark, tmp_path):
    schema = "key string, seq long, canonical_key string"
    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "canonical_key", "status"), Rules(most_items=2))
    exporter.write(spark.createDataFrame([(f"k{i}", i, None) for i in range(7)] + [("k5", -1, "other")], schema), 0)
    assert values(exporter.output(spark), "key", "seq") == [("k0", 0), ("k5", -1)]
    assert values(exporter.ledger(spark), "key") == [("k0",), ("k5",), ("other",)]
    # The next batch brings one known item, one known by its second id, and a new one; what was held goes first.
    for _ in range(2):
        exporter.write(spark.createDataFrame([("k0", 20, None), ("other", 21, None), ("new", 22, None)], schema), 1)
    for n in (2, 3, 4):
        exporter.write(spark.createDataFrame([], schema), n)
    assert values(exporter.output(spark), "key") == [("k0",), ("k1",), ("k2",), ("k3",), ("k4",), ("k5",), ("k6",), ("new",)]


def test_incremental_export_restarts(spark, tmp_path):
    """Two streams over one state, the second from the first one's checkpoint and with one more file."""
    source, exporter = tmp_path / "in", Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"), Rules(ledger_tail=4))
    for run, keys in enumerate(("abc", "cd")):
        spark.createDataFrame([(k, 10 * run + i) for i, k in enumerate(keys)], "key string, seq long").coalesce(1).write.mode("append").parquet(str(source))
        exporter.start(spark.readStream.schema("key string, seq long").parquet(str(source)), str(tmp_path / "cp")).awaitTermination(60)
    assert values(exporter.output(spark), "key", "seq") == [("a", 0), ("b", 1), ("c", 2), ("d", 11)]


def test_incremental_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(str(i % 5), i) for i in range(20)], "key string, seq long").repartition(3).write.parquet(str(source))
    exporter = Exporter(str(tmp_path / "state"), lambda items: items.select("key", "seq", "status"))
    stream = spark.readStream.schema("key string, seq long").option("maxFilesPerTrigger", 1).parquet(str(source))
    exporter.start(stream, str(tmp_path / "cp")).awaitTermination(60)
    assert values(exporter.ledger(spark), "key") == [(str(i),) for i in range(5)]


def test_cursors(spark):
    cursors = spark.createDataFrame([("resume", "likes", "r", None, None), ("date", "likes", "d", "2024-01-01", None)], "mode string, source string, cursor string, date_from string, date_to string")
    assert start_cursor(cursors, "recent", "likes") is None
    assert start_cursor(cursors, "resume", "likes") == "r"
    assert start_cursor(cursors, "resume", "home") is None
    assert start_cursor(cursors, "date", "likes", "2024-01-01") == "d"
    assert start_cursor(cursors, "date", "likes", "2024-01-02") is None


def test_job_stream(spark, tmp_path):
    urls = [f"{URL}{i}" for i in range(3)]
    events = [("j", 0, "start", json.dumps(urls), None, None, None), ("j", 1, "result", urls[0], True, "a.md", None), ("j", 2, "result", urls[0], True, "late.md", None), ("j", 3, "pause", None, None, None, None), ("j", 4, "result", urls[1], True, "x.md", None),
              ("j", 5, "resume", None, None, None, None), ("j", 6, "result", urls[1], False, "error", None), ("j", 7, "result", urls[2], True, "A.md", None), ("k", 8, "result", urls[0], True, "none", None)]
    spark.createDataFrame(events, job_stream.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = job_stream.run_jobs(spark.readStream.schema(job_stream.EVENTS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    rows = {r.seq: r for r in spark.table("states").collect()}
    assert (rows[7].status, rows[7].completed, rows[7].failed, rows[7].name) == ("done", 2, 1, "A-2.md")
    assert (rows[2].completed, rows[4].next_index, rows[3].status) == (1, 1, "paused")
    assert 8 not in rows


class State:
    """What a job's group sees of its state, for steps of a timer's own."""

    def __init__(self):
        self.value, self.hasTimedOut, self.armed = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.armed = value, None

    def setTimeoutDuration(self, ms):
        self.armed = ms


def test_job_stream_arms_timers_and_times_out():
    state, urls = State(), [f"{URL}1", f"{URL}1/photo/2", "no address", f"{URL}2", f"{URL}3"]
    names = ["job", "seq", "kind", "url", "success", "name", "at_ms"]
    step = lambda *events: pd.concat(list(job_stream.run_group(("j",), iter([pd.DataFrame([("j", *e) for e in events], columns=names)]), state)))
    out = step((1, "start", json.dumps(urls), None, None, 1000))
    assert out[["status", "failed", "next_index"]].values.tolist() == [["running", 1, 0]] and state.armed == jobs.ITEM_MS
    assert job_stream._load(state.get[0])[0].deadline == 1000 + jobs.ITEM_MS and len(job_stream._load(state.get[0])[0].urls) == 3
    # The timer goes off: the item failed, a row says so, and the next one is on its way.
    state.hasTimedOut = True
    out = pd.concat(list(job_stream.run_group(("j",), iter([]), state)))
    assert out[["seq", "status", "failed", "next_index"]].values.tolist() == [[1, "running", 2, 1]] and state.armed == jobs.ITEM_MS
    state.hasTimedOut = False
    out = step((2, "result", f"{URL}2", True, "a.md", 2000), (3, "tick", None, None, None, 2001 + jobs.ITEM_MS))
    assert out[["status", "completed", "failed"]].values.tolist() == [["running", 1, 2], ["done", 1, 3]] and state.armed is None
    step((4, "append", json.dumps([f"{URL}9"]), None, None, None))
    assert state.armed is None


def test_job_stream_appends_what_the_ledger_does_not_have(spark, tmp_path):
    urls = lambda *n: json.dumps([f"{URL}{i}" for i in n])
    events = [("j", 0, "start", urls(1, 2), None, None, 5), ("j", 1, "append", urls(3, 4, 2, 5), None, None, 6), ("j", 2, "append", urls(4), None, None, 7)]
    spark.createDataFrame(events, job_stream.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    ledger_ids = spark.createDataFrame([("4",), (None,)], "key string")
    stream = job_stream.run_jobs(spark.readStream.schema(job_stream.EVENTS).parquet(str(tmp_path / "in")), ledger_ids)
    query = stream.writeStream.format("memory").queryName("appended").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    rows = spark.table("appended").collect()
    assert {r.seq for r in rows} == {0, 1} and all(r.status == "running" and r.next_index == 0 for r in rows)
    held = job_stream.without_exported(spark.createDataFrame(events, job_stream.EVENTS), ledger_ids).where("kind = 'append'").collect()
    assert sorted(json.loads(r.url)[0][-1] for r in held) == ["2", "3", "5"]


def test_order_counts_and_settling(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    items = one([(i, k) for i, k in enumerate("abcdefg")], "pos int, key string")
    old = one([("b",), ("d",), ("g",), (None,)], "key string")
    assert values(ledger.exclusion_counts(items, old, "key", 2, "pos"), "taken", "skipped") == [(2, 1)]
    assert values(ledger.exclusion_counts(items, old, "key", 50, "pos"), "taken", "skipped") == [(4, 3)]
    assert values(ledger.exclusion_counts(items.limit(0), old, "key", 2, "pos"), "taken", "skipped") == [(0, 0)]
    assert values(ledger.new_count(items.unionByName(one([(9, None)], "pos int, key string")), old, one([("a",)], "key string"), "key"), "n_new") == [(4,)]
    assert [r.key for r in ledger.ordered_output(items.where("pos > 4"), items.where("pos < 2"), "pos").collect()] == ["f", "g", "a", "b"]
    run = one([(0, "done"), (1, "gone"), (2, "done"), (3, "rate_limit"), (4, "done"), (5, None)], "pos int, status string")
    stopped = ledger.stopped(run, "pos", "status")
    assert values(stopped, "pos", "status") == [(0, "done"), (1, "gone"), (2, "done"), (3, "rate_limit"), (4, "pending"), (5, "pending")]
    assert values(stopped.where(ledger.settled(F.col("status"))), "pos") == [(0,), (1,), (2,)]
    assert values(stopped.where(ledger.settled(F.col("status"), F.col("pos") != 4)), "pos") == [(0,), (1,), (2,), (4,)]
    assert values(ledger.stopped(run.where("pos IN (0, 5)"), "pos", "status").where(ledger.settled(F.col("status"), F.lit(None).cast("boolean"))), "pos") == [(0,)]
    assert values(ledger.ledger_entries(one([("1", "9", 4), ("2", None, 5), ("9", "9", 6)], "a string, b string, at long"), ["a", "b"], "at"), "key", "seq") == [("1", 4), ("2", 5), ("9", 4)]
    staged = one([("a", 1, "old"), ("a", 2, "new"), ("z", 1, "no")], "key string, staged_at int, content string")
    assert values(ledger.finalised(staged, items, "key", "pos"), "key", "pos", "content") == [("a", 0, "new")]
    queue = one([("a", 0), ("b", 1)], "key string, pos int")
    assert values(ledger.appended_to_queue(queue, items.select("key", "pos"), one([("c",)], "key string"), "key", "pos", 4), "key") == [("d",), ("e",)]
    assert ledger.appended_to_queue(queue, items.select("key", "pos"), old.where("key = 'x'"), "key", "pos", 1).count() == 0


def test_names_of_null_runs_and_null_names(spark):
    rows = spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate([(None, "a.md"), (1, "a.md"), (None, "A.md"), (1, None), (None, None), (1, "a.md"), (None, ".md"), (None, ".md")])], "pos int, run int, name string")
    got = {r.pos: r.unique_name for r in names.unique_names(rows, "name", "run", "pos").collect()}
    assert got == {0: "a.md", 1: "a.md", 2: "A-2.md", 3: None, 4: None, 5: "a-2.md", 6: ".md", 7: ".md-2"}
    many = ledger.Names()
    assert [many.give("x.md") for _ in range(20_000)][-1] == "x-20000.md"


def test_progress(spark):
    assert [jobs.Progress(8, 1).percent(), jobs.Progress(8, 0, 3).percent(), jobs.Progress(0).percent(), jobs.Progress(3, 1, 1).percent(), jobs.Progress(200, 199).percent()] == [13, 38, 0, 67, 100]
    rows = spark.createDataFrame([(1, 0, 8), (0, 3, 8), (0, 0, 0), (1, 1, 3), (199, 0, 200)], "c int, f int, t int")
    assert [r[0] for r in rows.select(jobs.progress_percent(F.col("c"), F.col("f"), F.col("t"))).collect()] == [13, 38, 0, 67, 100]
    results = spark.createDataFrame([(True, "m", "n"), (True, None, "n"), (None, "m", "n"), (False, "m", "n")], "s boolean, m string, n string")
    assert [r[0] for r in results.select(jobs.valid_result(F.col("s"), F.col("m"), F.col("n"))).collect()] == [True, False, False, False]


def test_documents_on_frames(spark):
    raw = json.dumps({"rest_id": "7", "legacy": {"full_text": "Hi"}, "core": {"user_results": {"result": {"core": {"name": "Ana", "screen_name": "ana"}}}}})
    docs = spark.createDataFrame([(raw,), (None,), ("no json",)], "raw string").select(columns.post_documents("raw").alias("document"))
    rows = columns.wire_rows(docs, handle_prefix="@").select("author.handle", "tweet_id", "markdown", columns.html_fragment_of("document").alias("html")).collect()
    assert rows[0].handle == "@ana"
    assert rows[0].markdown.startswith("# Ana (@ana)\n\nHi\n")
    assert (rows[1].markdown, rows[2].markdown) == (None, None)
    page = spark.createDataFrame([(1, "https://x.com/a/status/1", "<article role=article><div data-testid=tweetText>x</div></article>"), (2, None, None)], "page_id int, url string, html string")
    assert [r.document is None for r in sorted(columns.documents_of_pages(page).collect())] == [False, True]
    assert columns.blocks_of_pages(page).count() == 0


@pytest.mark.parametrize(("status", "want"), [(429, "rate_limit"), (503, "transient"), (None, "transient"), (404, "permanent")])
def test_error_classes(spark, status, want):
    assert spark.createDataFrame([(status,)], "s int").select(jobs.error_class(F.col("s")).alias("c")).first().c == want


def run_rows(spark, n):
    raw = [json.dumps({"rest_id": str(i), "legacy": {"full_text": f"Post *{i}*", "created_at": "Sat Mar 02 07:08:09 +0000 2024"}, "core": {"user_results": {"result": {"core": {"name": "Ana", "screen_name": "ana"}}}}}) for i in range(n)]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "pos int, raw string").select("pos", columns.post_documents("raw").alias("document"))
    return columns.wire_rows(docs).withColumn("body_markdown", columns.markdown_body_of("document"))


@pytest.mark.parametrize("fmt", ["md", "txt", "html", "json", "csv"])
def test_a_run_writes_its_files(spark, tmp_path, fmt):
    at = datetime(2024, 3, 2, 7, 8)
    written = sinks.write_run(run_rows(spark, 3), str(tmp_path / fmt), fmt, "both", "pos", at, export.Options(), failures=[{"url": "u", "error": "e"}]).collect()
    names = {w["name"] for w in written}
    items = set() if fmt == "csv" else {f"ana-{i}.{fmt}" for i in range(3)}
    assert names == items | {f"x-compilation-20240302.{fmt}", "data.json"}
    assert {p.name: p.stat().st_size for p in (tmp_path / fmt).iterdir()} == {w["name"]: w["n_bytes"] for w in written} and not any(w["error"] for w in written)
    manifest = json.loads((tmp_path / fmt / "data.json").read_text())
    assert (manifest["completed"], manifest["failures"], [i["filename"] for i in manifest["items"]]) == (3, [{"url": "u", "error": "e"}], ["ana-0.md", "ana-1.md", "ana-2.md"])
    whole = (tmp_path / fmt / f"x-compilation-20240302.{fmt}").read_text()
    if fmt == "json":
        assert [d["metadata"]["tweetId"] for d in json.loads(whole)] == ["0", "1", "2"]
        assert json.loads((tmp_path / fmt / "ana-1.json").read_text()) == json.loads(whole)[1]
    assert whole.index("Post *0*" if fmt in ("md", "json", "html") else "Post 0") < whole.index("Post *2*" if fmt in ("md", "json", "html") else "Post 2")


def test_a_run_writes_archives_unless_they_are_empty(spark, tmp_path):
    at = datetime(2024, 3, 2, 7, 8)
    names = {w["name"] for w in sinks.write_run(run_rows(spark, 2), str(tmp_path / "a"), "txt", "files", "pos", at, export.Options(), zip_items=True).collect()}
    assert names == {"x-files-20240302.zip", "data.json"}
    with zipfile.ZipFile(tmp_path / "a" / "x-files-20240302.zip") as z:
        assert z.namelist() == ["ana-0.txt", "ana-1.txt"] and z.read("ana-1.txt").decode().startswith("Ana (@ana)\n\nPost 1\n")
    empty = sinks.write_run(run_rows(spark, 2).limit(0), str(tmp_path / "b"), "txt", "both", "pos", at, export.Options(), zip_items=True, status="cancelled").collect()
    assert {w["name"] for w in empty} == {"data.json"} and json.loads((tmp_path / "b" / "data.json").read_text())["status"] == "cancelled"
    # Markdown with local images isn't put into an archive; what is made in memory comes in parts.
    kept = sinks.write_run(run_rows(spark, 2), str(tmp_path / "c"), "md", "files", "pos", at, export.Options(download_images=True), zip_items=True).collect()
    assert {w["name"] for w in kept} == {"ana-0.md", "ana-1.md", "data.json"}
    parts = export.combined_files(run_rows(spark, 5).withColumn("run", F.lit(None).cast("string")), "run", "pos", "txt", export.Options(), most=2)
    assert values(parts, "part", "n_items") == [(0, 2), (1, 2), (2, 1)]


def test_files_that_can_not_be_written_are_reported(spark, tmp_path):
    (tmp_path / "taken").write_text("a file where a folder is wanted")
    rows = spark.createDataFrame([("ok.md", "x"), ("taken/in.md", "y"), ("../../up.md", "z"), (None, None)], "name string, content string")
    out = {r.name: r for r in sinks.write_files(rows, str(tmp_path)).collect()}
    assert out["ok.md"].n_bytes == 1 and out["taken/in.md"].n_bytes is None and out["taken/in.md"].error
    assert (tmp_path / "up.md").read_text() == "z" and (tmp_path / "document.md").read_text() == ""


def test_reposts_are_told_in_the_jvm(spark):
    raws = ['{"legacy":{"retweeted_status_result":{}}}', '{"legacy":{}}', '{"tweet":{"legacy":{"retweeted_status_result":{"a":1}}}}', '{"tweet":{"legacy":{}},"legacy":{"retweeted_status_result":{}}}', '{"tweet":{},"legacy":{"retweeted_status_result":{}}}', "no json", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r[1] for r in frame.select("i", columns.is_repost("raw")).orderBy("i").collect()]
    assert got == [posts.is_repost(json.loads(r)) if r and r.startswith("{") else False for r in raws]


def test_details_retry_stop_and_are_kept(spark, tmp_path):
    asked = []

    def answer(identity):
        asked.append(identity)
        if identity == "late" and len(asked) < 3:
            raise details.Refused(503)
        if identity in ("gone", "limit", "down"):
            raise details.Refused({"gone": 404, "limit": 429}.get(identity))
        return "{}"

    assert details.patiently(answer, "late", wait=0) == "{}" and asked == ["late"] * 3
    for identity, tries in (("gone", 1), ("limit", 3), ("down", 3)):
        asked.clear()
        with pytest.raises(details.Refused):
            details.patiently(answer, identity, wait=0)
        assert len(asked) == tries
    ids = spark.createDataFrame([("gone",), ("limit",), ("ok",), ("ok",), (None,), ("z",)], "id string")
    found = {r.id: (r.raw, r.status, r.error) for r in details.fetched(ids, "id", answer, in_flight=1, wait=0).collect()}
    assert len(found) == 5 and found[None] == (None, "gone", None) and found["limit"] == (None, "rate_limit", "status 429")
    assert found["gone"] in ((None, "gone", "status 404"), (None, "pending", None)) and {found["ok"], found["z"]} <= {("{}", "done", None), (None, "pending", None)}
    assert details.fetched(ids.limit(0), "id", answer).count() == 0

    raw = spark.createDataFrame([("7", '{"a":"ä"}'), ("8", None), (None, "{}")], "id string, raw string")
    assert values(sinks.write_details(raw, str(tmp_path), "id"), "name", "n_bytes", "error") == [("debug/detail-7.json", 10, None)]
    stored = details.landed(f"{tmp_path}/debug")
    again = details.fetched(raw, "id", lambda identity: stored(f"detail-{identity}"), wait=0)
    assert {(r.id, r.raw, r.status) for r in again.collect()} == {("7", '{"a":"ä"}', "done"), ("8", None, "gone"), (None, None, "gone")}


def test_pages_that_fail_give_results(spark):
    post = '<article role="article"><div data-testid="User-Name"><a>A</a><a>@a</a></div><div data-testid="tweetText">Hi</div></article>'
    rows = spark.createDataFrame([(1, f"{URL}1", post), (2, "https://x.com/login", ""), (3, f"{URL}3", "<p>Rate limit</p>"), (4, f"{URL}4", None), (5, None, None)], "page_id long, url string, html string")
    found = {r.page_id: (r.document is not None, r.error, r.wall) for r in columns.results_of_pages(rows).collect()}
    assert found == {1: (True, None, False), 2: (False, "signed out", True), 3: (False, "rate limit", True), 4: (False, "no post found", False), 5: (False, "no post found", False)}
    assert columns.results_of_pages(rows.limit(0)).count() == 0


def test_unused_keys_visits_and_marks(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    keys = one([("a",), ("ab",), ("b",), ("c",), ("title",), (None,)], "key string")
    sources = one([("""t("a")"b" 'x'ab'""",), ("__MSG_c__ 'title'",), (None,), ("",)], "content string")
    assert values(checks.unreferenced(keys, sources, "key", "content", ["title"]), "key") == [("title",)]
    assert values(checks.unreferenced(keys, sources, "key", "content"), "key") == []
    assert values(checks.unreferenced(keys, sources.limit(0), "key", "content"), "key") == [("a",), ("ab",), ("b",), ("c",), ("title",)]
    seen = [(1, "/ana", "ana", 1), (2, "/ana", "bob", 2), (3, "/Ana/", "ana", 1), (4, "/settings", "ana", 9), (5, "/ana", "ana", 1), (6, "/ana", None, 0), (7, None, "ana", 1), (8, "/home", "bob", 2)]
    rows = one([("v", at, path, None if who is None else f"https://x.com/{who}/status/{n}?s=1") for at, path, who, n in seen], "viewer string, at int, path string, link string")
    kept = lambda reposts: values(routing.harvested(rows, "viewer", "at", "path", "link", reposts), "visit", "source_key", "url", "first_at")
    own = [(1, "profile:ana", "https://x.com/ana/status/1", 1), (3, "profile:ana", "https://x.com/ana/status/1", 5), (5, "timeline", "https://x.com/bob/status/2", 8)]
    assert kept(False) == own and kept(True) == sorted([*own, (1, "profile:ana", "https://x.com/bob/status/2", 2)])
    marks = one([("https://x.com/a#export=1",), ("https://x.com/a",), (None,)], "url string")
    assert [r[0] for r in marks.select(checks.job_of(F.col("url"))).collect()] == [("1", False), None, None]
    assert [r[0] for r in marks.select(checks.without_job(F.col("url"))).collect()] == ["https://x.com/a", "https://x.com/a", None]


def test_cursor_of_requests(spark):
    urls_ = ["https://x.com/g", "https://x.com/g?a=%zz&variables=%7B%22cursor%22%3A%22o%22%2C%22n%22%3A1.5%7D&a=2#f", "https://x.com/g?variables=no", None]
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(urls_)], "n int, url string")
    held = routing.variables(F.col("url"))
    found = [(r.v, r.u) for r in rows.select("n", held.alias("v"), routing.with_variables(F.col("url"), routing.cursor_in(held, F.lit('q"'))).alias("u")).orderBy("n").collect()]
    assert found[0] == ("{}", "https://x.com/g?variables=%7B%22cursor%22%3A%22q%5C%22%22%7D")
    assert found[1] == ('{"cursor":"o","n":1.5}', "https://x.com/g?a=%25zz&variables=%7B%22cursor%22%3A%22q%5C%22%22%2C%22n%22%3A1.5%7D&a=2#f")
    assert found[2] == ("no", None) and found[3] == (None, None)
    assert routing.with_cursor(urls_[1].replace("%zz", "1"), 'q"') == "https://x.com/g?a=1&variables=%7B%22cursor%22%3A%22q%5C%22%22%2C%22n%22%3A1.5%7D&a=2#f"
