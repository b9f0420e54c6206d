"""What keeps the time and memory of queries that make trees in proportion to their rows: all cores, each tree once, small batches."""

import os

import pytest

from loomfold.operators import routing
from loomfold.plans import registry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Queries over a table that fills one split, however many rows a larger one has in it.
POSTS = ["article_blocks", "page_threads", "single_exports", "csv_notes", "item_files", "combined_csv", "html_fragments", "stored_entries", "combined_json", "note_files", "post_quotes", "post_entities", "post_media", "post_poll", "post_counts", "article_preview"]


def _plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", POSTS)
def test_posts_are_made_on_every_core(spark, name, monkeypatch):
    """Rows are dealt out before their posts are made, also where those are kept for several readers."""
    from loomfold.plans import format_queries

    plans = []

    def seen(rows):
        plans.append(_plan(rows))
        return rows

    monkeypatch.setattr(format_queries, "kept", seen, raising=False)
    plans.append(_plan(registry.queries()[name](spark, SF)))
    assert all("RoundRobinPartitioning(4)" in p for p in plans)


@pytest.mark.parametrize("name", ["article_blocks", "post_media", "csv_notes", "yaml_frontmatter", "note_frontmatter", "csv_rows", "combined_csv", "combined_json", "post_counts"])
def test_a_post_is_made_once(spark, name):
    """One result of Python comes from raw posts; a second one in the same step would be the same tree again."""
    assert "pythonUDF1" not in _plan(registry.queries()[name](spark, SF))


def test_images_are_listed_without_making_notes_again(spark):
    """The plan doesn't repeat what made the images, and rows without images stay out."""
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "k int, t string").selectExpr("k", "transform(regexp_extract_all(t, '[a-z]', 0), x -> named_struct('url', x, 'filename', upper(x))) AS images", "t")
    found = routing.image_manifest(rows, "k", "t")
    assert sorted(map(tuple, found.collect())) == [(1, "ab", "a", "A"), (1, "ab", "b", "B")]
    assert _plan(found).count("regexp_extract_all") == 1


def test_batches_of_queries_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    registry.queries()["yaml_frontmatter"](spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_trees_are_searched_in_document_order():
    from loomfold.content import dom

    root = dom.parse("<div><p>a<b>b</b></p><i><u></u></i></div><s></s>")
    assert [e.tag for e in root] == ["div", "p", "b", "i", "u", "s"]
    assert root.below() is root.below()


def test_an_encoder_serves_all_values(monkeypatch):
    import json

    from loomfold.content import columns

    monkeypatch.setattr(json, "JSONEncoder", None)
    assert columns.dumped({"a": ["é", None]}) == '{"a": ["é", null]}'


PLAIN = {"rest_id": "7", "core": {"user_results": {"result": {"core": {"name": "A", "screen_name": "a"}}}}, "legacy": {"full_text": "Hi", "favorite_count": 7, "created_at": "Sat Mar 02 07:08:09 +0000 2024"}}


def _calls(raw):
    """Calls of functions of the library that a post's tree and its Markdown take."""
    import sys

    from loomfold.content import markdown, posts

    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event == "call" and "loomfold" in frame.f_code.co_filename

    posts.post_document(raw)
    sys.setprofile(seen)
    try:
        markdown.body_of(posts.post_document(raw))
    finally:
        sys.setprofile(None)
    return n


@pytest.mark.parametrize(
    ("most", "more"),
    [
        (170, {"quoted_status_result": {"result": PLAIN | {"quoted_status_result": {"result": PLAIN}}}}),
        (76, {"legacy": PLAIN["legacy"] | {"entities": {"urls": [{"expanded_url": "https://e", "display_url": "e", "indices": [0, 1]}], "hashtags": [{"text": "t", "indices": [1, 2]}]}}}),
        (66, {"legacy": PLAIN["legacy"] | {"extended_entities": {"media": [{"type": "photo", "media_url_https": "https://pbs.twimg.com/media/P.png"}]}}}),
    ],
    ids=["quotes", "entities", "media"],
)
def test_a_post_takes_few_steps(most, more):
    """What a post costs is calls of small functions: 197, 82 and 73 of them before."""
    assert _calls(PLAIN | more) <= most


def test_csv_lines_are_compiled_and_fixed_tags_worked_out_once(spark):
    """A step with a lambda isn't compiled; a tag without a placeholder is a constant of the plan, one with an unknown placeholder nothing."""
    plan = _plan(registry.queries()["csv_notes"](spark, SF))
    line = next(step for step in plan.split("\n+- ") if "AS csv_line" in step)
    assert "lambda" not in line.partition("\n   +- ")[0]
    assert "lower(clippings)" not in plan and "[clippings]" not in plan and "nope" not in plan
    assert plan.count("lower(") == 2  # a type's and a handle's tag, once each


def test_lines_of_a_post_are_made_once_for_all_that_shows_them(monkeypatch):
    import json

    import pyarrow as pa

    from loomfold.content import columns, markdown, posts

    made, seen = markdown.thread_lines, []
    monkeypatch.setattr(markdown, "thread_lines", lambda p: seen.append(p) or made(p))
    found = columns._shown(("markdown", "body"), posts.post_document).func(pa.array([json.dumps(PLAIN), None])).to_pylist()
    assert found == [{"markdown": "# A (@a)\n\nHi\n\n---\n\n> Source: https://x.com/a/status/7\n> Date: 2024-03-02T07:08:09.000Z", "body": "Hi"}, {"markdown": None, "body": None}]
    assert len(seen) == 1


def test_usual_dates_are_read_without_patterns_of_time(monkeypatch):
    """Dates as the feed writes them are read by their places, all others as before."""
    import datetime as dt

    from loomfold.content import posts

    odd = ["sat mar 2 7:08:09 +0000 2024", "Sat Mar 02 07:08:09 +0530 2024", "Sat Feb 30 07:08:09 +0000 2024", "Sat Mar 02 07:08:61 +0000 2024", "Sat Mar 02 24:08:09 +0000 2024", "2024-01-02", "nope"]
    assert [posts.iso(d) for d in odd] == ["2024-03-02T07:08:09.000Z", "2024-03-02T01:38:09.000Z", *odd[2:5], "2024-01-02T00:00:00.000Z", "nope"]

    class Slow(dt.datetime):
        @classmethod
        def strptime(cls, *a):
            raise AssertionError("read by a pattern")

    monkeypatch.setattr(posts, "datetime", Slow)
    assert posts.iso("Sat Mar 02 07:08:09 +0000 2024") == "2024-03-02T07:08:09.000Z"


@pytest.mark.parametrize(("name", "parts"), [("combined_csv", {"metadata", "body"}), ("stored_entries", {"document"}), ("html_fragments", {"fragment"}), ("item_files", {"metadata", "markdown", "html", "json"})])
def test_queries_make_the_parts_that_they_show(spark, monkeypatch, name, parts):
    """A struct of Python isn't pruned: each part that is asked for is made, whether something reads it or not."""
    from loomfold.content import columns

    asked, made = [], columns.posts_shown

    def seen(raw, *wanted):
        asked.append(set(wanted))
        return made(raw, *wanted)

    monkeypatch.setattr(columns, "posts_shown", seen)
    registry.queries()[name](spark, SF)
    assert asked == [parts]


def test_files_of_all_formats_come_from_one_pass(spark):
    """The table is read once, each post is made once and nothing is kept for further readers."""
    plan = _plan(registry.queries()["item_files"](spark, SF))
    assert plan.count("FileScan") == 1 and "Union" not in plan and plan.count("ArrowEvalPython") == 1


def test_files_of_all_formats_are_those_of_each(spark):
    from pyspark.sql import functions as F

    from loomfold.content import columns
    from loomfold.operators import export

    raw = '{"rest_id":"%s","core":{"user_results":{"result":{"core":{"name":"N","screen_name":"h"}}}},"legacy":{"full_text":"**Hi** [a](https://b) é"}}'
    frame = spark.createDataFrame([(1, raw % 1), (2, raw % 2), (3, None), (4, "no json")], "k int, raw string")
    rows = export.post_processed(columns.wire_rows(frame.select("k", columns.post_documents("raw").alias("document"))), export.Options(download_images=True))
    shown = ["k", "ext", "name", "mime", "content", F.to_json("images").alias("images")]
    for formats in (("md", "txt", "json", "html"), ("json",), ("txt", "md")):
        found = sorted(map(tuple, export.every_item_file(rows, formats).select(*shown).collect()), key=str)
        assert found == sorted((tuple(r) for f in formats for r in export.item_files(rows, f).select(*shown).collect()), key=str)
