"""Targets, actions, settings and cursors."""

import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from loomfold.operators import routing

POST = "https://x.com/a/status/1"


def test_columns(spark):
    rows = spark.createDataFrame([(POST + "/photo/2", None, None), ("https://e.org", POST + "?s=1", "x"), (None, None, POST), (None, "x", None)], "l string, c string, p string")
    assert [r.t for r in rows.select(routing.target_url(F.col("l"), F.col("c"), F.col("p")).alias("t")).collect()] == [POST, POST, POST, None]
    tokens = spark.createDataFrame([("copy",), ("copy-txt",), ("csv",), ("what",)], "t string").select(routing.action(F.col("t")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in tokens] == [("copy", None, "copy"), ("copy-txt", "txt", "copy"), ("csv", "csv", "download"), None]
    walls = spark.createDataFrame([("/login", False, ""), ("/a", True, ""), ("/a", False, "Rate Limit hit"), ("/a", False, "deleted")], "p string, s boolean, t string")
    assert [r.w for r in walls.select(routing.interstitial(F.col("p"), F.col("s"), F.col("t")).alias("w")).collect()] == ["signed out", "sign-in asked for", "rate limit", None]


def test_settings():
    defaults = {"fields": {"a": True, "b": True}, "vault": "", "open_sections": ["x", "y"]}
    made = routing.merged_settings({"fields": {"b": False}, "open_sections": ["z", "y", "y", 3, "x", "w"]}, defaults, ["x", "y", "w"], legacy={"vault": "old"})
    assert made == {"fields": {"a": True, "b": False}, "vault": "old", "open_sections": ["y", "x"]}
    assert routing.feed_template({"Old": "u1", "New": "u2"}, ["Newest", "New", "Old"]) == "u2"
    assert routing.feed_template({}, ["New"]) is None


def test_cursors(spark):
    url = routing.with_cursor('https://x.com/g?variables={"count":20}&features=f', "c+/=")
    query = parse_qs(urlsplit(url).query)
    assert json.loads(query["variables"][0]) == {"count": 20, "cursor": "c+/="}
    assert query["features"] == ["f"]
    assert json.loads(parse_qs(urlsplit(routing.with_cursor(url, "d")).query)["variables"][0])["cursor"] == "d"
    items = spark.createDataFrame([("s", 0, "a", True), ("s", 0, "a", True), ("s", 1, "b", True), ("s", 2, "c", False), ("s", 3, "d", True), ("t", 0, "a", False)], "source string, page int, cursor string, taken boolean")
    assert [tuple(r) for r in routing.resume_frontier(items, "source", "page", "cursor", F.col("taken")).collect()] == [("s", "b")]
    assert routing.pages_within(items, "page", 1).count() == 3
