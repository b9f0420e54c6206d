"""Column functions on single values."""

import random
import time
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from loomfold.content.html import count
from loomfold.functions import dates, text, urls
from loomfold.operators import export


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", function(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


@pytest.mark.parametrize(("function", "cases"), [
    (text.unescape_entities, {"&amp;lt; &lt;b&gt; &quot;x&#39;": "&lt; <b> \"x'"}),
    (text.escape_html, {"<a href=\"x\">&'": "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"}),
    (text.escape_attribute, {"<a>\"'&": "&lt;a>&quot;'&amp;"}),
    (text.markdown_to_plain, {
        "# H\n\n> q\n**b** *i* `c`\n\n\n\n[t](u) [u](u) ![alt](i) ![](j)\n": "H\n\nq\nb i c\n\nt (u) u alt: i j\n", "": "\n", "a*b* **x*": "ab **x*\n",
    }),
    (text.yaml_quoted, {'a "b" \\': '"a \\"b\\" \\\\"', "": '""'}),
    (text.file_part, {' a/b:c*?"<>|  d\u00a0e ': "abc d e"}),
    (text.slug, {"--Héllo, World!  2": "h-llo-world-2", "": "", "x" * 70: "x" * 60}),
    (text.tag, {" My Tag,#/x--y ": "my-tagx-y", "###": ""}),
    (text.csv_field, {'a"b': '"a""b"', "a,b": '"a,b"', "a\nb": '"a\nb"', "plain": "plain"}),
    (text.quoted_lines, {"a\n\nb\n": "> a\n> \n> b\n> "}),
    (text.table_cell, {" a | b \\ \n c ": "a \\| b \\\\ c"}),
    (lambda c: text.emphasised(c, "**"), {" a ": " **a** ", "  ": "  ", "\u200d": "\u200d"}),
    (text.without_source_footer, {"body\n\n---\n\n> Source: u\n> Date: d": "body", "a\n\n---\n\nb": "a\n\n---\n\nb", "body\n\n---\n> Source: u\n> Date: d": "body"}),
    (text.description, {
        "# Name (@h)\n\nFirst *line*.\n> quote\n![i](u)\nSecond [link](u).\n\n---\n> Source: x": "First line. Second link.", "one\n---\ntwo\n---\nthree": "one three", "word " * 60: " ".join(["word"] * 40) + "…",
    }),
    (text.slug_preview, {"# T\n\n> - a **b** [c](d) ![e](f)": "a b c"}),
    (text.bare_handle, {"@a": "a", "a@": "a@"}),
    (lambda c: text.engagement_count(c, "like"), {"3 replies, 1.5K likes": 1500, "1,234 likes": 1234, "2M likes": 2_000_000, "no": None}),
])
def test_text(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_count_labels(spark):
    values = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 9949, 9950, 9999, 10_000, 12_499, 12_500, 999_499, 999_999, 1_000_000, 1_049_999, 1_150_000, 9_950_000, 10_500_000, *range(1050, 10_000, 100), *range(1_050_000, 10_000_000, 100_000)]

    def want(n):
        if n < 1000:
            return str(n)
        unit, suffix = (1000, "K") if n < 1_000_000 else (1_000_000, "M")
        return (str(Decimal(n / unit).quantize(Decimal("0.1"), ROUND_HALF_UP)) if n / unit < 10 else str(int(n / unit + 0.5))) + suffix

    assert apply(spark, text.count_label, values, "bigint") == [want(n) for n in values] == [count(n) for n in values]


@pytest.mark.parametrize(("function", "cases"), [
    (dates.legacy_to_iso, {"Sat Mar 02 07:08:09 +0000 2024": "2024-03-02T07:08:09.000Z", "Sat Mar 02 07:08:09 +0200 2024": "2024-03-02T05:08:09.000Z", "soon": "soon", None: ""}),
    (dates.date_only, {"2024-01-02T03:04:05.000Z": "2024-01-02", "soon": "soon"}),
    (dates.date_and_minute, {"2024-01-02T03:04:05.000Z": "2024-01-02_0304", "soon": "soon"}),
    (dates.display_date, {"2024-01-02T03:04:05.000Z": "Jan 2, 2024", "soon": ""}),
    (urls.allowed_image, {"https://pbs.twimg.com/a": True, "http://pbs.twimg.com/a": False, "https://pbs.twimg.com.evil.org/a": False, "not a url": False, None: False}),
    (lambda c: urls.host_matches(c, ["pbs.twimg.com"]), {"//pbs.twimg.com/x": True, "/x": False, "https://a/pbs.twimg.com": False, "": False}),
    (urls.media_url, {"https://pbs.twimg.com/media/Ab.JPG": "https://pbs.twimg.com/media/Ab?format=jpg&name=large", "https://pbs.twimg.com/media/Ab?x=1.jpg": "https://pbs.twimg.com/media/Ab?x=1.jpg"}),
    (urls.site_path, {"/a": "/a", "https://www.x.com/b?c": "/b?c", "https://e.org/": None}),
    (urls.status_id, {"https://x.com/a/status/12/photo/1": "12", "https://x.com/a": None}),
    (urls.permalink, {"https://x.com/a/status/12/photo/1?s=1": "https://x.com/a/status/12", "https://y.com/a/status/12": None}),
    (urls.percent_encoded, {"a b+c/é~!*()'": "a%20b%2Bc%2F%C3%A9~!*()'"}),
    (urls.vault_folder, {"\\a//./../ b /": "a/b", "": ""}),
    (urls.safe_paths, {"../a\\b//c d?.md": "a/b/c-d_.md", "": "document.md", "ｆｕｌｌ": "full", "x" * 300 + ".md": "x" * 80, "/".join(["y" * 79] * 3 + ["z.md"]): "/".join(["y" * 79] * 3)[:197] + ".md"}),
])
def test_dates_and_urls(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_page_sources(spark):
    cases = {
        "/home": ("timeline", None), "/i/history/likes/": ("likes", None), "/i/history": ("bookmarks", None), "/i/history/videos": None, "/i/bookmarks/7": ("bookmarks", None), "/ana": ("profile", "ana"), "/Explore": None,
        "/ana/likes": ("likes", "ana"), "/search/likes": None, "/ana/status/1": None, "/" + "a" * 16: None, "/": None,
    }
    assert [None if r is None else (r.source, r.handle) for r in apply(spark, urls.page_source, list(cases))] == list(cases.values())


def test_links(spark):
    rows = [("https://t.co/a", "https://e.org/x"), ("https://t.co/a", "e.org/x"), ("https://t.co/a", "read this"), ("//e.org", "x"), ("https://e.org", "y.org")]
    out = spark.createDataFrame(rows, "h string, t string").select(urls.external_url(F.col("h"), F.col("t")).alias("u")).collect()
    assert [r.u for r in out] == ["https://e.org/x", "https://e.org/x", "https://t.co/a", "https://e.org", "https://e.org"]
    note = spark.createDataFrame([("a b", "n.md", "v", "f/../g"), ("c", "n", "", "")], "c string, n string, v string, f string").select(urls.note_link(*map(F.col, "cnvf")).alias("u")).collect()
    assert [r.u for r in note] == ["obsidian://new?vault=v&file=f%2Fg%2Fn&content=a%20b", "obsidian://new?file=n&content=c"]


def test_date_range(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 23:59:59.999",), ("2024-01-03 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert rows.where(dates.in_date_range(F.col("t"), "2024-01-02", "2024-01-01")).count() == 2
    assert rows.where(dates.in_date_range(F.col("t"), None, None)).count() == 3


def test_trimming_long_runs_takes_linear_time(spark):
    began = time.perf_counter()
    value = "a" + " " * 300_000 + "b \n\t"
    assert spark.createDataFrame([(value,)], "t string").select(text.trimmed(F.col("t")).alias("t")).first().t == value.strip()
    assert time.perf_counter() - began < 20


def test_references_count_with_their_semicolon_only(spark):
    cases = {"a &amp b": "a &amp;amp b", "&amp;&quot;&#38;&#x26;&b;": "&amp;&quot;&#38;&#x26;&b;", "R&D &#; &copy</h1>": "R&amp;D &amp;#; &amp;copy</h1>", "": "", None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, want string")
    assert rows.where(~text.whole_references(F.col("html")).eqNullSafe(F.col("want"))).count() == 0


CUT = '<!DOCTYPE html><html lang="en"><head><title>A &amp</title></head><body><nav>n</nav><article><h1>A &amp;&amp</h1><p>B &amp;C &copy</article></body></html>'


def _on_a_cut_page(spark, tmp_path, name):
    """A query and its SQL on a page whose heading ends within a reference."""
    import duckdb

    from loomfold.plans import registry

    spark.createDataFrame([(7, CUT)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found, want = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
    order = sorted(found.columns)
    return sorted(tuple(r[c] for c in order) for r in found.collect()), sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_blocks_of_a_page_cut_within_a_reference(spark, tmp_path):
    found, want = _on_a_cut_page(spark, tmp_path, "page_block_inventory")
    assert found == want


def test_text_of_a_page_cut_within_a_reference(spark, tmp_path):
    found, want = _on_a_cut_page(spark, tmp_path, "page_cleaned")
    assert found == want


def test_document_of_a_page_cut_within_a_reference(spark, tmp_path):
    found, want = _on_a_cut_page(spark, tmp_path, "page_documents")
    assert found == want


def test_slugs_of_previews_are_those_of_whole_bodies(spark):
    some = random.Random(4)
    parts = ["word ", "Two words, ", "\n", "\n\n> ", "- ", "[a](b) ", "![i](u) ", "[open ", "![", "](", "*b* ", "Σ", "É", "😀", "   ", "\r\n", "--- ", "# h\n", "x" * 70, "...", " "]
    bodies = ["".join(some.choice(parts) for _ in range(some.choice([0, 3, 20, 80, 400]))) for _ in range(300)]
    bodies += [None, "a " * 200 + "![b](c)", "- " * 300 + "late words " * 20, "w" * 399 + "[x](y) z" * 20, "plain " * 100 + "[x", "a" * 60, "a" * 59 + " " * 500 + "b"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = frame.select("body", text.slug(text.slug_preview(F.col("body"))).alias("want"), text.preview_slug(F.col("body")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []


def test_front_and_heading_are_found_behind_characters_of_two_units(spark):
    """Places of a pattern count UTF-16 units, parts of a string code points; before, each such character moved the cut."""
    smile = "\U0001f600" * 5
    cases = {f"{smile} a\n---\nb\n--- c": f"{smile} a\nc", f"{smile}\n# Head\nrest": f"{smile}\n\nrest", f"{smile}\n---\n{smile}": f"{smile}\n---\n{smile}", "----- a": "----- a", "------ a": "a"}
    assert apply(spark, text.without_front, list(cases)) == list(cases.values())
    assert apply(spark, text.description, [f"{smile}\n# Head\nrest of it"]) == [f"{smile} rest of it"]


def test_stats_end_long_texts_in_linear_time(spark):
    said = "a" + " " * 100_000 + "b"
    rows = spark.createDataFrame([(said + " \n 　", "tweet"), ("\n", "tweet")], "markdown string, type string")
    began = time.perf_counter()
    made = [r[0] for r in rows.select(export.with_stats(F.col("markdown"), F.lit("line"))).collect()]
    assert made == [said + "\n\nline\n", "\n\nline\n"] and time.perf_counter() - began < 10
