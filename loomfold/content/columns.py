"""The content tree on DataFrames: documents travel as JSON strings, their metadata as columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..operators.routing import interstitial
from . import html, markdown, pages, posts
from .dom import parse

#: What is read from a document's JSON into columns.
METADATA = StructType([
    *[StructField(n, StringType()) for n in ("type", "sourceUrl", "tweetId", "date", "title")],
    StructField("author", StructType([*[StructField(n, StringType()) for n in ("name", "handle", "avatarUrl")], StructField("verified", BooleanType())])),
    StructField("engagement", StructType([StructField(n, LongType()) for n in ("replies", "reposts", "likes", "bookmarks", "views")])),
])


#: ``json.dumps`` with any option makes such an encoder anew for each value.
_PLAIN, _PRETTY = json.JSONEncoder(ensure_ascii=False), json.JSONEncoder(ensure_ascii=False, indent=2)


def dumped(value) -> str:
    return _PLAIN.encode(value)


#: Rows of a batch whose trees and texts a worker holds as Python objects at once.
MOST_AT_ONCE = 100


def _read(value: str | None):
    try:
        return json.loads(value) if value is not None else None
    except ValueError:
        return None


def _in_slices(values: pa.Array, kind: pa.DataType, make: Callable[[list], list]) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *(pa.array(make(values.slice(at, MOST_AT_ONCE).to_pylist()), kind) for at in range(0, len(values), MOST_AT_ONCE))])


def _json_function(make: Callable[[dict], str | None]):
    """An Arrow function from JSON strings to strings; null and what is no JSON give null."""
    one = lambda v: None if (read := _read(v)) is None else make(read)

    @arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        return _in_slices(values, pa.string(), lambda some: [one(v) for v in some])

    return run


def _or_none(doc: dict | None) -> str | None:
    return None if doc is None else dumped(doc)


post_documents = _json_function(lambda raw: dumped(posts.post_document(raw)))
conversation_documents = _json_function(lambda raw: _or_none(posts.conversation_document(raw)))
markdown_of = _json_function(markdown.document)
markdown_body_of = _json_function(markdown.body_of)


#: What a document is shown as.
SHOWN = {
    "document": dumped, "metadata": lambda doc: dumped(doc["metadata"]), "markdown": markdown.document, "body": markdown.body_of,
    "html": html.document, "fragment": html.fragment, "json": _PRETTY.encode,
}
#: Of these, what shows the lines of the content, which are made once for both.
FLOWING = {"markdown", "body"}


def _shown(parts: tuple[str, ...], tree: Callable[[dict], dict]):
    """An Arrow function from JSON strings to a struct of ``parts`` (of SHOWN) of the document that ``tree`` makes, which is made once; null and what is no JSON give nulls."""

    def some(values: list) -> pa.StructArray:
        docs = [None if (read := _read(v)) is None else tree(read) for v in values]
        flows = [None if d is None else markdown.flow(d) for d in docs] if FLOWING & set(parts) else []
        made = [[None if d is None else SHOWN[p](d, lines) for d, lines in zip(docs, flows, strict=True)] if p in FLOWING else [None if d is None else SHOWN[p](d) for d in docs] for p in parts]
        return pa.StructArray.from_arrays([pa.array(m, pa.string()) for m in made], list(parts))

    @arrow_udf(StructType([StructField(p, StringType()) for p in parts]))
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([some([]), *(some(values.slice(at, MOST_AT_ONCE).to_pylist()) for at in range(0, len(values), MOST_AT_ONCE))])

    return run


def shown(document: Column, *parts: str) -> Column:
    """A struct of parts of documents (markdown, body and so on) that are read once."""
    return _shown(parts, lambda doc: doc)(document)


def posts_shown(raw: Column, *parts: str) -> Column:
    """A struct of parts (document, metadata, markdown, body, html, fragment, json) of the documents of raw posts, each made once and never read back."""
    return _shown(parts, posts.post_document)(raw)


html_of = _json_function(html.document)
html_with_counts_of = _json_function(lambda d: html.document(d, True))
html_fragment_of = _json_function(html.fragment)
html_card_of = _json_function(lambda doc: html.card(doc))
html_many_of = _json_function(lambda docs: html.many(docs))
json_many_of = _json_function(_PRETTY.encode)
pretty_json_of = _json_function(_PRETTY.encode)


def is_repost(raw: Column | str) -> Column:
    """Whether raw JSON is a repost, behind a wrapper or not; in the JVM, so that a filter comes before any tree."""
    wrapped, bare = (F.get_json_object(raw, f"$.{at}legacy.retweeted_status_result") for at in ("tweet.", ""))
    behind = F.coalesce(F.get_json_object(raw, "$.tweet"), F.lit("")).rlike(r"^\{.*\S.*\}$")
    return F.when(behind, wrapped.isNotNull()).otherwise(bare.isNotNull())


@arrow_udf(StructType([StructField("posts", ArrayType(StringType())), StructField("cursor", StringType()), StructField("done", BooleanType())]))
def feed_pages(raw: pa.Array) -> pa.Array:
    """posts (JSON), cursor and done of each feed page; what is no JSON is an empty last page."""
    out = []
    for v in raw.to_pylist():
        try:
            page = posts.feed_page(json.loads(v or "null"))
        except ValueError:
            page = {"posts": [], "cursor": None, "done": True}
        out.append(page | {"posts": [dumped(p) for p in page["posts"]]})
    return pa.array(out, pa.struct([("posts", pa.list_(pa.string())), ("cursor", pa.string()), ("done", pa.bool_())]))


@arrow_udf(StructType([StructField("key", StringType()), StructField("handle", StringType()), StructField("promoted", BooleanType()), StructField("media", LongType()), StructField("chars", LongType())]))
def snapshot_facts(html: pa.Array) -> pa.Array:
    """``pages.snapshot_facts`` of each snapshot; null counts as empty."""
    found = [pages.snapshot_facts(h or "") for h in html.to_pylist()]
    kinds = [("key", pa.string()), ("handle", pa.string()), ("promoted", pa.bool_()), ("media", pa.int64()), ("chars", pa.int64())]
    return pa.StructArray.from_arrays([pa.array([f[n] for f in found], k) for n, k in kinds], [n for n, _ in kinds])


def documents_of_pages(frame: DataFrame, now: str = "", single: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, document (JSON) of each page at a post's address; null where there is no post. Filter pages before, not after."""
    rows = frame.select(frame[id_col], frame[url_col].alias("_url"), frame[html_col].alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_or_none(pages.page_document(h or "", u or "", now, single)) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_col, "document"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, document string")


def results_of_pages(frame: DataFrame, now: str = "", single: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, document, error, wall: what reading each page came to, one row a page and no failed task.

    A page without a post has as its error the wall that stands before it (``wall`` is true, and the session, not the
    post, is to blame) or that nothing was found; a page that can't be read has the reader's own words.
    """
    path = F.regexp_extract(url_col, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    asks = F.col(html_col).rlike(r'(?i)data-testid="?loginButton')
    rows = frame.select(frame[id_col], frame[url_col].alias("_url"), frame[html_col].alias("_html"), interstitial(path, asks, shown).alias("_wall"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page, wall in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True):
                try:
                    made = _or_none(pages.page_document(page or "", url or "", now, single))
                    out.append((made, None if made else wall or "no post found", bool(made is None and wall)))
                except Exception as e:  # noqa: BLE001  whatever a page does to the reader is that page's result
                    out.append((None, f"{type(e).__name__}: {e}", False))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_())))], [id_col, "document", "error", "wall"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, document string, error string, wall boolean")


@arrow_udf(StringType())
def cleaned_text_of(pages_html: pa.Array) -> pa.Array:
    """The text of pages without controls, navigation, prompts and hidden elements, in one line; null for null."""
    return pa.array([None if h is None else pages.squeezed(pages.cleaned(parse(h)).text()) for h in pages_html.to_pylist()], pa.string())


def blocks_of_pages(frame: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, pos, kind, tag, text: a row for each block of running text of any page."""
    rows = frame.select(frame[id_col], frame[html_col].alias("_html"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pages.page_blocks(h or "") for h in batch.column(1).to_pylist()], kind)], [id_col, "blocks"])

    read = rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, blocks array<struct<kind: string, tag: string, text: string, pos: int>>")
    return read.select(id_col, F.explode("blocks").alias("b")).select(id_col, "b.pos", "b.kind", "b.tag", "b.text")


def _wired(read: DataFrame, handle_prefix: str, texts: dict[str, Column]) -> DataFrame:
    author = F.struct(F.col("_meta.author.name").alias("name"), F.concat(F.lit(handle_prefix), F.col("_meta.author.handle")).alias("handle"))
    return read.withColumns({
        "type": F.col("_meta.type"), "author": author, "title": F.col("_meta.title"), **texts, "source_url": F.col("_meta.sourceUrl"),
        "date": F.col("_meta.date"), "tweet_id": F.col("_meta.tweetId"), "counts": F.col("_meta.engagement"),
    }).drop("_meta", "_shown")


def wire_rows(frame: DataFrame, document: str = "document", handle_prefix: str = "", body: bool = False) -> DataFrame:
    """frame with the columns that post-processing takes: type, author, title, markdown, source_url, date, tweet_id, counts; with ``body`` also body_markdown.

    Handles stand bare; rows that come from a page's own export carry ``@`` as ``handle_prefix``.
    """
    read = frame.withColumn("_meta", F.from_json(F.get_json_object(document, "$.metadata"), METADATA))
    if not body:
        return _wired(read, handle_prefix, {"markdown": markdown_of(F.col(document))})
    return _wired(read.withColumn("_shown", shown(F.col(document), "markdown", "body")), handle_prefix, {"markdown": F.col("_shown.markdown"), "body_markdown": F.col("_shown.body")})


def post_rows(frame: DataFrame, raw: Column, body: bool = False, document: bool = False, markdown: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """frame with the columns of ``wire_rows`` of raw posts, each read and made into a tree once; with ``document`` also that, and with ``more`` further parts under their own names.

    Each part takes time; where only the body is used, as in a CSV without descriptions, ``markdown`` may be left out.
    """
    parts = ["metadata", *(["markdown"] if markdown else []), *(["body"] if body else []), *(["document"] if document else []), *more]
    names = {p: p for p in more} | {"markdown": "markdown", "body": "body_markdown", "document": "document"}
    read = frame.withColumn("_shown", posts_shown(raw, *parts)).withColumn("_meta", F.from_json("_shown.metadata", METADATA))
    return _wired(read, "", {names[p]: F.col(f"_shown.{p}") for p in parts[1:]})
