"""Post-processing and export of wire rows: front matter, file names, stats, images, CSV and combined files.

Rows have type, author (name, handle), title, markdown, source_url, date, tweet_id and counts
(replies, reposts, likes, bookmarks, views). Options are read on the driver, so that a field that is
turned off is never computed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..content import columns
from ..functions import dates, text, urls
from . import routing

#: Fields of the two kinds of front matter, and the order of CSV columns.
DEFAULT_FIELDS = ["author", "handle", "source", "date", "type", "likes", "reposts", "replies", "bookmarks", "views"]
NOTE_FIELDS = ["title", "source", "author", "author_name", "handle", "published", "created", "type", "description", "tags", "likes", "reposts", "replies", "bookmarks", "views"]
CSV_ORDER = ["date", "published", "created", "author", "author_name", "handle", "title", "type", "description", "tags", "likes", "reposts", "replies", "bookmarks", "views", "source"]
COUNTS = ["likes", "reposts", "replies", "bookmarks", "views"]
PLACEHOLDERS = ["date", "datetime", "handle", "author", "id", "slug", "type"]
DEFAULT_TAGS = "clippings, x, {type}"
FORMATS = {"md": "text/markdown", "html": "text/html", "json": "application/json", "txt": "text/plain", "csv": "text/csv"}


@dataclass(frozen=True)
class Options:
    include_metadata: bool = True
    download_images: bool = False
    inline_stats: bool = False
    for_notes: bool = False
    filename_template: str = ""
    tags_template: str = ""
    fields: dict[str, bool] = field(default_factory=dict)
    run_date: str = "1970-01-01"

    def active(self) -> list[str]:
        """Fields in order; one that isn't named is on."""
        return [f for f in (NOTE_FIELDS if self.for_notes else DEFAULT_FIELDS) if self.fields.get(f, True) is not False]

    @classmethod
    def merged(cls, saved: dict, defaults: dict | None = None) -> Options:
        """Saved settings over defaults, key by key; unknown keys are left out."""
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in {**(defaults or {}), **saved}.items() if k in known})


def effective_output(fmt: str, output: str, zipped: bool, images: bool) -> tuple[str, bool]:
    """CSV is always one combined file; an archive can't hold Markdown with local images."""
    return ("combined" if fmt == "csv" else output), zipped and not (fmt == "md" and images)


def coerced(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(F.lit(default))


def title_of() -> Column:
    noun = F.when(F.col("type") == "thread", "Thread").otherwise("Post")
    return F.when((F.col("type") == "article") & (F.coalesce("title", F.lit("")) != ""), F.col("title")).otherwise(F.concat(noun, F.lit(" by "), F.col("author.handle"), F.lit(" on X")))


def placeholders() -> dict[str, Column]:
    slug = F.when((F.col("type") == "article") & (F.coalesce("title", F.lit("")) != ""), text.slug(F.col("title"))).otherwise(text.preview_slug(F.col("markdown")))
    values = {
        "date": dates.date_only(F.col("date")), "datetime": dates.date_and_minute(F.col("date")), "handle": F.regexp_replace("author.handle", "^([^@]*)@", "$1"),
        "author": F.col("author.name"), "id": F.col("tweet_id"), "slug": slug, "type": F.col("type"),
    }
    return {k: F.coalesce(v, F.lit("")) for k, v in values.items()}


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(" + "|".join(PLACEHOLDERS) + r")\}", template)
    return F.concat(*[values[p] if n % 2 else F.lit(p) for n, p in enumerate(parts)])


def templated_name(template: str, most: int = 120) -> Column:
    """A file name by a template, parsed once on the driver; empty if nothing is left of it."""
    name = _filled(template, {k: text.file_part(v) for k, v in placeholders().items()})
    name = text.file_part(F.regexp_replace(name, r"(?i)\.md$", ""))
    return text.bound(text.trimmed(F.substring(name, 1, most)), lambda n: F.when(n == "", F.lit("")).otherwise(F.concat(n, F.lit(".md"))))


def filename(template: str = "") -> Column:
    values = placeholders()
    default = F.when((F.col("type") == "article") & (F.coalesce("title", F.lit("")) != ""), F.concat(values["handle"], F.lit("-"), text.slug(F.col("title")), F.lit(".md"))).otherwise(F.concat(values["handle"], F.lit("-"), values["id"], F.lit(".md")))
    return F.coalesce(F.nullif(templated_name(template.strip()), F.lit("")), default) if template.strip() else default


def tags(template: str = "") -> Column:
    """An array of tags; a piece with an unknown placeholder, or of which nothing is left, is dropped."""
    values = placeholders()
    known = lambda x: F.when(~F.contains(x, F.lit("{")) | ~x.rlike(r"\{[^}]+\}"), text.tag(x))
    pieces = [(p.strip(), _filled(p.strip(), values)) for p in (template.strip() or DEFAULT_TAGS).split(",") if p.strip()]
    # A piece without a placeholder isn't bound, so that Spark works it out once, not for each row.
    made = [text.bound(c, known) if any(f"{{{v}}}" in p for v in PLACEHOLDERS) else known(c) for p, c in pieces]
    return F.filter(F.array(*made), lambda t: t != "") if made else F.array().cast("array<string>")


def _line(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), value)


def front_matter(options: Options, body: Column) -> Column:
    """The lines between dashes; those without a value are left out."""
    plain = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    handle, name, on = F.col("author.handle"), F.col("author.name"), F.col("date")
    if options.for_notes:
        lines = {
            "title": _line("title", text.yaml_quoted(title_of())), "source": _line("source", plain(F.col("source_url"))), "author": F.concat(F.lit('author: "[['), handle, F.lit(']]"')),
            "author_name": _line("author_name", text.yaml_quoted(name)), "handle": _line("handle", plain(handle)), "published": _line("published", dates.date_only(on)), "created": F.lit(f"created: {options.run_date}"),
            "type": _line("type", F.col("type")), "description": text.bound(text.description(body), lambda a: F.when(a != "", _line("description", text.yaml_quoted(a)))), "tags": text.bound(tags(options.tags_template), lambda m: F.when(F.size(m) > 0, F.concat(F.lit("tags: ["), F.array_join(m, ", "), F.lit("]")))),
        }
    else:
        lines = {"author": _line("author", plain(name)), "handle": _line("handle", plain(handle)), "source": _line("source", plain(F.col("source_url"))), "date": _line("date", on), "type": _line("type", F.col("type"))}
    lines |= {k: _line(k, F.col(f"counts.{k}").cast("string")) for k in COUNTS}
    return F.concat_ws("\n", F.lit("---"), *[lines[k] for k in options.active()], F.lit("---"), F.lit(""))


def with_stats(markdown: Column, line: Column) -> Column:
    """Markdown with its stats line: in a thread before the first rule after the front matter, else before the footer or at the end."""
    at_end = F.concat(text.trimmed_right(markdown), F.lit("\n\n"), line, F.lit("\n"))
    head = F.regexp_extract(markdown, r"(?s)\A(---.*?\n.*?---)?", 0)
    rest = F.substring(markdown, F.length(head) + 1, F.lit(1 << 30))
    rule = F.locate("\n---\n", rest)
    in_thread = F.when(rule > 0, F.concat(head, F.substring(rest, F.lit(1), rule - 1), F.lit("\n\n"), line, F.substring(rest, rule, F.lit(1 << 30)))).otherwise(at_end)
    footer = r"\A((?s:.*?))\n+---\n+> Source:"
    in_post = F.when(markdown.rlike(r"\n+---\n+> Source:"), F.concat(F.regexp_extract(markdown, footer, 1), F.lit("\n\n"), line, F.lit("\n\n---\n> Source:"), F.regexp_replace(markdown, footer, ""))).otherwise(at_end)
    return F.when(line == "", markdown).when(F.col("type") == "thread", in_thread).otherwise(in_post)


IMAGE = r"!\[(.*?)\]\((https://[^)]+)\)"


def local_images(markdown: Column, name: Column) -> Column:
    """An array of struct(mark, local, url, filename): allowed images of Markdown and how they read in a local folder; previews of linked pages stay remote."""
    folder = F.regexp_replace(name, r"\.md$", "")

    def local(mark: Column) -> Column:
        alt, url = F.regexp_extract(mark, IMAGE, 1), F.regexp_extract(mark, IMAGE, 2)
        last, kind = F.regexp_extract(url, r"^https://[^/?#]+(?:/[^/?#]*)*/([^/?#]*)", 1), F.regexp_extract(url, "format=([a-zA-Z0-9]+)", 1)
        file = F.when(last == "", "image").otherwise(last)
        file = F.when(F.contains(file, F.lit(".")), file).when(kind != "", F.concat(file, F.lit("."), kind)).otherwise(F.concat(file, F.lit(".jpg")))
        path = F.concat(folder, F.lit("/"), F.regexp_replace(file, "[^a-zA-Z0-9_.-]", "_"))
        wanted = urls.allowed_image(url) & (alt != "Link card preview")
        return F.when(wanted, F.struct(mark.alias("mark"), F.concat(F.lit("!["), alt, F.lit("]("), path, F.lit(")")).alias("local"), url.alias("url"), path.alias("filename")))

    return F.array_compact(F.transform(F.array_distinct(F.regexp_extract_all(markdown, F.lit(IMAGE), 0)), local))


def post_processed(rows: DataFrame, options: Options) -> DataFrame:
    """rows with filename, markdown as exported, and images."""
    out = rows.withColumn("filename", filename(options.filename_template))
    if options.include_metadata:
        out = out.withColumn("_body", text.without_source_footer(F.col("markdown")))
        out = out.withColumn("_body", F.concat(front_matter(options, F.col("_body")), F.col("_body")))
    else:
        out = out.withColumn("_body", F.col("markdown"))
    if options.inline_stats:
        out = out.withColumn("_line", F.coalesce(text.stats_line({k: F.col(f"counts.{k}") for k in COUNTS}), F.lit("")))
        out = out.withColumn("_body", with_stats(F.col("_body"), F.col("_line"))).drop("_line")
    if options.download_images:
        out = out.withColumn("_local", local_images(F.col("_body"), F.col("filename")))
        out = out.withColumns({
            "_body": F.aggregate("_local", F.col("_body"), lambda acc, i: F.replace(acc, i["mark"], i["local"])),
            "images": F.array_distinct(F.transform("_local", lambda i: F.struct(i["url"].alias("url"), i["filename"].alias("filename")))),
        }).drop("_local")
    else:
        out = out.withColumn("images", F.array().cast("array<struct<url: string, filename: string>>"))
    return out.withColumn("markdown", F.col("_body")).drop("_body")


# CSV


def csv_columns(options: Options) -> list[str]:
    active = options.active() if options.include_metadata else ["date", "source"]
    return [c for c in CSV_ORDER if c in active] + [c for c in active if c not in CSV_ORDER] + ["text"]


def csv_value(key: str, options: Options, texts: tuple[str, ...] = ("body_markdown", "markdown")) -> Column:
    """A column's value; ``texts`` are the columns in which a row's text is looked for."""
    values = {
        "title": title_of, "source": lambda: F.col("source_url"), "author": lambda: F.col("author.handle" if options.for_notes else "author.name"), "author_name": lambda: F.col("author.name"),
        "handle": lambda: F.col("author.handle"), "date": lambda: F.col("date"), "published": lambda: dates.date_only(F.col("date")), "created": lambda: F.lit(options.run_date), "type": lambda: F.col("type"),
        "description": lambda: text.description(F.col("markdown")), "tags": lambda: F.array_join(tags(options.tags_template), " "), "text": lambda: text.plain_text(F.coalesce(*map(F.col, texts))),
    } | {k: (lambda k=k: F.col(f"counts.{k}").cast("string")) for k in COUNTS}
    return F.coalesce(values[key](), F.lit(""))


def csv_lines(rows: DataFrame, options: Options) -> DataFrame:
    """rows (with body_markdown, null where there is no tree) with ``csv_line``; the header is ``csv_header``. Each value is computed once.

    Where every row has its body, ``markdown`` may be missing, unless the line has descriptions.
    """
    texts = tuple(c for c in ("body_markdown", "markdown") if c in rows.columns)
    names = {c: f"_csv_{c}" for c in csv_columns(options)}
    valued = rows.withColumns({n: csv_value(c, options, texts) for c, n in names.items()})
    # A step of its own, without lambdas, is compiled; Spark keeps values that cost something and are used more than once apart.
    return valued.withColumn("csv_line", F.concat_ws(",", *[text.csv_field(F.col(n)) for n in names.values()])).drop(*names.values())


def csv_header(options: Options) -> str:
    return ",".join(csv_columns(options))


# Files


def combined(rows: DataFrame, group: str, order: str, content: Column, separator: str, ending: str = "\n") -> DataFrame:
    """One file's content a group, its rows in order; per run, never for a whole corpus at once."""
    joined = rows.select(group, order, content.alias("_content")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "_content"))).alias("_all"))
    return joined.select(group, F.size("_all").alias("n_items"), F.concat(F.array_join(F.transform("_all", lambda x: x["_content"]), separator), F.lit(ending)).alias("content"))


def digest(rows: DataFrame, group: str, order: str) -> DataFrame:
    return combined(rows, group, order, text.trimmed(F.col("markdown")), "\n\n---\n\n")


def item_name(name: Column, fmt: str) -> Column:
    return name if fmt == "md" else F.concat(F.regexp_replace(name, r"(?i)\.md$", ""), F.lit(f".{fmt}"))


#: Items of a run that go into one file; a longer run is written in parts.
MOST_IN_A_FILE = 3000


def in_parts(rows: DataFrame, group: str, order: str, most: int = MOST_IN_A_FILE) -> DataFrame:
    """rows with ``part``: 0 for a run's first ``most`` items, 1 for the next and so on, so that nothing gathers a run without bound."""
    return rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / most).cast("int"))


def _gathered(rows: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    each = rows.select(group, "part", F.struct(F.col(order).alias("at"), content.alias("content")).alias("one"))
    all_ = each.groupBy(group, "part").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return all_.select(group, "part", F.size("all").cast("bigint").alias("n_items"), F.transform("all", lambda x: x["content"]).alias("all"))


def combined_files(rows: DataFrame, group: str, order: str, fmt: str, options: Options, most: int = MOST_IN_A_FILE) -> DataFrame:
    """group, part, n_items, content, mime, ext: a run's items (wire rows with ``document`` and, for CSV, ``body_markdown``) in one file, in order.

    Markdown and text stand between rules, pages under one style sheet, JSON in an array, and CSV below one header.
    """
    rule = "\n\n---\n\n"
    each = {
        "md": lambda: text.trimmed(columns.markdown_of("document")), "txt": lambda: text.markdown_to_plain(columns.markdown_of("document")),
        "html": lambda: F.col("document"), "json": lambda: F.col("document"), "csv": lambda: F.col("csv_line"),
    }
    joined = {
        "md": lambda a: F.concat(F.array_join(a, rule), F.lit("\n")), "txt": lambda a: F.concat(F.array_join(a, rule), F.lit("\n")), "html": lambda a: columns.html_many_of(_array(a)), "json": lambda a: columns.json_many_of(_array(a)),
        "csv": lambda a: F.concat(F.lit(csv_header(options) + "\n"), F.array_join(a, "\n"), F.lit("\n")),
    }
    lines = csv_lines(rows, options) if fmt == "csv" else rows
    made = _gathered(in_parts(lines, group, order, most), group, order, each[fmt]())
    return made.select(group, "part", "n_items", joined[fmt](F.col("all")).alias("content"), F.lit(FORMATS[fmt]).alias("mime"), F.lit(fmt).alias("ext"))


def _array(documents: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(documents, ","), F.lit("]"))


def item_files(rows: DataFrame, fmt: str) -> DataFrame:
    """rows (post-processed, with ``document``) with name, content, mime and ext of each one's own file; only Markdown keeps its images. CSV has no such form."""
    content = {"md": lambda: F.col("markdown"), "txt": lambda: text.markdown_to_plain(columns.markdown_of("document")), "html": lambda: columns.html_of("document"), "json": lambda: columns.pretty_json_of("document")}[fmt]()
    images = F.col("images") if fmt == "md" else F.array().cast(rows.schema["images"].dataType)
    return rows.withColumns({"name": item_name(F.col("filename"), fmt), "content": content, "mime": F.lit(FORMATS[fmt]), "ext": F.lit(fmt), "images": images})


def every_item_file(rows: DataFrame, formats: tuple[str, ...] = ("md", "txt", "json", "html"), made: Column | None = None) -> DataFrame:
    """The rows of ``item_files`` in each of several formats, in one pass: a document is read once for all of them, and nothing is kept in between.

    ``made`` is a struct of the documents' markdown, html and json where these are at hand; else they come from ``document``.
    """
    if made is None:
        made = columns.shown(F.col("document"), "markdown", "html", "json")
    none = F.array().cast(rows.schema["images"].dataType)
    each = rows.withColumn("_made", made).withColumn("ext", F.explode(F.array(*map(F.lit, formats))))
    contents = {"md": F.col("markdown"), "txt": text.markdown_to_plain(F.col("_made.markdown")), "html": F.col("_made.html"), "json": F.col("_made.json")}

    def by_format(values: dict[str, Column]) -> Column:
        chosen = F
        for fmt in formats:
            chosen = chosen.when(F.col("ext") == fmt, values[fmt])
        return chosen

    return each.withColumns({
        "name": by_format({f: item_name(F.col("filename"), f) for f in formats}), "content": by_format(contents), "mime": by_format({f: F.lit(FORMATS[f]) for f in formats}), "images": F.when(F.col("ext") == "md", F.col("images")).otherwise(none),
    }).drop("_made")


def format_export(rows: DataFrame, fmt: str, options: Options) -> DataFrame:
    """rows (wire rows with ``document`` and, for CSV, ``body_markdown``) with content, mime and ext of each alone in a format; a CSV has its header."""
    content = {
        "md": lambda r: r.withColumn("content", F.col("markdown")), "txt": lambda r: r.withColumn("content", text.markdown_to_plain(F.col("markdown"))), "json": lambda r: r.withColumn("content", columns.pretty_json_of("document")),
        "html": lambda r: r.withColumn("content", (columns.html_with_counts_of if options.inline_stats else columns.html_of)(F.col("document"))),
        "csv": lambda r: csv_lines(r, options).withColumn("content", F.concat(F.lit(csv_header(options) + "\n"), F.col("csv_line"), F.lit("\n"))).drop("csv_line"),
    }
    return content[fmt](rows).withColumns({"mime": F.lit(FORMATS[fmt]), "ext": F.lit(fmt)})


def single_export(rows: DataFrame, action: str, options: Options, vault: str = "", folder: str = "") -> DataFrame:
    """rows with name, content, mime, mode, images and link: what one action makes of a page's document, options settled by the action.

    A copy keeps images where they are; a note takes the notes' fields whatever is set, keeps images too, and has the
    ``link`` that makes it; another format has no images of its own. An unknown action raises ValueError.
    """
    if action not in routing.ACTIONS:
        raise ValueError(f"no such action: {action}")
    named = routing.ACTIONS[action]
    if action == "pdf":
        named = ("html", "download")
    none = F.array().cast("array<struct<url: string, filename: string>>")
    if named is not None:
        fmt, mode = named
        made = format_export(rows.withColumn("_name", filename(options.filename_template)), fmt, options)
        return made.withColumns({"name": item_name(F.col("_name"), fmt), "mode": F.lit(mode), "images": none, "link": F.lit(None).cast("string")}).drop("_name", "ext")
    settled = replace(options, for_notes=action == "obsidian" or options.for_notes, download_images=action == "download" and options.download_images)
    made = post_processed(rows, settled)
    link = urls.note_link(F.col("markdown"), F.col("filename"), F.lit(vault.strip()), F.lit(folder.strip())) if action == "obsidian" else F.lit(None).cast("string")
    mode = {"copy": "copy", "obsidian": "link"}.get(action, "download")
    return made.withColumns({"name": F.col("filename"), "content": F.col("markdown"), "mime": F.lit(FORMATS["md"]), "mode": F.lit(mode), "link": link}).drop("filename")


def stored_entries(frame: DataFrame, fmt: str, options: Options) -> DataFrame:
    """frame (``document`` and, if it was named when it was stored, ``filename``) with name and content of each document's entry in an archive.

    Everything is made anew from the tree, with images left where they are: an archive holds none. The stored name stays.
    """
    held = [F.col("filename").alias("_held")] if "filename" in frame.columns else [F.lit(None).cast("string").alias("_held")]
    rows = columns.wire_rows(frame.select(*[c for c in frame.columns if c != "filename"], *held))
    made = post_processed(rows, replace(options, download_images=False))
    return item_files(made.withColumn("filename", F.coalesce("_held", "filename")).drop("_held"), fmt)


def combined_name(fmt: str, day: str, part: int = 0) -> str:
    """What a run's combined file is called, by its day (YYYY-MM-DD)."""
    return f"x-compilation-{day.replace('-', '')}{f'-{part + 1}' if part else ''}.{fmt}"


def archive_name(day: str, part: int = 0) -> str:
    return f"x-files-{day.replace('-', '')}{f'-{part + 1}' if part else ''}.zip"


def zipped(entries: list[tuple[str, str]], at: datetime) -> bytes:
    """An uncompressed archive of texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in entries:
            info = zipfile.ZipInfo(name, at.timetuple()[:6])
            info.flag_bits |= 0x800
            z.writestr(info, content.encode())
    return out.getvalue()


def zip_archives(rows: DataFrame, group: str, order: str, name: str, content: str, at: datetime) -> DataFrame:
    """group, n_items, archive: a zip of each run's files, its rows in order. Runs are bounded by the caps on items."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [[(f["name"], f["content"]) for f in sorted(fs, key=lambda f: f["at"])] for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in files], pa.int64()), pa.array([zipped(f, at) for f in files], pa.binary())], [group, "n_items", "archive"])

    gathered = rows.groupBy(group).agg(F.collect_list(F.struct(F.col(order).alias("at"), F.col(name).alias("name"), F.col(content).alias("content"))).alias("files"))
    return gathered.mapInArrow(run, f"`{group}` {kind}, n_items bigint, archive binary")


def data_url(archive: Column) -> Column:
    return F.concat(F.lit("data:application/zip;base64,"), F.regexp_replace(F.base64(archive), "[\r\n]", ""))


def manifest(job: DataFrame, items: DataFrame, key: str, order: str, generator: str = "loomfold") -> DataFrame:
    """key, manifest (JSON) of each job: what it was, what failed, and its items in order."""
    each = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "url", "filename"))).alias("items"))
    joined = job.join(each, key, "left")
    return joined.select(key, F.to_json(F.struct(F.lit(generator).alias("generator"), *[c for c in job.columns if c != key], F.coalesce("items", F.array()).alias("items"))).alias("manifest"))
