"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions read it, for use inside a character class.
SPACE = r"\s\u000b   -     　﻿"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"\[([^\]]+)\]\([^)]+\)"


#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """No white space at the ends."""
    return F.btrim(c, F.lit(SPACES))


def trimmed_right(c: Column) -> Column:
    """No white space at the end."""
    return F.rtrim(c, F.lit(SPACES))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unescape_entities(c: Column) -> Column:
    """Five entities decoded, the ampersand last, so that nothing is decoded twice."""
    return replaced(c, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")])


def escape_html(c: Column) -> Column:
    return replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def whole_references(html: Column) -> Column:
    """HTML whose ampersands that begin no reference with its semicolon are written out, so that a parser takes them as they stand; browsers decode a few names without one."""
    return F.regexp_replace(html, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def escape_attribute(c: Column) -> Column:
    return replaced(c, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")])


def _replaced_at(c: Column, sign: str, pattern: str, new: str) -> Column:
    """A pattern replaced where a sign that it needs stands in the text; a search for that costs far less than the pattern."""
    return bound(c, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, new)).otherwise(x))


def plain_text(c: Column) -> Column:
    """Markdown as plain text without white space at its ends; links keep their targets."""
    # What is taken out, in this order.
    steps = [
        (r"!\[\]\(([^)]+)\)", "$1"), (r"!\[([^\]]+)\]\(([^)]+)\)", "$1: $2"), (r"\[([^\]]+)\]\(\1\)", "$1"), (r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"),
        (rf"(?m)^#{{1,6}}[{SPACE}]+", ""), (rf"(?m)^>[{SPACE}]?", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"(^|[^*])\*([^*]+)\*", "$1$2"), (r"`([^`]+)`", "$1"), (r"\n{3,}", "\n\n"),
    ]
    signs = ["![](", "![", "](", "](", "#", ">", "**", "*", "`", "\n\n\n"]
    for (pattern, new), sign in zip(steps, signs, strict=True):
        c = _replaced_at(c, sign, pattern, new)
    return trimmed(c)


def markdown_to_plain(c: Column) -> Column:
    """``plain_text`` with one newline at the end."""
    return F.concat(plain_text(c), F.lit("\n"))


def yaml_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), replaced(c, [("\\", "\\\\"), ('"', '\\"')]), F.lit('"'))


def _ties_down(unit: int) -> list[int]:
    """Numbers halfway between two tenths of a unit whose quotient as a double lies below the half."""
    half = unit // 20
    return [n for n in range(unit + half, 10 * unit, unit // 10) if Decimal(n / unit) < Decimal(n) / unit]


def count_label(c: Column) -> Column:
    """1234 as 1.2K, 56789 as 57K, 1500000 as 1.5M.

    Tenths are rounded from the quotient as a double, half up, so a few halves go down; which ones is
    worked out here, and the rest is integer arithmetic.
    """
    n = c.cast("bigint")

    def scaled(unit: int, suffix: str) -> Column:
        tenths = F.floor((n * 10 + unit // 2) / unit) - F.when(n.isin(_ties_down(unit)), 1).otherwise(0)
        short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.concat(F.when(n < 10 * unit, short).otherwise(F.floor((n + unit // 2) / unit).cast("string")), F.lit(suffix))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, scaled(1000, "K")).otherwise(scaled(1_000_000, "M"))


#: The counts of a post in the order of the stats line, and their signs.
STATS = [("replies", "💬"), ("reposts", "🔁"), ("likes", "❤️"), ("bookmarks", "🔖"), ("views", "👁")]


def stats_line(counts: dict[str, Column]) -> Column:
    """Signs and labels of the counts that are there, between dots; empty without any."""
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{sign} "), count_label(counts[key])) for key, sign in STATS if key in counts])


def file_part(c: Column) -> Column:
    return squeezed(F.regexp_replace(c, r'[/\\:*?"<>|]', ""))


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def tag(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), rf"[{SPACE}]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[#,/\\]", ""), "-+", "-"), "^-+|-+$", "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def without_front(markdown: Column) -> Column:
    """Markdown without what stands between the first line that begins with three dashes and the next three dashes, and without the first heading line.

    In a thread that takes out the second post; descriptions and slugs depend on it.
    """
    # Patterns from the start, not places that they are found at: these count UTF-16 units, and substrings code points.
    twice = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("---"), F.lit(""))) >= 6
    rest = bound(markdown, lambda x: F.when(twice(x), F.regexp_replace(x, rf"(?s)\A(.*?)(?m:^)---.*?---[{SPACE}]*", "$1")).otherwise(x))
    return _replaced_at(rest, "# ", r"(?s)\A(.*?)(?m:^)# [^\n]*", "$1")


def description(markdown: Column, most: int = 200) -> Column:
    """A line of prose from the body: no quotes, rules, images or marks; cut at a word with an ellipsis."""
    is_prose = lambda x: (x != "") & ~x.startswith(">") & ~x.startswith("---") & ~x.startswith("![")
    # What is none untrimmed is none trimmed either, and trimming costs more than looking.
    prose = F.filter(F.transform(F.filter(F.split(without_front(markdown), "\n", -1), is_prose), trimmed), is_prose)
    # Lines are taken until what is joined is 80 characters longer than needed.
    taken = F.aggregate(prose, F.lit(""), lambda acc, x: F.when(F.length(acc) >= most + 80, acc).otherwise(F.concat_ws(" ", F.nullif(acc, F.lit("")), x)))
    text = _replaced_at(_replaced_at(taken, "![", IMAGE, ""), "](", LINK, "$1")
    shown = squeezed(F.regexp_replace(text, "[*_`]", ""))
    return bound(shown, lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most), rf"[{SPACE}]+[^{SPACE}]*$", ""), F.lit("…"))))


def _preview(body: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(body, IMAGE, ""), LINK, "$1")
    body = F.regexp_replace(body, rf"(?m)^[>{SPACE}-]+", "")
    return squeezed(F.regexp_replace(body, "[*_`]", ""))


def slug_preview(markdown: Column) -> Column:
    return _preview(without_front(markdown))


#: Characters of a body that are looked at for its slug before the rest.
_HEAD = 400


def preview_slug(markdown: Column, most: int = 60) -> Column:
    """``slug`` of ``slug_preview``, from the first characters of the body where these tell.

    They do if no bracket is among them, so that no image or link begins there, and the slug is full: all else is done to each character or run by itself, so what comes after only adds to it.
    """
    full = lambda body: slug(_preview(body), most)
    first = lambda body: F.when(~F.contains(F.substring(body, 1, _HEAD), F.lit("[")), full(F.substring(body, 1, _HEAD)))
    return bound(without_front(markdown), lambda body: bound(first(body), lambda found: F.when(F.length(found) >= most, found).otherwise(full(body))))


def without_source_footer(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?s)\n+---\n+> Source:.*\n> Date:.*$", "")


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted where a comma, quote or line end stands in the value."""
    quoted = functools.reduce(operator.or_, [F.contains(c, F.lit(sign)) for sign in '",\r\n'])
    return F.when(quoted, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def quoted_lines(c: Column) -> Column:
    """Every line after a quote mark, an empty last line as well."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n")


def table_cell(c: Column) -> Column:
    one_line = F.regexp_replace(c, rf"[{SPACE}]*\n[{SPACE}]*", " ")
    return trimmed(replaced(one_line, [("\\", "\\\\"), ("|", "\\|")]))


def emphasised(c: Column, mark: str) -> Column:
    """Marks around the text between its edge white space; none around text that shows nothing."""
    lead, trail = F.regexp_extract(c, rf"^[{SPACE}]*", 0), F.regexp_extract(c, rf"[{SPACE}]*$", 0)
    core = trimmed(c)
    return F.when(F.regexp_replace(core, r"[​-‍⁠﻿]", "") == "", c).otherwise(F.concat(lead, F.lit(mark), core, F.lit(mark), trail))


def without_matching_scheme(display: Column, url: Column) -> Column:
    """A link's text without its scheme where the text is the link's target."""
    bare = F.regexp_extract(display, "^https?://(.+)$", 1)
    return F.when((bare != "") & ((url == display) | (url == F.concat(F.lit("https://"), bare))), bare).otherwise(display)


def engagement_count(label: Column, metric: str) -> Column:
    """The number before a word in an English label such as ``12 replies, 3.4K likes``; null without one."""
    pattern = rf"(?i)([\d,]+(?:\.\d+)?)\s*([KMB])?\s+{metric}"
    number = F.regexp_replace(F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")), ",", "").try_cast("double")
    unit = F.upper(F.regexp_extract(label, pattern, 2))
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.5).cast("bigint")


def bare_handle(c: Column) -> Column:
    return F.regexp_replace(c, "^@", "")


def space_runs_collapsed(c: Column) -> Column:
    return F.regexp_replace(c, "[ \t]{2,}", " ")
