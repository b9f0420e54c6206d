"""Ranges over each other, against painting place by place, and styled text against the reader of articles."""

import random

from pyspark.sql import functions as F

from loomfold.content import inline
from loomfold.operators import overlays

SCHEMA = "g string, low bigint, high bigint, kind string, link string, nth int"


def painted(rows):
    """Every place of every group by itself, and then runs of equal states."""
    places = {}
    for g, low, high, kind, link, nth in rows:
        if g is None or low is None or high is None:
            continue
        for at in range(low, high):
            was = places.setdefault(g, {}).setdefault(at, [False, False, None])
            was[0] |= kind == "bold"
            was[1] |= kind == "italic"
            if link is not None and (was[2] is None or (nth, link) > was[2]):
                was[2] = (nth, link)
    out = set()
    for g, held in places.items():
        run = None
        for at in [*sorted(held), None]:
            state = None if at is None else (held[at][0], held[at][1], held[at][2] and held[at][2][1])
            if run and (at != run[1] or state != run[2]):
                out.add((g, run[0], run[1], *run[2]))
                run = None
            if at is not None:
                run = (run[0] if run else at, at + 1, state)
    return out


def laid_over(frame):
    flags = {"bold": F.col("kind") == "bold", "italic": F.col("kind") == "italic"}
    return overlays.overlaid(frame, "g", "low", "high", flags, F.col("link"), "nth", "link")


def test_states_are_those_of_every_place(spark):
    some = random.Random(3)
    rows = []
    for n in range(1200):
        low = some.choice([some.randrange(-40, 400), some.randrange(0, 30)])
        # One group has most of the rows, so that it lies in more than one range.
        rows.append((some.choice(["hot", "hot", "hot", "a", "b", None]), some.choice([low] * 9 + [None]), low + some.choice([0, -3, 1, 2, 7, 30, 200]), some.choice(["bold", "italic", "other", None]), some.choice([None, None, "x", "y", "z"]), some.choice([n, 5])))
    rows += rows[:100]
    got = [tuple(r) for r in laid_over(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == painted(rows)
    assert laid_over(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {tuple(r) for r in laid_over(spark.createDataFrame([("a", 0, 4, None, None, 1), ("a", 4, 9, None, None, 1)], SCHEMA)).collect()} == {("a", 0, 9, False, False, None)}


def test_places_far_apart_take_few_blocks(spark):
    """A range of 2^50 places and one of 2 are laid over each other; nothing is counted place by place."""
    far = 1 << 50
    rows = [("a", 0, far, "bold", "x", 1), ("a", far - 3, far - 1, "italic", "y", 2), ("a", -far, 5, None, "z", 3)]
    got = {tuple(r) for r in laid_over(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", -far, 0, False, False, "z"), ("a", 0, 5, True, False, "z"), ("a", 5, far - 3, True, False, "x"), ("a", far - 3, far - 1, True, True, "y"), ("a", far - 1, far, True, False, "x")}


def pieces(node, bold=False, italic=False, url=None):
    """(text, bold, italic, link) of what the reader of articles makes of a block."""
    if node["type"] == "text":
        yield node["value"], bold, italic, url
        return
    for c in node["children"]:
        yield from pieces(c, bold or node["type"] == "strong", italic or node["type"] == "emphasis", node.get("url", url))


def test_styled_text_is_what_the_reader_of_articles_makes(spark):
    some, texts, ranges, want = random.Random(8), [], [], {}
    for key in range(80):
        value = "".join(some.choice("abc\U0001f600é\U00010348") for _ in range(some.choice([0, 1, 3, 20, 60])))
        texts.append((key, value or some.choice(["", None])))
        units = len(value.encode("utf-16-be")) // 2
        styles = [(some.randrange(0, units + 4), some.randrange(0, 12), some.choice(["Bold", "ITALIC", "code", None])) for _ in range(some.randrange(7))]
        links = [(some.randrange(0, units + 4), some.randrange(0, 12), some.choice(["u1", "u2", ""])) for _ in range(some.randrange(5))]
        ranges += [(key, o, n, s, None, 0) for o, n, s in styles] + [(key, o, n, None, u, at) for at, (o, n, u) in enumerate(links)]
        block = {"text": value, "inlineStyleRanges": [{"offset": o, "length": n, "style": s} for o, n, s in styles], "entityRanges": [{"offset": o, "length": n, "key": at} for at, (o, n, _) in enumerate(links)]}
        nodes = inline.from_ranges(block, {str(at): {"type": "LINK", "data": {"url": u}} for at, (*_, u) in enumerate(links)})
        if nodes:
            want[key] = [p for n in nodes for p in pieces(n)]
    made = overlays.styled_pieces(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([*ranges, (None, 0, 3, "bold", None, 0), (0, None, None, "bold", None, 0)], "key int, offset int, length int, style string, url string, place int"), "key", "text")
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.key, r.low)):
        got.setdefault(r.key, []).append((r.piece, r.bold, r.italic, r.link))
    assert got == want
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Rows that all stages of the session have written to shuffles so far."""
    at = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, at.new_array(at.jvm.double, 0), at.jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_long_texts_are_styled_by_what_meets_each_part_of_them(spark):
    """Ranges of any length over texts of many parts, and pairs of units where parts meet; what is shuffled grows with ranges, parts and pieces."""
    some, texts, ranges, want = random.Random(9), [], [], {}
    for key, units in enumerate([255, 256, 257, 511, 512, 513, 1300, 1301, 5000, 40000]):
        value = "a" * (key % 2)
        while len(value.encode("utf-16-be")) // 2 < units:
            value += some.choice(["\U0001f600", "\U0001f600", "b", "é"])
        texts.append((key, value))
        spots = [*range(0, units, 256), *[some.randrange(units + 3) for _ in range(20)]]
        place = lambda: max(0, some.choice(spots) + some.choice([-1, 0, 1]))
        length = lambda: some.choice([*[0, 1, 2, 5, 9, 30] * 9, 256, 257, 700, 3000])
        styles = [(place(), length() if n % 9 else 1, some.choice(["Bold", "ITALIC", "code"])) for n in range(units // 60)]
        links = [(place(), length(), some.choice(["u1", "u2", ""])) for _ in range(units // 90)]
        ranges += [(key, o, n, s, None, 0) for o, n, s in styles] + [(key, o, n, None, u, at) for at, (o, n, u) in enumerate(links)]
        block = {"text": value, "inlineStyleRanges": [{"offset": o, "length": n, "style": s} for o, n, s in styles], "entityRanges": [{"offset": o, "length": n, "key": at} for at, (o, n, _) in enumerate(links)]}
        want[key] = [p for node in inline.from_ranges(block, {str(at): {"type": "LINK", "data": {"url": u}} for at, (*_, u) in enumerate(links)}) for p in pieces(node)]
    texts.append((99, "plain \U0001f600" * 400))
    want[99] = [(texts[-1][1], False, False, None)]
    before = shuffled(spark)
    made = overlays.styled_pieces(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(ranges, "key int, offset int, length int, style string, url string, place int"), "key", "text").collect()
    rows, got = shuffled(spark) - before, {}
    for r in sorted(made, key=lambda r: (r.key, r.low)):
        got.setdefault(r.key, []).append((r.piece, r.bold, r.italic, r.link))
    assert got == want
    assert all(r.low == sum(len(p.piece.encode("utf-16-be")) // 2 for p in made if p.key == r.key and p.low < r.low) for r in made)
    assert 0 < rows < 2.5 * (len(ranges) + sum(len(t.encode("utf-16-be")) for _, t in texts) // 512 + len(made))
