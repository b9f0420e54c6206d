"""Ranges laid over each other, as a sweep over their ends.

A group's ends are events with running counts, and its stretches of equal state are islands. Which range was painted last is found through aligned
blocks: a range of any length is at most two blocks of each size, and a place lies in one block of each size, so an equi-join takes the place of a comparison
of every range with every place. No step needs a group in one task: rows lie in ranges of (group, place), and only what stands at the edges of ranges is passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import gone, kept

_KEYS = ["_range", "_group"]


def _laid(rows: DataFrame) -> DataFrame:
    return kept(rows.repartitionByRange(F.col("_group"), F.col("_at")).withColumn("_range", F.spark_partition_id()))


def _own():
    return Window.partitionBy(*_KEYS).orderBy("_at")


def _across():
    return Window.partitionBy("_group").orderBy("_range")


def _counted(laid: DataFrame, names: list[str]) -> DataFrame:
    """laid with running sums of ``names`` over each group; what the ranges before come to is a row for each group that crosses ranges."""
    ahead = laid.groupBy(*_KEYS).agg(*[F.sum(n).alias(n) for n in names])
    before = ahead.select(*_KEYS, *[F.sum(n).over(_across().rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_before") for n in names]).where(F.col(f"{names[0]}_before").isNotNull())
    own = _own().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = laid.withColumns({n: F.sum(n).over(own) for n in names}).join(before, _KEYS, "left")
    return made.withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in names}).drop(*[f"{n}_before" for n in names])


def _neighbour(laid: DataFrame, value: str, out: str, following: bool) -> DataFrame:
    """laid with ``value`` of the row before or after in its group; values aren't null."""
    at_edge, beside = (F.min_by, F.lead) if following else (F.max_by, F.lag)
    edges = laid.groupBy(*_KEYS).agg(at_edge(value, "_at").alias("_edge")).select(*_KEYS, beside("_edge").over(_across()).alias("_edge")).where("_edge IS NOT NULL")
    made = laid.withColumn(out, beside(value).over(_own())).join(edges, _KEYS, "left")
    return made.withColumn(out, F.coalesce(out, "_edge")).drop("_edge")


def _size(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def _largest(low: Column, high: Column) -> Column:
    """No block of low to high is larger than two to this; one more than need be, since logarithms are rounded."""
    return (F.floor(F.log2((high - low).cast("double"))) + 1).cast("int")


def _blocks(low: Column, high: Column) -> Column:
    """(size, block) of the aligned blocks that make up low to high: at each size what is left over on either side."""

    def at(k: Column) -> Column:
        left, right = F.ceil(low / _size(k)).cast("bigint"), F.floor(high / _size(k)).cast("bigint")
        block = lambda b: F.struct(k.alias("size"), b.alias("block"))
        some = lambda odd, b: F.when((left < right) & (F.pmod(odd, F.lit(2)) == 1), F.array(block(b))).otherwise(F.filter(F.array(block(b)), lambda _: F.lit(False)))
        return F.concat(some(left, left), some(right, right - 1))

    return F.flatten(F.transform(F.sequence(F.lit(0), _largest(low, high)), at))


def _last_painted(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """_group, _at, _top: of the ranges (_low, _high, _order, _value) over each place the value of the greatest order, the greater of equals."""
    painted = ranges.where("_value IS NOT NULL")
    block = F.explode(_blocks(F.col("_low"), F.col("_high"))).alias("b")
    # Of each block one row is left, so joins meet places alone, and a hot block is split like any skewed key.
    nodes = painted.select("_group", F.struct("_order", "_value").alias("_paint"), block).groupBy("_group", "b.size", "b.block").agg(F.max("_paint").alias("_paint"))
    largest = painted.agg(F.max(_largest(F.col("_low"), F.col("_high")))).first()[0]
    if largest is None:
        return points.select("_group", "_at", F.lit(None).cast(ranges.schema["_value"].dataType).alias("_top")).limit(0)
    sizes = F.sequence(F.lit(0), F.lit(largest))
    places = points.select("_group", "_at", F.explode(F.transform(sizes, lambda k: F.struct(k.alias("size"), F.floor(F.col("_at") / _size(k)).cast("bigint").alias("block")))).alias("b")).select("_group", "_at", "b.*")
    return places.join(nodes, ["_group", "size", "block"]).groupBy("_group", "_at").agg(F.max("_paint").alias("_p")).select("_group", "_at", F.col("_p._value").alias("_top"))


def overlaid(ranges: DataFrame, group: str, low: str, high: str, flags: dict[str, Column], value: Column, order: str, out: str = "value") -> DataFrame:
    """group, low, high, a boolean for each flag, and ``out``: the stretches of equal state that some range covers, as long as they go.

    A flag is set where any range covers a place for which it is true; ``out`` is the value of the range painted last (greatest ``order``, of equals the
    greater value) among those that have one. Ranges are half open and of whole numbers below 2^52. Ranges that are empty, or without a group or an end, paint
    nothing; a flag that is null isn't set; ranges that repeat or touch change nothing; an empty table gives an empty one.
    """
    names = list(flags)
    marks = {f"_f{n}": F.coalesce(c, F.lit(False)).cast("bigint") for n, c in enumerate(flags.values())}
    read = kept(ranges.select(F.col(group).alias("_group"), F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high"), F.col(order).alias("_order"), value.alias("_value"), *[c.alias(n) for n, c in marks.items()], F.lit(1).cast("bigint").alias("_any")).where("_group IS NOT NULL AND _low < _high"))
    counts = [*marks, "_any"]
    ends = read.select("_group", *counts, F.explode(F.array(F.struct(F.col("_low").alias("_at"), F.lit(1).alias("_sign")), F.struct(F.col("_high").alias("_at"), F.lit(-1).alias("_sign")))).alias("_e"))
    # Ends at one place are one row before anything is ordered.
    points = _laid(ends.groupBy("_group", F.col("_e._at").alias("_at")).agg(*[F.sum(F.col(n) * F.col("_e._sign")).alias(n) for n in counts]))
    top = _last_painted(read, points)
    states = _counted(points, counts).join(top, ["_group", "_at"], "left")
    state = F.struct(*[(F.col(n) > 0).alias(n) for n in counts], F.col("_top"))
    held = kept(states.select(*_KEYS, "_at", state.alias("_state")))
    changes = _laid(_neighbour(held, "_state", "_was", False).where("_was IS NULL OR NOT (_was <=> _state)").select("_group", "_at", "_state"))
    islands = _neighbour(changes, "_at", "_end", True).where("_state._any")
    shown = [F.col(f"_state._f{n}").alias(name) for n, name in enumerate(names)]
    made = kept(islands.select(F.col("_group").alias(group), F.col("_at").alias(low), F.col("_end").alias(high), *shown, F.col("_state._top").alias(out)))
    for one in (read, points, held, changes):
        gone(one)
    return made


#: UTF-16 units of a tile of text. Ranges that are alike in a tile are one there, so a tile has at most half the square of this.
TILE = 256


def _held(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once; a binary column is copied whole wherever a function over an array names it, what a function is given is not."""
    return F.transform(F.array(value), made)[0]


def _cut(units: Column, at: Column) -> Column:
    """1 where a pair of UTF-16 units is cut in two at a place, else 0."""
    return F.substring(units, (2 * at + 1).cast("int"), F.lit(1)).between(F.lit(b"\xdc"), F.lit(b"\xdf")).cast("int")


def _said(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """key, _row, _all, _last: texts as UTF-16 units, and the last of the tiles of each."""
    said = blocks.where(F.col(key).isNotNull()).select(key, F.monotonically_increasing_id().alias("_row"), F.encode(F.coalesce(text, F.lit("")), "UTF-16BE").alias("_all"))
    return said.withColumn("_last", F.expr(f"(octet_length(_all) div 2 - 1) div {TILE}").cast("int")).where("octet_length(_all) > 0")


def _tiles(said: DataFrame, key: str) -> DataFrame:
    """key, _row, _tile, _ahead, _units: each text in tiles, which a pair of units that would be cut in two moves one place ahead."""

    def tile(text: Column, k: Column) -> Column:
        low, end = TILE * k - _cut(text, TILE * k), TILE * (k + 1) - _cut(text, TILE * (k + 1))
        return F.struct(k.cast("bigint").alias("_tile"), (TILE * k - low).alias("_ahead"), F.substring(text, 2 * low + 1, 2 * (end - low)).alias("_units"))

    # Rows that come of a text have a tile each, never the text itself.
    each = _held(F.col("_all"), lambda text: F.transform(F.sequence(F.lit(0), "_last"), lambda k: tile(text, k)))
    return said.select(key, "_row", each.alias("_t")).select(key, "_row", F.explode("_t").alias("_t")).select(key, "_row", "_t.*")


_PAINT = ["_bold", "_italic", "_url"]


def _painted(by: list[str], rows: DataFrame) -> DataFrame:
    """One row for all that are alike in ``by``: each flag that any has, and of the links the one of the greatest place, the greater of equals."""
    return rows.groupBy(*by).agg(F.max("_bold").alias("_bold"), F.max("_italic").alias("_italic"), F.max("_url").alias("_url"))


def _in_tiles(ranges: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """key, _tile, _over: what is laid over each tile; where it begins and ends is counted from the tile's start, -1 is before it and more than a tile behind it.

    A range is a row in the tiles of its ends; tiles between are met as aligned blocks, of which it has at most two of each size.
    """
    first, last = F.expr(f"_low div {TILE}"), F.expr(f"_high div {TILE}")
    on = ranges.withColumns({"_first": first, "_last": last})
    ends = on.select(key, *_PAINT, "_low", "_high", "_first", "_last", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_tile"))
    at = ends.select(key, "_tile", F.when(F.col("_tile") == F.col("_first"), F.col("_low") % TILE).otherwise(-1).cast("int").alias("_from"), F.when(F.col("_tile") == F.col("_last"), F.col("_high") % TILE).otherwise(2 * TILE).cast("int").alias("_to"), *_PAINT)
    between = on.where("_last - _first > 1").select(key, *_PAINT, F.explode(_blocks(F.col("_first") + 1, F.col("_last"))).alias("_b"))
    nodes = _painted([key, "_size", "_block"], between.select(key, F.col("_b.size").alias("_size"), F.col("_b.block").alias("_block"), *_PAINT))
    # A block that begins after the first tile is no larger than the place where it begins.
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("_tile").cast("double"))).cast("int")), lambda k: F.struct(k.alias("_size"), F.floor(F.col("_tile") / _size(k)).cast("bigint").alias("_block")))
    places = said.select(key, "_last").where("_last > 0").select(key, F.explode(F.sequence(F.lit(1), "_last")).alias("_tile")).withColumn("_tile", F.col("_tile").cast("bigint"))
    over = places.select(key, "_tile", F.explode(sizes).alias("_b")).select(key, "_tile", "_b.*").join(nodes, [key, "_size", "_block"])
    whole = over.select(key, "_tile", F.lit(-1).alias("_from"), F.lit(2 * TILE).alias("_to"), *_PAINT)
    alike = _painted([key, "_tile", "_from", "_to"], at.unionByName(whole).repartition(key, "_tile"))
    return alike.groupBy(key, "_tile").agg(F.collect_list(F.struct("_from", "_to", *_PAINT)).alias("_over"))


def _parts(met: DataFrame, key: str) -> DataFrame:
    """key, _row, _tile, _parts: each tile cut where its style changes, as (low, state, piece)."""

    def snapped(units: Column, n: Column, r: Column) -> Column:
        low, high = r["_from"] + F.col("_ahead"), r["_to"] + F.col("_ahead")
        low, high = F.when(r["_from"] < 0, 0).otherwise(low - _cut(units, low)), F.least(high + _cut(units, high), n)
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), *[r[c].alias(c) for c in _PAINT])

    def states(over: Column, n: Column) -> Column:
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(over, lambda r: r["low"]), F.transform(over, lambda r: r["high"]))))
        state = lambda some: F.struct(F.exists(some, lambda r: r["_bold"]).alias("bold"), F.exists(some, lambda r: r["_italic"]).alias("italic"), F.array_max(F.transform(some, lambda r: r["_url"]))["url"].alias("link"))
        return F.transform(F.filter(ends, lambda at: at < n), lambda at: F.struct(at.alias("low"), _held(F.filter(over, lambda r: (r["low"] <= at) & (at < r["high"])), state).alias("state")))

    def part(units: Column, n: Column, changes: Column, s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(changes, i + 1)["low"], n)
        return F.struct((TILE * F.col("_tile") - F.col("_ahead") + s["low"]).alias("low"), s["state"].alias("state"), F.decode(F.substring(units, 2 * s["low"] + 1, 2 * (end - s["low"])), "UTF-16BE").alias("piece"))

    def parts(units: Column, n: Column) -> Column:
        over = F.filter(F.transform(F.coalesce("_over", F.filter(F.array(_no_range()), lambda _: F.lit(False))), lambda r: snapped(units, n, r)), lambda r: r["low"] < r["high"])
        changes = lambda found: F.filter(found, lambda s, i: (i == 0) | ~s["state"].eqNullSafe(F.get(found, i - 1)["state"]))
        return _held(_held(_held(over, lambda o: states(o, n)), changes), lambda found: F.transform(found, lambda s, i: part(units, n, found, s, i)))

    made = _held(F.col("_units"), lambda units: _held((F.octet_length(units) / 2).cast("int"), lambda n: parts(units, n)))
    return met.select(key, "_row", "_tile", made.alias("_parts"))


def _no_range() -> Column:
    paint = F.lit(None).cast("struct<place: bigint, url: string>")
    return F.struct(F.lit(0).alias("_from"), F.lit(0).alias("_to"), F.lit(False).alias("_bold"), F.lit(False).alias("_italic"), paint.alias("_url"))


def styled_pieces(blocks: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    """key, low, piece, bold, italic, link: each block's text cut into the longest pieces of one style, in the JVM.

    ``ranges`` are (key, offset, length, style, url, place): a style of any case sets bold or italic, and of the ranges with a url the one of the greatest place wins. Ranges count UTF-16 units, those that
    cut a character in two take it whole, and what lies outside the text is left out. A block without text, or null, has no pieces; a null offset or length counts as 0. Of blocks that share a key each is
    cut by all ranges of the key.

    Texts are met by their ranges tile by tile, so no row has both a whole text and one of its ranges. What goes on from tile to tile is one piece in the end.
    """
    offset, style, url = F.coalesce("offset", F.lit(0)).cast("bigint"), F.lower("style"), F.nullif("url", F.lit(""))
    paint = F.when(url.isNotNull(), F.struct(F.col("place").cast("bigint").alias("place"), url.alias("url")))
    flags = [F.coalesce(style == n, F.lit(False)).alias(f"_{n}") for n in ("bold", "italic")]
    on = ranges.where(F.col(key).isNotNull()).select(key, F.greatest(offset, F.lit(0)).alias("_low"), (offset + F.coalesce("length", F.lit(0))).alias("_high"), *flags, paint.alias("_url")).where("_low <= _high")
    said = _said(blocks, key, text)
    parts = _parts(_tiles(said, key).join(_in_tiles(on, said, key), [key, "_tile"], "left"), key).repartition(key)
    # The tiles of one text, which is a row itself.
    order = Window.partitionBy(key, "_row").orderBy("_tile")
    first, last = F.element_at("_parts", 1), F.element_at("_parts", -1)
    marked = parts.withColumn("_goes_on", F.coalesce(F.lag(last["state"]).over(order).eqNullSafe(first["state"]) & (F.col("_tile") > 0), F.lit(False)))
    begun = (~F.col("_goes_on") | (F.size("_parts") > 1)).cast("bigint")
    # A tile in which a piece begins, and those after it that have nothing but that piece; each brings what the next one has of it.
    traced = marked.withColumns({"_run": F.sum(begun).over(order), "_more": F.lead(F.when(F.col("_goes_on"), first["piece"])).over(order)})
    own = F.when(F.col("_goes_on"), F.slice("_parts", F.lit(2), F.size("_parts"))).otherwise(F.col("_parts"))
    runs = traced.groupBy(key, "_row", "_run").agg(F.array_sort(F.collect_list(F.struct("_tile", own.alias("own"), F.col("_more").alias("more")))).alias("_of"))
    runs = runs.select(key, F.col("_of")[0]["own"].alias("_own"), F.array_join(F.transform("_of", lambda t: t["more"]), "").alias("_more"))
    whole = runs.select(key, F.size("_own").alias("_n"), "_more", F.posexplode("_own").alias("_at", "_p"))
    piece = F.when(F.col("_at") == F.col("_n") - 1, F.concat("_p.piece", "_more")).otherwise(F.col("_p.piece"))
    return whole.select(key, "_p.low", piece.alias("piece"), "_p.state.bold", "_p.state.italic", "_p.state.link")
