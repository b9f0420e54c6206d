"""The file names of runs of any length: the first free of name, name-2, name-3, case aside, as one walk over a run would give them.

Nothing walks a run. A name is asked for a number of times, and all but the first time gives a numbered one. Only a name that is asked for as such and is also what
another's numbering comes to (``a-2.md`` beside ``a.md``) needs a decision: whoever comes first has it. If its own first request
comes first, the other's numbering leaves a gap; else it is numbered itself from then on. How far a numbering has come
at some time depends on the gaps before, so the gaps of a name are found by rounds that end when none changes, for all names at once. Names
that number others come before those, which takes a pass for each number at the end of a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import gone, kept, running

#: A stem and its extension; a dot at the start is no extension. A stem that a numbering makes ends in a number from 2 on.
NAMED, NUMBERED = r"(?s)^(.+?)(\.[^.]*)?$", r"(?s)^(.+)-([2-9]|[1-9][0-9]{1,8})$"


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "nth") -> DataFrame:
    """rows, kept, with the place from 1 of each among those of its keys, in order."""
    return running(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", out).drop("_one")


def gaps(children: DataFrame, requests: DataFrame) -> DataFrame:
    """children (run, parent, j, first_at, made, taken_parent), kept, with ``gap``: own request first, and ``reached``: the parent's numbering comes to it.

    ``made`` is how many numbered names the parent gives, ``requests`` (run, key, nth, at) are the parents' requests. The number j is made by the parent's
    request number j - 1 less the gaps before, counted among those that are numbered.
    """
    now = kept(children.withColumn("gap", F.lit(False)).withColumn("reached", F.lit(False)))
    while True:
        below = Window.partitionBy("run", "parent").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        placed = now.withColumn("turn", F.col("j") - 1 - F.coalesce(F.sum(F.col("gap").cast("bigint")).over(below), F.lit(0)))
        asked = placed.withColumn("nth", F.when(F.col("turn") <= F.col("made"), F.col("turn") + 1 - F.col("taken_parent").cast("bigint")))
        met = asked.join(requests.select("run", F.col("key").alias("parent"), "nth", F.col("at").alias("_then")), ["run", "parent", "nth"], "left")
        new = F.coalesce(F.col("first_at") < F.col("_then"), F.lit(False))
        after = kept(met.select(*children.columns, new.alias("gap"), F.col("_then").isNotNull().alias("reached"), (new != F.col("gap")).alias("_moved")))
        gone(now)
        moved = not after.where("_moved").isEmpty()
        now = after
        if not moved:
            return now


def unique_names(rows: DataFrame, name: str, group: str, order: str, out: str = "unique_name") -> DataFrame:
    """rows with the name that each is given in its run (``group``, null being a run of its own); a null name stays null.

    ``order`` tells the rows of a run apart. Runs and names of any size are spread over tasks; decisions are made on one row a name,
    and only for those that are numbered as well as asked for.
    """
    columns = rows.columns
    plain = rows.select(*[rows[c].alias(f"c{i}") for i, c in enumerate(columns)])
    of, named, place = (F.col(f"c{columns.index(c)}") for c in (group, name, order))
    every = plain.withColumns({"run": F.when(of.isNull(), "0").otherwise(F.concat(F.lit("1"), of.cast("string"))), "key": F.lower(named), "at": place})
    some = numbered(every.where("key IS NOT NULL"), ["run", "key"], ["at"])
    keys = some.groupBy("run", "key").agg(F.max("nth").alias("asked"), F.min("at").alias("first_at"))
    stem, extension = F.regexp_extract("key", NAMED, 1), F.regexp_extract("key", NAMED, 2)
    j = F.expr("try_cast(_j AS bigint)")
    keys = keys.withColumns({"_stem": stem, "_ext": extension}).withColumn("_j", F.regexp_extract("_stem", NUMBERED, 2))
    keys = kept(keys.withColumn("j", j).withColumn("parent", F.when(F.col("j").isNotNull(), F.concat(F.regexp_extract("_stem", NUMBERED, 1), F.col("_ext")))).drop("_stem", "_ext", "_j"))
    # Only these can meet a numbering: the name that they would come of is asked for as well.
    pairs = kept(keys.where("parent IS NOT NULL").join(keys.select("run", F.col("key").alias("parent"), F.col("asked").alias("parent_asked")), ["run", "parent"]))
    # From the top: names that come of none, then those that come of these, and so on; so a name's own fate is known before what it numbers.
    settled = kept(keys.join(pairs.select("run", "key"), ["run", "key"], "left_anti").select("run", "key", F.lit(False).alias("taken")))
    waiting, found = pairs, None
    while not waiting.isEmpty():
        ready = waiting.join(settled.select("run", F.col("key").alias("parent"), F.col("taken").alias("taken_parent")), ["run", "parent"])
        children = ready.withColumn("made", F.col("parent_asked") - 1 + F.col("taken_parent").cast("bigint")).select("run", "key", "parent", "j", "first_at", "made", "taken_parent")
        asked = some.join(children.select("run", F.col("parent").alias("key")).distinct(), ["run", "key"], "left_semi")
        decided = gaps(children, asked)
        was_found, found = found, decided if found is None else kept(found.unionByName(decided))
        was, settled = settled, kept(decided.select("run", "key", (F.col("reached") & ~F.col("gap")).alias("taken")))
        gone(was)
        if was_found is not None:
            gone(was_found)
        waiting = kept(waiting.join(settled.select("run", "key"), ["run", "key"], "left_anti"))
    if found is None:
        marked = some.withColumns({"taken": F.lit(False), "free": F.array().cast("array<bigint>")})
    else:
        taken = found.where("reached AND NOT gap").select("run", "key", F.lit(True).alias("taken"))
        # Before the k-th gap of a name stand so many numbers that it gives.
        kth = F.row_number().over(Window.partitionBy("run", "parent").orderBy("j"))
        spans = found.where("gap").withColumn("_free", F.col("j") - 2 - (kth - 1)).groupBy("run", F.col("parent").alias("key")).agg(F.sort_array(F.collect_list("_free")).alias("free"))
        marked = some.join(taken, ["run", "key"], "left").join(spans, ["run", "key"], "left")
    turn = F.col("nth") - 1 + F.coalesce("taken", F.lit(False)).cast("bigint")
    skipped = F.coalesce(F.size(F.filter("free", lambda f: f < turn)), F.lit(0))
    own, end = F.regexp_extract(named, NAMED, 1), F.regexp_extract(named, NAMED, 2)
    given = F.when(turn == 0, named).otherwise(F.concat(own, F.lit("-"), (turn + 1 + F.greatest(skipped, F.lit(0))).cast("string"), end))
    done = marked.withColumn("_out", given).unionByName(every.where("key IS NULL"), allowMissingColumns=True)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_out").alias(out))
