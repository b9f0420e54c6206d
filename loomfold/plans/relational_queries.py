"""Ledger, runs, limits, folds and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import chains, jobs, ledger, names, overlays, runs
from .registry import query, table

#: Items that one run takes at most, and entries that the ledger keeps.
ITEMS, LEDGER = 200, 5000


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"""
SELECT d.doc_id, d.source FROM (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT {ITEMS}) d
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
""")
def ledger_limit_then_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard batch: the cap comes first, so what stands behind it is never considered."""
    return ledger.limit_then_exclude(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", ITEMS, "doc_id")


@query(f"""
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT {ITEMS}
""")
def ledger_anti_then_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fast batch: what is exported already doesn't count towards the cap."""
    return ledger.exclude_then_limit(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", ITEMS, "doc_id")


@query(f"SELECT user_id, last_seq FROM (SELECT user_id, max(event_id) AS last_seq FROM events GROUP BY user_id) ORDER BY last_seq DESC LIMIT {LEDGER}")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entries of a ledger within its cap."""
    entries = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_seq"))
    return ledger.tail(entries, LEDGER, "last_seq")


@query(f"""
WITH old AS (SELECT user_id AS id, event_id AS seq FROM events WHERE event_type <> 'error'),
new AS (SELECT user_id AS id, event_id + 1000000000 AS seq FROM events WHERE event_type = 'error'),
firsts AS (SELECT id, min(seq) AS seq FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY id)
SELECT id, seq FROM firsts ORDER BY seq DESC LIMIT {LEDGER}
""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending what is there already doesn't move it."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    old = events.where("event_type <> 'error'").drop("event_type")
    new = events.where("event_type = 'error'").select("id", (F.col("seq") + 1_000_000_000).alias("seq"))
    return ledger.appended(old, new, "id", "seq", LEDGER)


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.found THEN 'completed' ELSE 'gone' END AS backlog_status
FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS found FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
""")
def backlog_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog entries by what their details say."""
    details = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("found"))
    return ledger.backlog_status(_docs(spark, sf_dir).select("doc_id"), details, "doc_id", "found")


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def detail_over_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root's columns give way to its detail's."""
    roots = _docs(spark, sf_dir).select("doc_id", F.lit(-1).alias("quality"))
    return ledger.detail_or_root(roots, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query("""
SELECT user_id, event_type, value, event_id AS seq, first_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth, min(event_id) OVER (PARTITION BY user_id) AS first_seen FROM events) WHERE nth = 1
""")
def snapshot_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key the best snapshot, the earlier one of equals."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return ledger.best_snapshot(events, "user_id", ["value"], "seq")


@query("SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last = 'click'")
def selection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last toggle selects them."""
    return ledger.last_choice(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "click")


@query("""
SELECT doc_id, CASE WHEN nth = 1 THEN name ELSE regexp_replace(name, '\\.md$', '') || '-' || nth || '.md' END AS unique_name
FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY source, lower(name) ORDER BY doc_id) AS nth FROM (SELECT doc_id, source, lang || '-' || (n_chars // 100) || '.md' AS name FROM documents))
""")
def filename_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of a name gets -2, the third -3, case aside."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.concat("lang", F.lit("-"), F.expr("n_chars div 100").cast("string"), F.lit(".md")).alias("name"))
    return ledger.numbered_names(rows, "name", "source", "doc_id").select("doc_id", "unique_name")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, source, lang || CASE WHEN doc_id % 4 < 2 THEN '' ELSE '-' || (doc_id % 4) END AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
step AS (
  SELECT place, source, doc_id, stem || '.md' AS made, [lower(stem || '.md')] AS given FROM d WHERE place = 1
  UNION ALL
  SELECT d.place, d.source, d.doc_id, x.made, list_append(s.given, lower(x.made)) FROM step s JOIN d ON d.source IS NOT DISTINCT FROM s.source AND d.place = s.place + 1,
    LATERAL (SELECT CASE WHEN NOT list_contains(s.given, lower(d.stem || '.md')) THEN d.stem || '.md'
      ELSE d.stem || '-' || list_min(list_filter(range(2, len(s.given) + 3), lambda n: NOT list_contains(s.given, lower(d.stem || '-' || n || '.md')))) || '.md' END AS made) x)
SELECT doc_id, source, made AS unique_name FROM step
""")
def filename_collision_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a run gives them one after the other, so that a made name avoids a given one; en.md, en-2.md and en-3.md are all given."""
    number = F.when(F.col("doc_id") % 4 < 2, "").otherwise(F.concat(F.lit("-"), (F.col("doc_id") % 4).cast("string")))
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.concat("lang", number, F.lit(".md")).alias("name"))
    return names.unique_names(rows, "name", "source", "doc_id").select("doc_id", "source", "unique_name")


@query("""
WITH w AS (SELECT event_id, user_id, ts, event_type, first_value(lower(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead FROM events),
m AS (SELECT *, max(CASE WHEN lower(event_type) <> lead THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS other FROM w)
SELECT user_id, event_id, event_type FROM m WHERE other = 0
""")
def thread_leading_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading rows of the first author, up to the first by another."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("at", F.struct("ts", "event_id"))
    return runs.leading_run(events, "user_id", "at", "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS nth FROM conversations WHERE lower(role) <> 'system'),
f AS (SELECT *, first_value(lower(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM k WHERE nth = 1),
m AS (SELECT *, max(CASE WHEN lower(role) <> lead THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS other FROM f)
SELECT conv_id, turn, role FROM m WHERE other = 0
""")
def thread_page_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as pages have it: unknown authors don't end it, and a key counts once."""
    return runs.page_thread(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", unknown="system").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS nth FROM conversations) WHERE nth = 1
""")
def focused_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row in focus, or else the first."""
    return runs.focused(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "role")


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS run_length, min(event_id) AS run_start FROM i GROUP BY user_id, island
""")
def type_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same kind, as items are gathered into lists."""
    return runs.island_lengths(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS successes FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, successes ORDER BY event_id) AS BIGINT) AS failures_in_a_row FROM s
""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many failures in a row end at each event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return runs.failure_runs(events, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "failures_in_a_row")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS successes FROM events),
r AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, successes ORDER BY event_id) AS run FROM s),
p AS (SELECT user_id, min(CASE WHEN run >= 2 THEN event_id END) AS stopped_at FROM r GROUP BY user_id)
SELECT r.user_id, CASE WHEN p.stopped_at IS NULL THEN 'done' ELSE 'paused' END AS status,
       count(*) FILTER (WHERE r.event_type <> 'error' AND (p.stopped_at IS NULL OR r.event_id <= p.stopped_at)) AS completed,
       count(*) FILTER (WHERE r.event_type = 'error' AND (p.stopped_at IS NULL OR r.event_id <= p.stopped_at)) AS failed
FROM r JOIN p USING (user_id) GROUP BY r.user_id, p.stopped_at
""")
def job_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a job's results: it pauses at two failures in a row, and later results are dropped."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return jobs.folded(events, "user_id", "event_id", F.col("event_type") == "error", pause_at=2)


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 23:59:59.999'")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole days and what lies between them; bounds in the wrong order are swapped."""
    events = table(spark, sf_dir, "events")
    return events.where(dates.in_date_range(F.col("ts").cast("timestamp"), "2024-01-20", "2024-01-10")).select("event_id", "user_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of a JSON column; what can't be read is null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, CAST(floor(votes * 100.0 / sum(votes) OVER (PARTITION BY user_id) + 0.5) AS INT) AS percent FROM c
""")
def poll_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole percents of votes, half up."""
    votes = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    polls = votes.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "votes")).alias("choices"))
    shared = polls.select("user_id", F.explode(F.arrays_zip(F.col("choices.event_type").alias("event_type"), runs.shares(F.col("choices.votes")).alias("percent"))).alias("c"))
    return shared.select("user_id", F.col("c.event_type").alias("event_type"), F.col("c.percent").alias("percent"))


@query("""
WITH v AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS mp4, CAST(floor(value) AS BIGINT) AS bitrate FROM events),
r AS (SELECT *, max(mp4) OVER (PARTITION BY user_id) AS any_mp4 FROM v)
SELECT user_id, 'u' || event_id AS url FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN any_mp4 = 1 THEN -mp4 ELSE 0 END, CASE WHEN any_mp4 = 1 THEN -bitrate ELSE 0 END, event_id) AS nth FROM r) WHERE nth = 1
""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mp4 of the highest bitrate, the first of equals; without one the first variant."""
    variant = F.struct(F.col("event_id").alias("at"), F.floor("value").cast("bigint").alias("bitrate"), F.when(F.col("event_type").isin("view", "click"), "video/mp4").otherwise("other").alias("content_type"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"))
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    return each.select("user_id", runs.best_variant(F.col("variants")).alias("url"))


@query("""
SELECT coalesce(event_type, '') AS event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1
""")
def harvest_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys with where they were first seen."""
    seen = table(spark, sf_dir, "events").select(F.coalesce("event_type", F.lit("")).alias("event_type"), "event_id")
    return ledger.first_seen(seen, "event_type", "event_id").withColumnRenamed("first_at", "first_id")


@query("""
WITH q AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM q) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
ORDER BY d.doc_id LIMIT greatest(0, 1000 - (SELECT count(*) FROM q))
""")
def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items that are neither queued nor exported, within the room that a queue of 1000 has left."""
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return ledger.appended_to_queue(docs.where("doc_id % 3 = 0"), docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id", 1000)


@query("""
WITH RECURSIVE o AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) + 20 AS e, row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS k FROM events),
walk AS (SELECT user_id, k, s, CASE WHEN s >= 0 THEN e ELSE 0 END AS cursor, CASE WHEN s >= 0 THEN 1 ELSE 0 END AS taken FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.s, CASE WHEN o.s >= w.cursor THEN o.e ELSE w.cursor END, CASE WHEN o.s >= w.cursor THEN 1 ELSE 0 END FROM walk w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, CAST(sum(taken) AS BIGINT) AS n_taken FROM walk GROUP BY user_id
""")
def entity_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans taken in order of start, those that overlap the last one taken skipped."""
    at = F.floor("value").cast("bigint")
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("start"), F.col("event_id").alias("n"), (at + 20).alias("end")))).alias("spans"))
    return spans.select("user_id", F.size(runs.spliced(F.col("spans"))).cast("bigint").alias("n_taken"))


@query("""
SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) AS nth FROM events)
""")
def articles_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind first, each kind in its own order."""
    return ledger.articles_first(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "view", "event_id").select("event_id", F.col("place").alias("nth"))


@query("""
WITH RECURSIVE walk AS (
    SELECT doc_id AS chain, doc_id, 0 AS place FROM documents WHERE doc_id < 7
    UNION ALL
    SELECT w.chain, d.doc_id, w.place + 1 FROM walk w JOIN documents d ON d.doc_id = w.doc_id + 7)
SELECT chain, doc_id, CAST(place AS BIGINT) AS place FROM walk
""")
def feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every page in its feed, where a page names the next one alone: seven feeds side by side, ranked without a walk."""
    name = lambda c: F.md5(c.cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", name(F.col("doc_id")).alias("node"), name(F.col("doc_id") + 7).alias("then"))
    found = chains.places(docs, docs.where("doc_id < 7").select(F.col("doc_id").alias("chain"), "node"))
    return found.join(docs, "node").select("chain", "doc_id", "place")


_STRETCHES = """
p AS (SELECT g, low AS pos FROM r UNION SELECT g, high FROM r), e AS (SELECT g, pos, lead(pos) OVER (PARTITION BY g ORDER BY pos) AS next FROM p),
s AS (SELECT e.g, e.pos, e.next, bool_or(coalesce(kind = 'bold', false)) AS bold, bool_or(coalesce(kind = 'italic', false)) AS italic, arg_max(link, nth) FILTER (WHERE link IS NOT NULL) AS link FROM e JOIN r ON r.g = e.g AND r.low <= e.pos AND r.high >= e.next GROUP BY e.g, e.pos, e.next),
c AS (SELECT *, CASE WHEN pos IS NOT DISTINCT FROM lag(next) OVER w AND (bold, italic, coalesce(link, '')) IS NOT DISTINCT FROM lag((bold, italic, coalesce(link, ''))) OVER w THEN 0 ELSE 1 END AS change FROM s WINDOW w AS (PARTITION BY g ORDER BY pos)),
i AS (SELECT *, sum(change) OVER (PARTITION BY g ORDER BY pos) AS island FROM c),
o AS (SELECT g, min(pos) AS low, max(next) AS high, any_value(bold) AS bold, any_value(italic) AS italic, any_value(link) AS link FROM i GROUP BY g, island)
"""


@query(f"""
WITH r AS (SELECT event_type AS g, CAST(floor(10 * value) AS BIGINT) + 1000 * (user_id % 10) AS low, CAST(floor(10 * value) AS BIGINT) + 1000 * (user_id % 10) + user_id % 7 AS high,
  CASE event_id % 3 WHEN 0 THEN 'bold' WHEN 1 THEN 'italic' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'u' || user_id END AS link, event_id AS nth FROM events WHERE value IS NOT NULL AND user_id % 7 > 0), {_STRETCHES}
SELECT g AS event_type, low, high, bold, italic, link FROM o
""")
def range_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a range of its kind's line: stretches of equal state over all of them, with the link that was painted last."""
    low = F.floor(10 * F.col("value")).cast("bigint") + 1000 * (F.col("user_id") % 10)
    ranges = table(spark, sf_dir, "events").select("event_type", low.alias("low"), (low + F.col("user_id") % 7).alias("high"), "event_id", "user_id")
    flags = {"bold": F.col("event_id") % 3 == 0, "italic": F.col("event_id") % 3 == 1}
    link = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return overlays.overlaid(ranges, "event_type", "low", "high", flags, link, "event_id", "link")


@query(f"""
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
k AS (SELECT t.*, x.k AS nth, 40 * x.k + doc_id * x.k % 17 AS low, 40 * x.k + doc_id * x.k % 17 + (doc_id + 7 * x.k) % 60 AS high FROM t, LATERAL (SELECT unnest(range(n // 40 + 1)) AS k) x),
r AS (SELECT doc_id AS g, low, least(high, n) AS high, CASE nth % 4 WHEN 0 THEN 'bold' WHEN 1 THEN 'italic' END AS kind, CASE WHEN nth % 4 > 1 THEN 'u' || nth % 3 END AS link, nth FROM k WHERE low < least(high, n)
  UNION ALL SELECT doc_id, 0, n, NULL, NULL, -1 FROM t), {_STRETCHES}
SELECT o.g AS doc_id, count(*) AS n_pieces, sha256(string_agg(substr(t.text, low + 1, high - low) || '|' || CASE WHEN bold THEN 'b' ELSE '' END || CASE WHEN italic THEN 'i' ELSE '' END || coalesce(link, '') || '|', '' ORDER BY low)) AS pieces_sha256
FROM o JOIN t ON t.doc_id = o.g GROUP BY o.g
""")
def styled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with overlapping bold, italic and linked ranges all over them, cut into pieces of one style."""
    docs = table(spark, sf_dir, "documents")
    nth = F.col("place")
    each = docs.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("length(text) div 40").cast("int"))).alias("place"))
    url, style = F.when(nth % 4 > 1, F.concat(F.lit("u"), (nth % 3).cast("string"))), F.when(nth % 4 == 0, "bold").when(nth % 4 == 1, "italic")
    ranges = each.select("doc_id", (40 * nth + F.col("doc_id") * nth % 17).alias("offset"), ((F.col("doc_id") + 7 * nth) % 60).alias("length"), style.alias("style"), url.alias("url"), "place")
    marks = F.concat(F.when(F.col("bold"), "b").otherwise(""), F.when(F.col("italic"), "i").otherwise(""), F.coalesce("link", F.lit("")))
    shown = overlays.styled_pieces(docs, ranges, "doc_id", "text").select("doc_id", "low", F.concat("piece", F.lit("|"), marks, F.lit("|")).alias("shown"))
    # The pieces of one text, which is a row itself.
    return shown.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "shown"))), lambda p: p["shown"]), ""), 256).alias("pieces_sha256"))
