"""Screens of a page merged into one order, against a store that is filled screen by screen."""

import random

from loomfold.content import pages
from loomfold.operators import snapshots


def stored(rows):
    """A store by key that keeps the order of insertion, and of a key the better snapshot."""
    store = {}
    for thread, capture in sorted({r[:2] for r in rows}):
        for r in sorted((r for r in rows if r[:2] == (thread, capture)), key=lambda r: r[2]):
            _, _, pos, key, owner, handle, promoted, media, chars, html = r
            if promoted or not handle or handle.lower() == "unknown":
                continue
            if handle.lower() != owner.lower():
                break
            if key is None:
                continue
            held = store.setdefault(thread, {})
            was = held.get(key)
            if was is None or (media, chars) > was[0]:
                held[key] = ((media, chars), html)
    return {t: [(k, v[1]) for k, v in held.items()] for t, held in store.items()}


def test_windows_are_merged_as_a_store_is_filled(spark):
    some, rows = random.Random(6), []
    for t in range(12):
        keys = [f"{t}-{k}" for k in range(20)]
        for capture in range(9):
            shown = keys[2 * capture : 2 * capture + 4]
            for pos, key in enumerate(shown):
                who = some.choice(["ana", "ANA", "ana", "ana", "bob", "unknown", None])
                rows.append((t, capture, pos, some.choice([key, key, key, None]), "Ana", who, some.random() < 0.1, some.randrange(3), some.randrange(3), f"<{capture}.{pos}>"))
    schema = "thread int, capture int, pos int, key string, owner string, handle string, promoted boolean, media int, chars int, html string"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    best = snapshots.merged_windows(frame)
    got = {}
    for r in sorted(best.collect(), key=lambda r: (r.thread, r.first_seen)):
        got.setdefault(r.thread, []).append((r.key, r.html))
    assert got == stored(rows)
    live = spark.createDataFrame([(0, "<live>", 1), (99, "<other>", 2), (98, None, 3)], "thread int, html string, more int")
    read = {r.thread: r for r in snapshots.with_snapshots(live, best).collect()}
    assert read[99].html == "<other>" and read[98].html == "" and read[0].more == 1
    assert read[0].html.startswith("<live><div data-rehydrate-host>") and [read[0].html.index(h) for _, h in got[0]] == sorted(read[0].html.index(h) for _, h in got[0])
    assert snapshots.merged_windows(frame.limit(0)).count() == 0


def test_facts_of_a_snapshot():
    head = '<div data-testid="User-Name"><a href="/ana">@ana</a>{}</div>'
    post = lambda inner, mark="": f'<article role="article">{head.format(mark)}<a href="/ana/status/7"><time datetime="x"></time></a>{inner}</article>'
    loaded = '<video></video><div data-testid="tweetPhoto"><img src="a"></div><div data-testid="tweetPhoto"><img></div>'
    assert pages.snapshot_facts(post(loaded)) == {"key": "7", "handle": "ana", "promoted": False, "media": 3, "chars": 4}
    assert pages.snapshot_facts(post("", "<span>Ad</span>"))["promoted"]
    assert pages.snapshot_facts("<p>none</p>")["key"] is None and pages.snapshot_facts("")["handle"] == "unknown"


def test_a_page_shows_every_post_of_its_last_screen(spark):
    """Another's post in the last screen ends a thread before what follows it there, though no screen before had that."""
    rows = spark.createDataFrame([(1, 0, 0, "<a>"), (1, 2, 1, "<c>"), (1, 2, 0, "<b>"), (2, 0, 0, "<d>")], "thread int, capture int, pos int, html string")
    assert {r.thread: r.html for r in snapshots.last_windows(rows).collect()} == {1: "<b><c>", 2: "<d>"}


def test_threads_stop_at_anothers_post_in_the_last_screen(spark, tmp_path):
    """Six turns: the fifth is another's, and the last screen has it before the sixth."""
    from loomfold.plans import registry

    spark.createDataFrame([(13, t, "user", f"t{t}") for t in range(6)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.ids for r in registry.queries()["threads_of_windows"](spark, str(tmp_path)).collect()] == ["13001,13002,13003,13004"]
