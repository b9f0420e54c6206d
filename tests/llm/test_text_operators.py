"""BPE, URL rules, mixing, toxicity, language identification."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.llm import bpe, language_id, mixing, toxicity, url_filter
from loomfold.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.ForcedBoundaryBPE(tokenizer_path())


def library_ids(tokenizer, text):
    return np.array(tokenizer.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


TRICKY = [
    "", " ", "  ", "\n\nb", " \n b", "a  b", "a\t\tb\n", "it's rock'n'roll's 'sample' ''s p's 5's é's I'LL we've", "é é  é\u00a0x\u2003y\u3000z\u0085", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext",
    "naïve façade 123abc456 $12.50 -- ... !!??", "日本語テキスト。한국어 текст", "👩‍👩‍👧 flags 🇩🇪", "a" * 5000, "x\r\n\r\ny \x1c\x1f\x0b z", "\ufeffbom", "e\u0301 combining", "\x00\x01",
]


@pytest.mark.parametrize("text", TRICKY)
def test_bpe_is_the_library(tokenizer, text):
    ids = tokenizer.encode(text.encode())
    assert ids == library_ids(tokenizer, text)
    assert tokenizer.decode(ids).decode() == tokenizer.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert tokenizer.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab 'srtvmdl\n\t.,!1\u00a0é日👍\u2028<|>")), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_bpe_is_the_library_on_any_text(tokenizer, text):
    assert tokenizer.encode(text.encode()) == library_ids(tokenizer, text)


def test_bpe_cuts_slabs(tokenizer, monkeypatch):
    text = "It's a long text, with  spaces and\n\nlines: 12,345 ünïcode wörds. " * 50
    want = library_ids(tokenizer, text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(bpe, "SLAB_BYTES", size)
        assert tokenizer.encode(text.encode()) == want


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, " \n\t" * 400_000, "a" + " " * 1_000_000 + "b" + "\n" * 100_000 + " c", "x" * 20_000, "\u3000" * 50_000], ids=range(7))
def test_bpe_takes_long_runs(tokenizer, text):
    ids = tokenizer.encode(text.encode())
    assert ids == library_ids(tokenizer, text)
    assert tokenizer.decode(ids) == text.encode()


def test_bpe_refuses_added_tokens_that_overlap(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        described = json.load(f)
    described["added_tokens"].append(described["added_tokens"][0] | {"id": 50257, "content": "text|>x"})
    path = tmp_path / "overlapping.json"
    path.write_text(json.dumps(described), encoding="utf-8")
    with pytest.raises(ValueError, match="overlap"):
        bpe.ForcedBoundaryBPE(str(path))


def test_bpe_cuts_are_never_inside_tokens(tokenizer):
    text = " ".join(t for t in TRICKY if "<|" not in t)
    cuts = set(tokenizer.cuts(text.encode()).tolist())
    ends = np.cumsum([len(tokenizer.bytes_of[i]) for i in np.frombuffer(library_ids(tokenizer, text), "<u4").tolist()])
    assert cuts <= set(ends.tolist())
    assert len(cuts) > 50


def test_bpe_on_frames(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (None, ""), (1, "hello world")], SCHEMA).withColumn("ids", F.lit("clash"))
    rows = bpe.digests(docs, tokenizer_path()).collect()
    assert len(rows) == 4
    by = {(r.doc_id, r.n_tokens): r for r in rows}
    assert by[(2, 0)].ids_sha256 == hashlib.sha256(b"").hexdigest() == by[(None, 0)].decoded_sha256
    assert by[(1, 2)].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path()), tokenizer_path()).collect()
    assert sorted(r.text for r in back) == ["", "", "hello world", "hello world"]
    assert all(r.round_trip for r in bpe.encode_and_verify(docs, tokenizer_path()).collect())
    assert bpe.digests(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def judged(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


URLS = [
    None, "", "no scheme", "://", "http://com", "http://com/", "https://EXAMPLE.com/en/1", "http://www.example.com/en/x?y#z", "http://a.www.example.com/en/", "http://badexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://x.net/esp/",
    "http://net/fr/1", "ftp://x.org/", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "http://user@example.com:80/en/", "http://example.com./en/", "a://b://c/d", "http://..com/x", "http://x.com//en//", "http://example.com/EN/", "http://ÉXAMPLE.com/é/", "http://e.com/a\nb",
]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_url_rules_are_brute_force(spark, broadcast):
    more = [("e.com", "/a", "block"), ("e.com", "", "allow"), ("x.com", "//en", "block"), ("x.com", "//en//", "allow"), ("x.com", "//en//", "block")]
    for rules in (URL_RULES, [*URL_RULES, *more]):
        settled = {(h, p): v for h, p, v in sorted(rules, key=lambda r: r[2] == "block")}
        pages = spark.createDataFrame(list(enumerate([*URLS, *URLS])), "page_id long, url string")
        out = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), broadcast_rules=broadcast).collect()
        assert len(out) == 2 * len(URLS)
        for r in out:
            assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id % len(URLS)], [(h, p, v) for (h, p), v in settled.items()]), URLS[r.page_id % len(URLS)]


def test_url_rules_take_long_addresses(spark):
    """A megabyte of path, and of host, costs no more expressions than the rules have shapes."""
    long = ["http://x.net/es/" + "a/" * 500_000, "http://" + "a." * 500_000 + "net/fr/", "http://example.com/en/" + "b" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    url_filter.judge_urls(pages.limit(0), rules).collect()
    began = time.perf_counter()
    out = url_filter.judge_urls(pages, rules).collect()
    assert time.perf_counter() - began < 15
    assert sorted((r.page_id, r.rule, r.verdict) for r in out) == [(0, "net/es/", "block"), (1, "net/fr/", "block"), (2, "example.com/en/", "block")]


def test_url_rules_edge_cases(spark):
    rules = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string").withColumn("host", F.lit(1))
    assert [(r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()] == [(None, "allow")] * 3
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def water_filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target, left, full = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(order):
        total = sum(w[s] for s in order if s not in full)
        give = {s: left * w[s] / total for s in order if s not in full}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= cap * sizes[s] - 1e-9:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("cut_last", [True, False])
def test_mixing_is_brute_force(spark, cut_last):
    r = random.Random(5)
    docs = [(i, r.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"] if i % 50 else ["tiny"]), " ".join(["w"] * r.randrange(0, 40))) for i in range(900)] + [(900, "empty", None), (901, "empty", "")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mix(frame, cut_last=cut_last).collect()
    again = mixing.mix(frame.repartition(7, "source"), cut_last=cut_last).collect()
    assert sorted((x.doc_id, x.taken) for x in rows) == sorted((x.doc_id, x.taken) for x in again)
    sizes = collections.Counter()
    for _, s, t in docs:
        sizes[s] += len((t or "").split())
    want = water_filled(dict(sizes) | {"empty": 0})
    taken = collections.Counter()
    for x in rows:
        assert x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source], abs=1e-6)
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (1 if cut_last else 21), s
    # Within a source the selection is a prefix of the order of keys.
    us = dict(frame.select("doc_id", mixing.uniform(F.col("doc_id"), 0)).collect())
    texts = {i: (t or "").split() for i, _, t in docs}
    for s in sizes:
        own = [x for x in rows if x.source == s and x.size]
        own.sort(key=lambda x: -math.log(us[x.doc_id]) / (0.1 + len(set(texts[x.doc_id])) / x.size))  # texts of one stretch
        extras = [x.taken - x.epochs * x.size for x in own]
        ends = [n for n, (e, x) in enumerate(zip(extras, own, strict=True)) if e < x.size]
        assert not any(extras[ends[0] + 1 :]) if ends else True


def test_mixing_order_follows_quality(spark):
    """Documents of ten times the weight are selected far more often."""
    docs = spark.createDataFrame([(i, "s" if i < 4000 else "t", "w w w w", 10.0 if i % 2 else 1.0) for i in range(4400)], "doc_id long, source string, text string, q double")
    out = mixing.mix(docs, weights=(1, 5), share=0.5, quality_col="q").where("source = 's'").collect()
    good, bad = (sum(x.taken > 0 for x in out if x.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("weight", [1e-6, 0.15, 1000.0, None])
def test_mixing_puts_few_rows_in_order(spark, weight):
    """Whatever the weights, the sums leave next to nothing to sort, and the selection is the order of keys."""
    r = random.Random(3)
    docs = [(i, "s" if i % 4 else "t", "w " * r.randrange(1, 9), weight or 10 ** r.uniform(-6, 3)) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, q double")
    rows = mixing.mix(frame, weights=(1, 5), share=0.6, quality_col="q").where("source = 's'").collect()
    us, q = dict(frame.select("doc_id", mixing.uniform(F.col("doc_id"), 0)).collect()), {d[0]: d[3] for d in docs}
    own = sorted(rows, key=lambda x: -math.log(us[x.doc_id]) / q[x.doc_id])
    ends = next(n for n, x in enumerate(own) if x.taken < x.size)
    assert 50 < ends and not any(x.taken for x in own[ends + 1 :])
    keys = spark.createDataFrame([(-math.log(u) / q[i],) for i, u in us.items()], "key double")
    slots = collections.Counter(x[0] for x in keys.select(F.shiftright(mixing.place_of(F.col("key")), mixing.PLACE_BITS - sum(mixing.ROUND_BITS))).collect())
    assert max(slots.values()) <= 2


def test_mixing_clashing_columns_repeats_and_long_texts(spark):
    rows = [(1, "a", "x y " * 200_000), (2, "a", "z"), (2, "a", "z"), (2, "a", "z"), (3, None, "w w"), (None, "b", "q r s"), (None, "b", None)]
    names = ["_of", "_times", "_nth", "of", "times", "nth", "place", "key", "slot", "size"]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({n: F.lit(n) for n in names})
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in out)
    size = {"a": 400_003, None: 2, "b": 3}
    want, taken = water_filled(size), collections.Counter()
    for x in out:
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and all(x._of == "_of" and x.nth == "nth" for x in mixed.collect())


def test_mixing_targets_of_many_sources(spark):
    """Targets of thousands of sources, summed up range by range, against resharing again and again."""
    r = random.Random(9)
    sizes = {f"h{i:04}": r.randrange(0, 1000) for i in range(2500)} | {None: 77}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()
    assert {x.source: x.target for x in got} == pytest.approx(water_filled(sizes), abs=1e-4)


def test_mixing_of_few_and_many_sources_is_the_same(spark, monkeypatch):
    r = random.Random(21)
    docs = spark.createDataFrame([(None if i % 9 == 0 else i % 70, r.choice("abcde") if i % 6 else None, "w " * r.randrange(40) + str(i % 11)) for i in range(300)], "doc_id long, source string, text string")
    few = sorted(tuple(x) for x in mixing.mix(docs).select("doc_id", "size", "target", "taken").na.fill(-1).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    many = sorted(tuple(x) for x in mixing.mix(docs).select("doc_id", "size", "target", "taken").na.fill(-1).collect())
    assert [(a, b, d) for a, b, _, d in few] == [(a, b, d) for a, b, _, d in many]
    assert [x[2] for x in few] == pytest.approx([x[2] for x in many])


def test_mixing_of_few_sources_takes_few_jobs(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 7)) for i in range(200)], "doc_id long, source string, text string")
    group = f"mixing-{time.time()}"
    spark.sparkContext.setJobGroup(group, "mixing")
    try:
        mixing.mix(docs).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 30
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_mixing_of_one_id_on_all_rows(spark):
    """Documents that share an id, or have none, reach their source's target, with and without the cut."""
    for one in (5, None):
        docs = spark.createDataFrame([(one, "s" if i % 3 else "t", f"{i} " + "w " * (i % 13)) for i in range(240)], "doc_id long, source string, text string")
        rows = mixing.mix(docs).collect()
        for source in "st":
            own = [x for x in rows if x.source == source]
            assert sum(x.taken for x in own) == pytest.approx(own[0].target, abs=1)
            assert all(x.taken <= 2 * x.size for x in own)


def test_mixing_quality_does_not_fall_with_length():
    words = [f"w{i % 400}".encode() for i in range(20_000)]
    assert mixing.variety(words) == mixing.variety(words[:300]) == 1.0
    assert mixing.variety([]) == 0.0 and mixing.variety([b"a"] * 64) == mixing.variety([b"a"] * 6400) == 1 / 64


def test_mixing_edge_cases(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(None, None, None), (1, "a", ""), (1, "a", "")], schema)).collect()
    assert [(x.size, x.target, x.taken) for x in rows] == [(0, 0.0, 0)] * 3
    docs = spark.createDataFrame([(i, "abc"[i % 3], "x y z " * (i % 4 + 1)) for i in range(60)], schema)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = collections.Counter(x.doc_id for x in mixed.collect())
    assert max(times.values()) <= 2
    assert dict(mixing.mix(docs, cut_last=False).select("doc_id", (F.col("epochs") + F.col("selected").cast("long"))).where("epochs + cast(selected as int) > 0").collect()) == dict(times)


def brute_segments(scores):
    """Maximal segments by the definition: take the best, split, and go on."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, a, b = best
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1, 2.25, 3.5, 0.75, -2.125, -0.375]), max_size=14))
def test_segments_are_maximal(values):
    odds = [(i, v + 1) for i, v in enumerate(values) if v != -1]
    found = toxicity.segments(odds, -1)
    want = brute_segments(values)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in found] == pytest.approx([s for *_, s in want])


def labelled_corpus(n=1200):
    r = random.Random(2)
    words = [f"wo{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8 % 8]}{'stuv'[i // 64 % 4]}" for i in range(256)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(5, 80))]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["nastyword", "vilething"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_finds_what_labels_mark(spark):
    docs, labels = labelled_corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks)
    rows = toxicity.score_toxicity(frame, model).collect()
    truth = dict(labels)
    wrong = [x.doc_id for x in rows if x.predicted != truth[x.doc_id]]
    assert len(wrong) <= 5
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    assert all(x.passages for x in rows if truth[x.doc_id])
    kept = toxicity.drop_toxic(frame, model)
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if not x.predicted}


def test_toxicity_learns_from_few_documents_of_a_language(spark):
    r = random.Random(6)
    words = {lang: [f"{lang}{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnp"] for lang in ("xo", "zu")}
    insults = {"xo": ["hurgle", "vrokk"], "zu": ["pilwak", "quonty"]}
    docs, labels = [], []
    for i in range(1600):
        lang = "zu" if i % 8 == 0 else "xo"
        bad = i % 10 == 1 or i % 80 == 8
        text = [r.choice(words[lang]) for _ in range(r.randrange(8, 40))]
        if bad:
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(insults[lang]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(frame, spark.createDataFrame([x for x in labels if x[0] // 80 % 4], "doc_id long, toxic int"))
    held = [x for x in toxicity.score_toxicity(frame, model).collect() if x.doc_id // 80 % 4 == 0]
    truth = dict(labels)
    few = [x for x in held if x.doc_id % 8 == 0 and truth[x.doc_id]]
    assert len(few) == 5 and all(x.predicted for x in few)
    assert sum(x.predicted != truth[x.doc_id] for x in held) <= 3


def test_segments_take_linear_time():
    """A million words, toxic ones among them at distances of which each lets segments merge, or none does."""
    for every, odds, drift in ((5, 4.0, -1.0), (5, 7.0, -1.0), (2, 2.5, -1.0)):
        scored = [(i, odds + i % 7 / 100) for i in range(0, 1_000_000, every)]
        began = time.process_time()
        assert toxicity.segments(scored, drift)
        assert time.process_time() - began < 5
    # Sums before segments that only fall: nothing merges and nothing is kept open.
    began = time.process_time()
    assert len(toxicity.segments([(i, 1.5) for i in range(0, 1_000_000, 5)], -1.0)) == 200_000
    assert time.process_time() - began < 5


def brute_toxicity(docs, labels, drift=-1.0, prior_share=0.03, false_share=0.2, least=3, step=0.05):
    """The model's scores by their definition: log-odds with a prior, false discoveries, segments by trying all, the law, and the sums."""
    rows = [(t, dict(labels)[i]) for i, t in docs if i in dict(labels) and t is not None]
    counts = collections.Counter()
    for text, label in rows:
        counts.update({(k, label) for w in toxicity.tokens(text.encode()) for k in toxicity.keys_of(w)})
    n = [sum(c for (_, y), c in counts.items() if y == label) for label in (0, 1)]
    share, odds, tested = n[1] / sum(n), {}, {}
    for token in {k for k, _ in counts}:
        x = [counts[token, 0], counts[token, 1]]
        if sum(x) >= least:
            y = [v + prior_share * sum(x) for v in x]
            odds[token] = math.log(y[1] / (n[1] + prior_share * sum(n) - y[1])) - math.log(y[0] / (n[0] + prior_share * sum(n) - y[0]))
            part = lambda v, s, m=sum(x): v * math.log(v / (m * s)) if v else 0.0
            tested[token] = (x[1] > sum(x) * share, part(x[1], share) + part(x[0], 1 - share))
    kept = {}
    for side in (True, False):
        bins = sorted((min(2000, math.floor(s / step)) for more, s in tested.values() if more == side), reverse=True)
        cuts = [b for b in bins if math.exp(-b * step) * len(tested) <= false_share * sum(x >= b for x in bins)]
        kept |= {t: odds[t] for t, (more, s) in tested.items() if more == side and cuts and s >= min(cuts) * step}
    found = {}
    for text in {t or "" for _, t in docs}:
        words = toxicity.tokens(text.encode())
        scores = [max((kept[k] for k in toxicity.keys_of(w) if k in kept), default=0.0) + drift for w in words]
        found[text] = ([s for *_, s in brute_segments(scores)], len(words))
    clean = [found[t] for t, label in rows if label == 0]
    islands, total = sorted(s for scores, _ in clean for s in scores), sum(m for _, m in clean)
    scale, log_k = 1.0, math.log(0.5 / total)
    if islands:
        cut = islands[math.ceil(len(islands) / 2) - 1]
        above = [s - cut for s in islands if s >= cut]
        scale = min(5.0, 1 / max(sum(above) / len(above), 1e-3))
        log_k = math.log((len(above) + 0.5) / total) + scale * cut

    def features(text):
        scores, m = found[text]
        each = sorted((scale * s - log_k - math.log(max(m, 1)) for s in scores), reverse=True)
        above = [e for e in each if e > 0]
        sums = [sum(above[:r]) for r in range(1, len(above) + 1)]
        together = [t - math.log(2**r * t ** (r - 1) / math.factorial(r) / math.factorial(r - 1)) for r, t in enumerate(sums, 1)]
        return [max([*together, each[0] if each else -log_k - math.log(max(m, 1))]), scale * max(scores, default=0.0), sum(above)]

    weights = toxicity.logistic(np.array([features(t) for t, _ in rows]), np.array([y for _, y in rows], float))
    return {i: 1 / (1 + math.exp(-(weights[0] + weights[1:] @ features(t or "")))) for i, t in docs}


def test_toxicity_query_is_brute_force(spark):
    docs, labels = labelled_corpus(300)
    docs = [(i, " ".join(t.split()[:40])) for i, t in docs] + [(300, None), (301, ""), (302, "12 !")]
    marks = [x for x in labels if x[0] % 4]
    frame = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(frame, spark.createDataFrame(marks, "doc_id long, toxic int"), merge_copies=False)
    want = brute_toxicity(docs, marks)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(frame, model).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert any(v < 0 for v in model.odds.values()) or min(model.odds.values()) > 0


def test_toxicity_scores_add_up_segments(spark):
    """Many weak passages say more than one of them."""
    docs, labels = labelled_corpus()
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = " ".join(w for _, t in docs[1:9] for w in t.split())[:1500]
    words = clean.split()
    spread = lambda n: " ".join(w + (" nastyword" if n and i % (len(words) // n) == 3 else "") for i, w in enumerate(words)).encode()
    scores = [model.score_text(spread(n)) for n in (0, 1, 3, 6)]
    assert scores == sorted(scores) and scores[3] > scores[1]


def test_toxicity_long_texts_ties_and_clashing_columns(spark):
    docs, labels = labelled_corpus()
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = "nastyword wo aa vilething wo bb cc " * 30_000
    frame = spark.createDataFrame([(1, long, "x"), (2, long, "y"), (2, "wo", "z"), (None, None, None)], "doc_id long, text string, label string").withColumns({"draw": F.lit(1), "of": F.lit("o"), "passages": F.lit(0)})
    rows = sorted(toxicity.score_toxicity(frame, model).collect(), key=lambda x: (x.doc_id or 0, -x.score))
    assert [x.predicted for x in rows] == [0, 1, 1, 0] and rows[1].score == rows[2].score
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and {(x.doc_id, x.label) for x in kept.collect()} == {(2, "z"), (None, None)}
    again = toxicity.fit(spark.createDataFrame(docs, SCHEMA).withColumns({"label": F.lit("l"), "draw": F.lit("d")}), spark.createDataFrame(labels, "doc_id long, toxic int").withColumns({"text": F.lit(0), "of": F.lit(3)}))
    assert again.odds == model.odds


def test_toxicity_edge_cases(spark):
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(empty, none)
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 1000), (2, "word")], SCHEMA).withColumn("score", F.lit("clash"))
    assert [0 <= x.score <= 1 for x in toxicity.score_toxicity(docs, model).collect()] == [True] * 4
    assert toxicity.score_toxicity(empty, model).count() == 0
    one = toxicity.fit(docs, spark.createDataFrame([(2, 0)], "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.score_toxicity(docs, one).collect()} == {0}


def test_language_identification(spark):
    r = random.Random(4)
    stems = {"aa": ["the", "with", "from", "their", "which"], "bb": ["der", "und", "nicht", "auch", "werden"], "cc": ["les", "pour", "avec", "dans", "être"]}
    docs = [(i, " ".join(r.choice(stems[lang]) + r.choice(["", "en", "s"]) for _ in range(r.randrange(3, 200))), lang) for i, lang in enumerate(r.choices(list(stems), [8, 1, 1], k=600))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(frame.where("doc_id % 4 <> 2"))
    rows = language_id.identify(frame, model).collect()
    truth = {i: lang for i, _, lang in docs}
    assert sum(x.lang_pred == truth[x.doc_id] for x in rows if x.doc_id % 4 == 2) >= 145
    assert all(0 <= x.score <= 1 for x in rows)


def languages_corpus(n):
    """n[lang] texts a language, each of words made from the language's own syllables."""
    r = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "re", "so"], "bb": ["sch", "ein", "ung", "ber", "ge", "ach"], "cc": ["eau", "oi", "ent", "que", "lle", "re"]}
    return [(lang, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 60)))) for lang, k in n.items() for _ in range(k)]


def right_of(spark, learned, held):
    """How many of held get their language from a model of learned, by language."""
    schema = "doc_id long, lang string, text string"
    frames = [spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], schema) for rows in (learned, held)]
    model = language_id.fit(frames[0])
    return collections.Counter(held[x.doc_id][0] for x in language_id.identify(frames[1], model).collect() if x.lang_pred == held[x.doc_id][0]), model


def test_language_dictionaries_have_copies_once(spark):
    learned = languages_corpus({"aa": 800, "bb": 800, "cc": 40})
    one = next(x for x in learned if x[0] == "cc")[1]
    near = [("cc", f"{one} {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 2}") for i in range(3000)]
    right, model = right_of(spark, learned + [("cc", one)] * 3000 + near, languages_corpus({"aa": 40, "bb": 40, "cc": 40}))
    assert all(right[lang] >= 39 for lang in ("aa", "bb", "cc"))
    found = collections.Counter(model.contents["cc"].split(b"\n"))
    assert max(found.values()) == 1
    assert {p for lang, text in learned if lang == "cc" for p in list(language_id.pieces(language_id.plain(text)))[:-1]} <= set(found)


def test_language_dictionaries_are_of_whole_texts(spark):
    notice = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} shown before everything" for i in range(60)) + " "
    mine = lambda rows: [(lang, notice + text) for lang, text in rows]
    learned = mine(languages_corpus({"aa": 700, "bb": 700, "cc": 100}))
    right, _ = right_of(spark, learned, mine(languages_corpus({"aa": 40, "bb": 40, "cc": 40})))
    assert all(right[lang] >= 38 for lang in ("aa", "bb", "cc"))
    # A language of one long text has all of it.
    long = " ".join(x[1] for x in languages_corpus({"cc": 60}))
    _, model = right_of(spark, [*languages_corpus({"aa": 700}), ("cc", long)], languages_corpus({"aa": 1}))
    assert sorted(model.contents["cc"].split()) == sorted(w for x in {p for p in language_id.pieces(language_id.plain(long))} for w in x.split())


def test_language_pieces_cover_the_text():
    for text in ("", "one", "x" * 1000, " ".join("ab cd ef gh".split() * 200), "日本語テキスト。한국어 текст " * 50):
        letters = language_id.plain(text)
        assert b"".join(language_id.pieces(letters)).replace(b" ", b"") == letters.replace(b" ", b"")


def test_language_identification_edge_cases(spark):
    schema = "doc_id long, text string, lang string"
    odd = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "12 !? 34", None), (None, "abc", None), (4, "long word " * 5000, "aa"), (4, "long word " * 5000, "aa")], schema)
    model = language_id.fit(odd)
    assert {(x.doc_id, x.lang_pred) for x in language_id.identify(odd, model).collect()} == {(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (4, "aa")}
    nothing = language_id.fit(spark.createDataFrame([], schema))
    assert {x.lang_pred for x in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize(("text", "letters"), [("½", False), ("² ①", False), ("Ⅷ", False), ("_9", False), ("́", False), ("", False), ("½ a", True), ("日", True), ("ª", True), ("ʰ", True)])
def test_language_letters_are_those_of_the_category(spark, text, letters):
    import unicodedata

    assert letters == any(unicodedata.category(c)[0] == "L" for c in text)
    model = language_id.CompressionClassifier({"en": b"one language and its words", "de": b"eine andere Sprache hat andere"})
    assert (model.classify(text.encode())[0] != "und") == letters


def test_a_language_of_two_letters_stays(spark):
    docs = spark.createDataFrame([(1, "the words of one language", "en"), (2, "ab", "xx"), (3, "½", "yy")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert set(model.contents) == {"en", "xx", "yy"}
    assert min(map(len, model.contents.values())) >= language_id.LEAST_BYTES
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs.where("doc_id <> 2"), model).collect()} == {1: "en", 3: "und"}


def test_language_ties_clashing_columns_and_long_texts(spark):
    """Languages with the same dictionary tie: that of more texts wins, then the lesser name; names of columns don't matter."""
    texts = ["ein text der beiden gehört", "noch einer davon"]
    rows = [(i, t, lang) for i, (lang, t) in enumerate([("zz", t) for t in texts] + [("aa", t) for t in texts] + [("mm", t) for t in [*texts, "!"]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"hash": F.lit("x"), "score": F.lit(1), "n": F.lit(2), "each": F.lit(3), "chance": F.lit("c")})
    model = language_id.fit(docs)
    assert list(model.contents) == ["mm", "aa", "zz"]
    out = language_id.identify(docs, model).collect()
    assert {x.lang_pred for x in out if x.doc_id != 6} == {"mm"}
    long = spark.createDataFrame([(1, "noch einer davon " * 60_000)], "doc_id long, text string")
    assert [x.lang_pred for x in language_id.identify(long, model).collect()] == ["mm"]


def test_many_languages_share_the_bytes(spark):
    """Six hundred languages, more than fit in 200 kB with whole dictionaries: each keeps its own words."""
    rows = [(i, " ".join(f"{'abcdefghijklmnopqrstuvwxy'[n % 25]}{'abcdefghijklmnopqrstuvwxyz'[n // 25]}{x}" * 2 for x in "pqrstuvwxyz" for _ in range(2)), f"l{n:03}") for i, n in enumerate([*range(600)] * 2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), all_bytes=200_000)
    assert len(model.contents) == 600 and sum(map(len, model.contents.values())) <= 200_000
    few = rows[:600:60]
    out = language_id.identify(spark.createDataFrame([r[:2] for r in few], "doc_id long, text string"), model).collect()
    assert {x.doc_id: x.lang_pred for x in out} == {i: lang for i, _, lang in few}


def brute_dictionaries(docs, room=192 << 10):
    """Dictionaries by their definition: pieces of each language's distinct texts, without those that others have, in the order of hashes."""
    own = {}
    for _, text, lang in docs:
        if text is not None and lang is not None:
            own.setdefault(lang, {}).update({language_id.piece_hash(x): x for x in language_id.pieces(language_id.plain(text))})
    out = {}
    for lang, held in own.items():
        alone = {k: x for k, x in held.items() if not any(k in o for name, o in own.items() if name != lang)}
        size = lambda d: sum(len(x) + 1 for x in d.values())
        used = alone if 2 * size(alone) >= size(held) or size(alone) >= room else held
        out[lang] = b"\n".join(used[k] for k in sorted(used))
    return out


def test_language_query_is_brute_force(spark):
    """Dictionaries and choices against their definition, each block compressed by itself with a compressor of its own, texts of all lengths."""
    import zstandard

    r = random.Random(12)
    docs = [(i, text if i % 3 else text[: r.randrange(1, 30)], lang) for i, (lang, text) in enumerate(languages_corpus({"aa": 30, "bb": 20, "cc": 10}))]
    docs += [(100 + n, " ".join(x[1] for x in docs[:n]), "aa") for n in (2, 3, 20)] + [(200, None, "aa"), (201, "12", "bb")]
    schema = "doc_id long, text string, lang string"
    model = language_id.fit(spark.createDataFrame(docs, schema))
    want = brute_dictionaries(docs)
    assert model.contents == want
    order = list(model.contents)
    how = zstandard.ZstdCompressionParameters(**language_id.PARAMETERS)
    for x in language_id.identify(spark.createDataFrame(docs, schema), model).collect():
        text = language_id.plain(dict((i, t) for i, t, _ in docs)[x.doc_id] or "")
        if not re.search(rb"[^ ]", text):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        sizes = []
        for lang in order:
            raw = zstandard.ZstdCompressionDict(want[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress(text[k : k + 4096])) for k in range(0, len(text), 4096)))
        best, second = sorted(sizes)[:2]
        assert x.lang_pred == order[sizes.index(best)]
        assert x.score == pytest.approx(1 - math.exp(-60 * (1 - best / second)))
        assert x.rejected == (1 - best / second < 0.01)
