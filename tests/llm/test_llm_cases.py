"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.llm import (
    chat_events,
    components,
    decontaminate,
    html_wrapper,
    line_templates,
    masked_lm,
    packing,
    simhash_pivots,
    substring_dedup,
    token_counts,
    tokens,
    weak_quality,
)
from riskscope.llm.queries import tokenizer

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS * 60)
PASSAGE = " ".join(WORDS[:70])
DOCS = [
    (1, PASSAGE + " one", "a"),
    (2, "x " + PASSAGE + "\ttwo", "b"),
    (2, "x " + PASSAGE + "\ttwo", "b"),
    (3, None, "c"),
    (4, "", None),
    (5, " \n\t ", "d"),
    (6, LONG, "e"),
    (7, "short", "f"),
    (None, PASSAGE, "g"),
    (8, "é" * 50 + " ñandú œuvre 日本語 'S don't", "h"),
]
#: Names that the operators might use themselves.
CLASHING = "doc_id bigint, text string, __text string"
MORE = ["n", "fp", "bundle", "label", "pos", "key", "h", "line"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit(1) for c in MORE})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_substring_dedup(docs, nothing):
    got = rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    big = 1 << 62
    want = brute.substring_dedup([(d if d is not None else big, t) for d, t, _ in DOCS])
    assert got == sorted(((d if d != big else None, n, r) for d, n, r, _ in want), key=repr)
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window", [2, 5, 7])
def test_substring_dedup_small_windows(spark, window):
    rng = np.random.default_rng(window)
    data = [(i, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 30))))) for i in range(60)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string"), window=window)
    got = [(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in found.collect()]
    assert sorted(got) == sorted(brute.substring_dedup(data, window))


def test_token_counts(docs, nothing):
    library = tokens.library(tokenizer())
    got = rows(token_counts.token_counts(docs, tokenizer()), "doc_id", "n_tokens", "over_limit")
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    assert got == sorted(((d, count(t), count(t) > 2048) for d, t, _ in DOCS), key=repr)
    assert token_counts.token_counts(nothing, tokenizer()).count() == 0


def test_encoder_on_odd_texts():
    library, own = tokens.library(tokenizer()), tokens.part_ids(tokenizer())
    odd = ["don't I'LL ''s a's's", "x<|endoftext|>y <|EndOfText|> <| |>", "ñÑÀÿŸœ É éa 12½²", "ß'sẞ İI ΑΣ", "a\x1cb \x85 ​×÷", "日本語 ́b", "--''re'd"]
    for text in [*odd, " ".join(odd), "", "  "]:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(own.of(text)) == want


def test_packing(docs, nothing):
    got = packing.pack_documents(docs, tokenizer()).collect()
    want = brute.pieces([(d, t) for d, t, _ in DOCS], tokens.library(tokenizer()))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(nothing, tokenizer()).count() == 0


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_packing_keeps_every_capacity(score):
    rng = np.random.default_rng(1)
    histogram = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, 100, 60)}
    capacity = packing.Capacity(100, 4, 5000)
    histogram = {n: c for n, c in histogram.items() if n * n <= 5000}
    placed, bins = dict.fromkeys(histogram, 0), {}
    for run in packing.plan_runs(histogram, capacity, (1.0, 0.3, 0.5), score):
        for b in range(run.bins):
            bins.setdefault(run.first_bin + b, []).extend([run.length] * run.each)
        placed[run.length] += run.bins * run.each
    assert placed == histogram
    for held in bins.values():
        assert sum(held) <= 100 and len(held) <= 4 and sum(x * x for x in held) <= 5000
    with pytest.raises(ValueError):
        packing.plan_runs({101: 1}, capacity)


def test_packing_two_lengths_is_perfect():
    runs = packing.plan_runs({1500: 10, 548: 10, 1: 4096}, packing.Capacity())
    assert max(r.first_bin + r.bins for r in runs) == 12


def test_line_templates(spark, docs, nothing):
    lines = [(i, f"Own words of {'abcdefgh'[i % 8]}{i}x document\nServed in {i} ms by host h{i}\n\nkeep") for i in range(12)]
    df = spark.createDataFrame(lines + [(3, None), (99, "")], "doc_id bigint, text string").withColumn("line", F.lit("x"))
    out = {(r.doc_id, r.text) for r in line_templates.dedup_lines(df, min_docs=10).collect()}
    assert (0, lines[0][1]) in out and (3, None) in out and (99, "") in out
    dropped = line_templates.drop_recurring_lines(df, min_docs=10)
    assert {r.doc_id: r["__n_dropped"] for r in dropped.where("doc_id between 4 and 11").collect()} == dict.fromkeys(range(4, 12), 2)
    assert line_templates.dedup_lines(nothing).count() == 0
    assert line_templates.dedup_lines(docs).columns == docs.columns


def test_line_templates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c", "7x"], 5)) for _ in range(6))) for i in range(80)]
    gone = brute.recurring(data, 12)
    found = line_templates.recurring_lines(spark.createDataFrame(data, "doc_id bigint, text string"), min_docs=12, whole_fields=True)
    got = {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.count_distinct("line_hash").alias("n")).collect()}
    assert got == {d: len(v) for d, v in gone.items() if v}


def test_masked_lm_prefers_real_order(spark, sf_dir, nothing):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    held = docs.where("doc_id % 5 = 0 AND n_chars > 400") if "n_chars" in docs.columns else docs.where("doc_id % 5 = 0 AND length(text) > 400")
    training = docs.where("doc_id % 5 <> 0")
    shape = masked_lm.Shape(rounds=3, masked_percent=40)
    classes, inside = masked_lm.class_tables(masked_lm.word_counts(training, "text", shape), shape)
    net = masked_lm.Network(shape, masked_lm.train(training, "text", classes, shape))
    rng = np.random.default_rng(0)

    def score(texts):
        import pyarrow as pa

        t = decontaminate.Tokens.of(pa.array(texts))
        b = masked_lm._buckets(t, shape)
        at = np.arange(len(b))
        found = net.log_probability(masked_lm._contexts(t, b, at, shape), classes[b]) + inside[b]
        return np.bincount(t.text_of, found, minlength=len(texts)) / np.maximum(t.n_words, 1)

    texts = [r.text for r in held.limit(80).collect()]
    mixed = [" ".join(rng.permutation(other.split()[: len(t.split())])) for t, other in zip(texts, texts, strict=True)]
    foreign = ["".join(rng.permutation(list(t))) for t in texts]
    assert (score(texts) > score(foreign)).mean() >= 0.9
    assert score(texts).mean() >= score(mixed).mean()
    assert masked_lm.pseudo_likelihood(nothing).count() == 0


def test_masked_lm_cases(docs):
    got = rows(masked_lm.pseudo_likelihood(docs), "doc_id", "n_tokens", "log_likelihood")
    by = {r[0]: r[1:] for r in got}
    assert by[3] == (0, 0.0) and by[4] == (0, 0.0) and by[7][0] == 1 and by[7][1] < 0


def test_quality(docs, nothing):
    got = rows(weak_quality.quality_verdicts(docs), "doc_id", "n_words", "base_failed", "kept")
    assert (3, 0, True, False) in got and (7, 1, True, False) in got and len(got) == len(DOCS)
    assert weak_quality.quality_filter(docs).columns == docs.columns
    assert weak_quality.quality_verdicts(nothing).count() == 0 and weak_quality.quality_filter(nothing).count() == 0


def test_simhash(docs, nothing):
    got = {r[0]: r[1:] for r in rows(simhash_pivots.near_duplicate_classes(docs), "doc_id", "fingerprint", "component_id")}
    assert got[3] == got[4] == got[5] == ("0" * 16, 3)
    assert got[6] == (f"{brute.fingerprint(LONG):016x}", got[6][1])
    assert simhash_pivots.near_duplicate_classes(nothing).count() == 0
    kept = simhash_pivots.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() <= 1


@pytest.mark.parametrize("pair_group", [1, 3, 64])
def test_fingerprint_links_are_complete(spark, pair_group):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6).tolist()
    points = set(base)
    for b in base:
        for _ in range(40):
            points.add(b ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    points = sorted(points)
    links = [(a, b) for i, a in enumerate(points) for b in points[i + 1 :] if bin(a ^ b).count("1") <= 2]
    want = brute.components(points, links)
    df = spark.createDataFrame([(p,) for p in points], "fp bigint")
    labels = components.component_labels(simhash_pivots.fingerprint_links(df, pair_group))
    got = {p: p for p in points} | {r.node: r.label for r in labels.collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (n + 9, n + 7)], "u bigint, v bigint")
    got = {r.node: r.label for r in components.component_labels(df).collect()}
    assert got == dict.fromkeys(range(n + 1), 0) | {n + 7: n + 7, n + 9: n + 7}


@pytest.mark.parametrize("index_rows", [2_000_000, 0])
def test_decontamination(spark, docs, nothing, index_rows):
    items = [(1, " ".join(WORDS[10:50])), (2, "alpha beta, gamma delta epsilon zeta"), (3, None), (4, ""), (5, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1))
    changed = WORDS[10:50]
    for i in (7, 19, 30):
        changed[i] = "other"
    more = spark.createDataFrame(
        [(20, "pre " + " ".join(changed) + " post", "x"), (21, "so: Alpha  beta gamma; DELTA epsilon zeta.", "y"), (22, "one two", "z")],
        "doc_id bigint, text string, source string",
    ).withColumns({c: F.lit(1) for c in MORE})
    whole = docs.union(more)
    out = decontaminate.with_overlaps(whole, bench, index_rows=index_rows)
    got = sorted(((r.doc_id, [o.item_id for o in r["__overlaps"]]) for r in out.collect()), key=repr)
    texts = [t or "" for _, t in items]
    want = [
        (d, [items[k][0] for k in brute.contaminated(t, texts, decontaminate.SPAN, decontaminate.MIN_SHARE)])
        for d, t in [(d, t) for d, t, _ in DOCS] + [(r.doc_id, r.text) for r in more.collect()]
    ]
    assert got == sorted(want, key=repr) and (20, [1]) in got and (21, [2]) in got and (22, []) in got
    assert decontaminate.drop_contaminated(whole, bench).columns == whole.columns
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(whole, bench.limit(0)).count() == whole.count()


EVENTS = "conv_id bigint, seq bigint, message bigint, role string, kind string, text string"


def test_chat_folds_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "user", "delta", "hel"), (1, 1, 0, "user", "delta", "lo"),
        (1, 2, 1, "assistant", "delta", "bad "), (1, 3, 2, "user", "delta", "gone"),
        (1, 4, 1, "assistant", "regenerate", None), (1, 5, 1, "assistant", "delta", "[INST]<|end|>\n"),
        (1, 6, 1, "assistant", "delta", "&lt; | fine"), (1, 7, 0, "user", "edit", "hi"),
        (2, 0, 0, None, "delta", None), (None, 0, 0, "user", "delta", "x"),
    ]
    back = {r.conv_id: r for r in chat_events.read_back(chat_events.format_events(spark.createDataFrame(log, EVENTS))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hi"), ("assistant", "[INST]<|end|>\n&lt; | fine")]
    assert back[1].loss_text == "[INST]<|end|>\n&lt; | fine"
    assert [tuple(t) for t in back[2].turns] == [("", "")] and back[None].loss_text == ""
    assert chat_events.format_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_chat_ties_and_repeats(spark):
    data = [(1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a😀c"), (1, None, "user", None)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit(1))
    row = chat_events.read_back(chat_events.format_events(chat_events.stream_events(df))).head()
    assert [tuple(t) for t in row.turns] == [("user", ""), ("assistant", "a😀c"), ("assistant", "b"), ("assistant", "b")]
    assert row.loss_text == "a😀cbb"


SITE = (
    "<html><head><title>t{i}</title></head><body><div class='top-menu'><a href='#'>Home {i}</a></div><div id=cookie-notice>We use {i}</div>"
    "<header><h2>Site {i}</h2></header><div class=layout><div id='body-text'><h1>Head {i}</h1><p>First <b>bo</b>ld &amp; {i}<p>Second{more}</p>"
    "<div class='share'>Share {i}</div><form>Mail {i}<input></form></div><div class='sidebar'>Side {i}</div></div>"
    "<div class=comments><p>Reader {i}</p></div><footer>Foot {i}</footer></body></html>"
)


def test_pages(spark):
    pages = [(i, f"http://a.example/{i}", SITE.format(i=i, more=" long text" * i)) for i in range(5)]
    pages += [(10, "http://b.example/", SITE.format(i=9, more="")), (11, None, None), (12, "odd", ""), (13, "odd", "<p>plain < text")]
    pages += [(14, "http://a.example/0", pages[0][2]), (15, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_wrapper.main_texts(df).collect()}
    for i in range(5):
        assert got[i] == " ".join(f"Head {i} First bold & {i} Second{' long text' * i}".split())
    assert got[10] == "Head 9 First bold & 9 Second" and got[14] == got[0]
    assert got[11] == got[12] == "" and got[15] == "deep" and got[13].startswith("plain")
    assert html_wrapper.main_texts(df.limit(0)).count() == 0
