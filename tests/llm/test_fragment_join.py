"""The n-gram join against the similarity of all pairs."""

import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskscope.llm import fragment_join, queries
from riskscope.llm.words import slices


def shingles(text):
    w = [x.encode().lower().decode() for x in brute.words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def similar(a, b, percent=90):
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def classes(docs, percent=90):
    """(doc_id, n_shingles, component_id) by all pairs of different sets; ids are different."""
    sets = {d: shingles(t) for d, t in docs}
    distinct = sorted({s for s in sets.values() if s}, key=len)
    links = []
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if percent * len(b) > 100 * len(a):
                break
            if similar(a, b, percent):
                links.append((a, b))
    names = {s: k for k, s in enumerate(distinct)}
    label = brute.components(range(len(distinct)), [(names[a], names[b]) for a, b in links])
    least = {}
    for d, s in sets.items():
        if s:
            c = label[names[s]]
            least[c] = min(least.get(c, d), d)
    return sorted((d, len(s), least[label[names[s]]] if s else d) for d, s in sets.items())


def test_given_documents(spark, sf_dir):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op12_fragment_join"](spark, sf_dir).collect())
    assert got == classes(given)


def varied(seed, vocabulary, groups):
    """Texts of all sizes with word changes around the threshold, and groups whose middle alone links them."""
    rng = np.random.default_rng(seed)
    docs = []
    for g in range(groups):
        size = int(rng.integers(1, 60 if g % 2 else 300))
        base = [f"w{i}" for i in rng.integers(0, vocabulary, size)]
        for changes in (0, 0, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for at in rng.integers(0, size, changes):
                words[at] = f"n{rng.integers(0, 99999)}"
            docs.append(" ".join(words[: size - int(rng.integers(0, 3))]))
    base = [f"b{i}" for i in range(120)]
    for i in range(80):
        words = list(base)
        for at in rng.integers(0, 120, 2):
            words[at] = f"n{rng.integers(0, 99999)}"
        docs.append(" ".join(words))
    return docs


@pytest.mark.parametrize("percent", [90, 80])
def test_similar_sets_share_a_signature(percent):
    texts = varied(5, 40, 60) + [" ".join(f"t{i}" for i in range(k)) for k in range(9, 40)]
    h, first = fragment_join.shingle_sets(pa.array(texts))
    at, sigs = fragment_join.signatures(h, first, percent)
    sets = [set(h[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    own = [set(sigs[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and sets[i] != sets[j] and similar(sets[i], sets[j], percent):
                pairs += 1
                assert own[i] & own[j]
    assert pairs > 100


def test_size_classes():
    for percent in (90, 80, 50):
        lows = fragment_join.size_classes(2000, percent)
        of = lambda n: np.searchsorted(lows, n, "right") - 1
        assert all(of(100 * n // percent) - of(n) <= 1 for n in range(1, 2000))


@pytest.mark.parametrize("vocabulary", [12, 3000])
def test_all_similar_pairs_are_linked(spark, vocabulary):
    docs = list(enumerate(varied(vocabulary, vocabulary, 30)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in fragment_join.jaccard_classes(df).collect())
    assert got == classes(docs)
    assert len({r[2] for r in got}) < len(docs)


@pytest.mark.parametrize("crowd", [2, 8])
def test_crowded_signatures(spark, monkeypatch, crowd):
    """Groups of near copies of all distances to their text, beyond the size that is paired directly."""
    monkeypatch.setattr(fragment_join, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    base = [f"b{i}" for i in range(150)]
    texts = varied(crowd, 25, 8)
    for changes in [0, *range(1, 9)] * 12:
        words = list(base)
        for at in rng.integers(0, 150, changes):
            words[at] = f"n{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in fragment_join.jaccard_classes(df).collect()) == classes(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one "), (6, "ONE two"), (7, "one two"), (8, long), (9, long + " more")]
    rows += [(10, "É b c d"), (11, "é b c d"), (12, "é B C D"), (12, "é B C D"), (None, "one"), (None, None), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ["s", "n", "h", "k", "sigs", "label"]})
    got = sorted((tuple(r) for r in fragment_join.jaccard_classes(df).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 29998, 8), (9, 29999, 8)]
    want += [(10, 2, 10), (11, 2, 11), (12, 2, 11), (12, 2, 11), (None, 1, 4), (None, 0, None), (None, 1, None)]
    assert got == sorted(want, key=repr)
    assert fragment_join.jaccard_classes(df.limit(0)).count() == 0


def test_only_wanted_pieces_make_rows(spark):
    """Pieces outside the mask are dropped inside the row, before anything is exploded."""
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(text,), (text,), ("other words here",)], "text string")
    h, first = fragment_join.shingle_sets(pa.array([text]))
    key = int(fragment_join.set_keys(h, first).view(np.int64)[0])
    wanted = spark.createDataFrame([(key, 0b1010 | -(1 << 63))], "s long, mask long")
    found = fragment_join._contents(df, "text", 3, wanted)
    assert "posexplode" not in found._jdf.queryExecution().toString()
    pieces = {r.k: r.part for r in found.collect()}
    assert sorted(pieces) == [1, 3, 63] and found.count() == 3
    cuts = fragment_join._pieces(h, first)
    assert all(pieces[k] == h[cuts[k] : cuts[k + 1]].view(np.int64).tolist() for k in pieces)


def test_slices_take_little_memory():
    """A task of Python holds the arrays of one slice, tens of times its bytes."""
    texts = pa.array([" ".join(f"w{i % 999}" for i in range(2000))] * 400)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    tracemalloc.start()
    for part in slices([batch]):
        fragment_join.shingle_sets(part.column(0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64_000_000
