"""What the near-copy classes leave behind, and that passes and trial pieces change no class."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from riskscope import session
from riskscope.llm import fragment_join, near_copies


def long_texts():
    """(id, text): families of long texts at growing distance, and strangers that share a passage with them."""
    r = random.Random(7)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for family in range(6):
        base = words(400)
        rows.append(base)
        for changed in (1, 3, 8, 20, 60):
            other = list(base)
            for i in r.sample(range(400), changed):
                other[i] = f"x{r.randrange(10**6)}"
            rows.append(other)
        rows.append(base[:40] + words(360))
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def expected(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return sorted(label.items())


@pytest.mark.parametrize("trial", [2, 8, 64])
def test_a_trial_finds_the_same_links(spark, trial):
    rows = long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "__text")
    found = near_copies._prefixes(docs, "doc_id", 5, 80)
    profiles = session.materialise(found.select("s", "n", "sizes", "digests"))
    u, v = (profiles.select(F.col("s").alias(x)) for x in "uv")
    pairs = session.materialise(u.join(v, F.col("u") < F.col("v")))
    links = fragment_join.verified_links(pairs, profiles, docs, "__text", 5, 80, trial)
    ids = found.select("doc_id", "s")
    named = links.join(ids.toDF("a", "u"), "u").join(ids.toDF("b", "v"), "v").select(F.least("a", "b"), F.greatest("a", "b"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(map(tuple, named.collect())) == near


def test_passes_change_no_class_and_tables_go(spark, monkeypatch):
    rows = long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "PASS_RUNS", 600)
    monkeypatch.setattr(near_copies, "TRIAL", 4)
    before = len(session._WRITTEN)
    classes = near_copies.near_copy_classes(docs)
    assert sorted(map(tuple, classes.collect())) == expected(rows)
    # The result, and the last labels of two rounds of components.
    assert len(session._WRITTEN) - before <= 3


def test_a_stored_table_leaves_no_shuffle_and_can_go(spark):
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = kept()
    stored = session.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept() <= before and stored.count() == 7
    path = stored._scratch.removeprefix("file:")
    assert glob.glob(f"{path}/part-*")
    session.release(stored)
    assert not glob.glob(f"{path}*") and stored._scratch not in session._WRITTEN
