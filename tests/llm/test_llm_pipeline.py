"""The stages in order, each against a plain version on its own input."""

import brute
from pyspark.sql import functions as F
from test_near_copies import classes as near_classes

import corpus_pipeline
from riskscope.llm.decontaminate import MIN_SHARE, SPAN
from riskscope.llm.queries import tokenizer
from riskscope.llm.tokens import library
from riskscope.session import materialise


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    before, outs = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, sf_dir))
        assert after.columns == columns
        outs.append((rows(before), rows(after)))
        before = after
    (_, kept), (_, thin), (seen, single), (_, clean) = outs
    assert all(not brute.quality_counts(t)[5] for _, t in kept)
    assert dict(thin) == brute.without_recurring(kept)
    assert [d for d, _ in single] == sorted(set(near_classes(seen).values()))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert clean == [(d, t) for d, t in single if not brute.contaminated(t, items, SPAN, MIN_SHARE)]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect())
    assert got == sorted(brute.pieces(clean, library(tokenizer())))


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None), (1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "word " * 40000, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("line", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
