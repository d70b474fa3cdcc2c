"""Lines with many fields are templates too."""

from riskscope.llm import line_templates, queries

LINES = ["Page {i} of 10", "Copyright 2024 Acme", "(c) 2024 Acme Inc.", "Posted 2024-01-{i} by user{i}", "2024-01-02"]


def test_lines_of_many_fields_go(spark, tmp_path):
    texts = ["\n".join([f"own{chr(97 + i)} word", *[line.format(i=i) for line in LINES], f"{i} {i * 7}"]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_templates.dedup_lines(docs, whole_fields=True).collect()}
    # Own words and rows of different figures stay; the first document keeps all.
    assert got == {0: texts[0]} | {i: f"own{chr(97 + i)} word\n{i} {i * 7}" for i in range(1, 12)}
    few = line_templates.dedup_lines(docs.where("doc_id < 9"), whole_fields=True)
    assert {r.doc_id: r.text for r in few.collect()} == dict(enumerate(texts[:9]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op4_line_templates"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {0: 0} | dict.fromkeys(range(1, 12), 5)
