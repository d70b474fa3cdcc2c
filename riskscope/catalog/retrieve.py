"""Retrieval on embeddings and documents: project = language or label, class = source."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog import code_tables as ct
from riskscope.catalog.registry import register
from riskscope.catalog.tables import rounded, table
from riskscope.functions import vectors
from riskscope.operators import retrieval
from riskscope.sources.chunk_table import list_projects, project_stats, vector_violations


def chunks(spark, sf_dir):
    """Documents as chunks, with a vector where the embeddings table has one."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("project_id"),
        F.when(F.col("doc_id") % 9 == 0, "template_info").otherwise("controllers_method").alias("chunk_type"),
        F.col("source").alias("file_path"),
        F.concat(F.initcap("source"), F.lit("Controller")).alias("class_name"),
        F.col("text").alias("content"),
    )
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return documents.join(embeddings, "chunk_id", "left")


_CHUNKS = """
chunks AS (
  SELECT doc_id AS chunk_id, lang AS project_id, CASE WHEN doc_id % 9 = 0 THEN 'template_info' ELSE 'controllers_method' END AS chunk_type,
         source AS file_path, upper(source[1:1]) || lower(source[2:]) || 'Controller' AS class_name, text AS content, embedding::DOUBLE[] AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def vector_of(spark, sf_dir, vec_id: int) -> list[float]:
    """One stored vector, used as a query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return list(row[0])


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"


@register(
    "top_k",
    f"""SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q.format(3)}), 6) AS similarity
    FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q.format(3)}) DESC, vec_id LIMIT 8""",
)
def top_k(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return rounded(retrieval.top_k(corpus, vector_of(spark, sf_dir, 3)))


@register(
    "top_k_project",
    f"""SELECT vec_id AS chunk_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q.format(7)}), 6) AS similarity
    FROM embeddings WHERE label = 4
    ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q.format(7)}) DESC, vec_id LIMIT 10""",
)
def top_k_project(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    cols = retrieval.ChunkColumns(project="label")
    return rounded(retrieval.top_k(corpus, vector_of(spark, sf_dir, 7), 10, 4, cols))


@register(
    "knn_join",
    """WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings
                  WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS similarity
          FROM q JOIN embeddings e USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s)
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""",
)
def knn_join(spark, sf_dir):
    """Five neighbours of the first vector of each label, among the vectors of that label."""
    vectors_ = table(spark, sf_dir, "embeddings")
    first = vectors_.groupBy("label").agg(F.min("vec_id").alias("vec_id")).drop("label")
    queries = vectors_.join(first, "vec_id").select(
        F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector")
    )
    found = retrieval.knn_join(queries, vectors_, 5, project="label", chunk_id="vec_id")
    return rounded(found.withColumnRenamed("vec_id", "chunk_id"))


@register(
    "knn_join_all",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity
          FROM embeddings q JOIN embeddings e USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, chunk_id) AS rank FROM s)
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""",
)
def knn_join_all(spark, sf_dir):
    """Three neighbours of every vector, among the vectors of its label."""
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    found = retrieval.knn_join(queries, corpus, 3, project="label", chunk_id="vec_id")
    return rounded(found.withColumnRenamed("vec_id", "chunk_id"))


@register(
    "knn_probe_recall",
    """SELECT 5 * count(*) AS n_pairs, true AS reaches FROM embeddings""",
)
def knn_probe_recall(spark, sf_dir):
    """Recall of the approximate form on vectors without clusters: four fifths of some fifty cells, five neighbours of every vector."""
    corpus = table(spark, sf_dir, "embeddings").withColumn("project", F.lit("all"))
    queries = corpus.select(F.col("vec_id").alias("query_id"), "project", F.col("embedding").alias("query_vector"))
    rows = max(1, corpus.count() // 50)
    names = {"project": "project", "chunk_id": "vec_id", "cell_rows": rows}
    exact = retrieval.knn_join(queries, corpus, 5, **names).select("query_id", "vec_id", F.lit(1).alias("found"))
    near = retrieval.knn_probe(queries, corpus, 5, 40, **names).select("query_id", "vec_id", F.lit(1).alias("probed"))
    both = exact.join(near, ["query_id", "vec_id"], "left")
    return both.agg(F.count("found").alias("n_pairs"), (F.count("probed") >= 0.9 * F.count("found")).alias("reaches"))


@register(
    "normalise",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS squares, round(v[1] / n, 6) AS first
    FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v,
                 sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))) AS n FROM embeddings)""",
)
def normalise(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalise(tripled).alias("v"))
    return rounded(
        unit.select("vec_id", vectors.dot(F.col("v"), F.col("v")).alias("squares"), F.get("v", F.lit(0)).alias("first"))
    )


@register(
    "vector_violations",
    "SELECT vec_id, (63 + vec_id % 2)::INT AS size FROM embeddings WHERE vec_id % 2 = 0",
)
def violations(spark, sf_dir):
    cut = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), (63 + F.col("vec_id") % 2).cast("int")).alias("embedding")
    )
    return vector_violations(cut, 64).select("vec_id", F.size("embedding").alias("size"))


@register("list_projects", "SELECT DISTINCT lang AS project_id FROM documents")
def projects(spark, sf_dir):
    return list_projects(table(spark, sf_dir, "documents").withColumnRenamed("lang", "project_id"))


@register("project_stats", "SELECT lang AS project_id, count(*) AS chunks FROM documents GROUP BY lang")
def stats(spark, sf_dir):
    return project_stats(table(spark, sf_dir, "documents").withColumnRenamed("lang", "project_id"))


def _language(spark, sf_dir) -> str:
    """The first language by name."""
    return table(spark, sf_dir, "documents").agg(F.min("lang")).head()[0]


def _source(spark, sf_dir) -> str:
    return table(spark, sf_dir, "documents").agg(F.max("source")).head()[0]


@register(
    "ilike_lookup",
    f"""WITH {_CHUNKS} SELECT chunk_id, class_name FROM chunks
    WHERE project_id = (SELECT min(lang) FROM documents) AND class_name ILIKE '%' || (SELECT upper(max(source)) FROM documents) || '%'""",
)
def ilike_lookup(spark, sf_dir):
    name = _source(spark, sf_dir).upper()
    found = retrieval.ilike_lookup(chunks(spark, sf_dir), name, _language(spark, sf_dir))
    return found.select("chunk_id", "class_name")


# Context of one request. Contents repeat in the documents, so hits are told apart by content as well as by id.
_CONTEXT = f"""{_CHUNKS},
scoped AS (SELECT *, list_cosine_similarity(embedding, {_Q.format(5)}) AS s1, list_cosine_similarity(embedding, {_Q.format(11)}) AS s2
           FROM chunks WHERE project_id = (SELECT min(lang) FROM documents)),
hits AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, chunk_id) AS place FROM scoped WHERE s1 IS NOT NULL
         QUALIFY place <= 6),
direct AS (SELECT * FROM scoped WHERE class_name ILIKE '%' || (SELECT max(source) FROM documents) || '%'
           AND content NOT IN (SELECT content FROM hits)),
merged AS (SELECT 0 AS priority, row_number() OVER (ORDER BY chunk_id DESC) AS place, chunk_id, chunk_type, class_name, content, 0.0::DOUBLE AS similarity FROM direct
           UNION ALL SELECT 1, place, chunk_id, chunk_type, class_name, content, s1 FROM hits),
tpl AS (SELECT *, row_number() OVER (ORDER BY s2 DESC, chunk_id) AS place FROM scoped WHERE s2 IS NOT NULL QUALIFY place <= 3),
added AS (SELECT *, row_number() OVER (ORDER BY s2 DESC, chunk_id) AS p2 FROM tpl WHERE content NOT IN (SELECT content FROM merged)
          AND (SELECT count(*) FROM merged WHERE lower(content) LIKE '%render%' OR lower(content) LIKE '%template:%') > 0),
context AS (SELECT * FROM merged UNION ALL SELECT 2, p2, chunk_id, chunk_type, class_name, content, s2 FROM added)"""


def _request(spark, sf_dir):
    project = _language(spark, sf_dir)
    scoped = chunks(spark, sf_dir).where(F.col("project_id") == project)
    return scoped, vector_of(spark, sf_dir, 5), vector_of(spark, sf_dir, 11), _source(spark, sf_dir)


@register(
    "merge_direct_hits",
    f"WITH {_CONTEXT} SELECT priority, place, chunk_id, round(similarity, 6) AS similarity FROM merged",
)
def merge_direct_hits(spark, sf_dir):
    scoped, query, template_query, name = _request(spark, sf_dir)
    found = retrieval.request_candidates(scoped, query, template_query, name, 6, 3)
    merged = retrieval.merge_direct_hits(found.where("kind = 1"), found.where("kind = 0"))
    return rounded(merged.select("priority", "place", "chunk_id", "similarity"))


_STRING_IDS = _CONTEXT.replace("doc_id AS chunk_id", "'c' || doc_id AS chunk_id").replace("ON doc_id = vec_id", "ON doc_id = vec_id")


@register(
    "merge_direct_hits_string_ids",
    f"WITH {_STRING_IDS} SELECT priority, place, chunk_id, round(similarity, 6) AS similarity FROM merged",
)
def merge_direct_hits_string_ids(spark, sf_dir):
    """The same request on chunks whose ids are texts."""
    scoped, query, template_query, name = _request(spark, sf_dir)
    named = scoped.withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    found = retrieval.request_candidates(named, query, template_query, name, 6, 3)
    merged = retrieval.merge_direct_hits(found.where("kind = 1"), found.where("kind = 0"))
    return rounded(merged.select("priority", "place", "chunk_id", "similarity"))


_RENDERING = _CONTEXT.replace(
    "text AS content", "CASE WHEN doc_id % 2 = 0 THEN text || ' — Template: ' || source ELSE text END AS content"
)


def _rendering_request(spark, sf_dir):
    """The request on documents every second of which names its source and a template."""
    scoped, query, template_query, name = _request(spark, sf_dir)
    marked = F.when(
        F.col("chunk_id") % 2 == 0, F.concat("content", F.lit(" — Template: "), "file_path")
    ).otherwise(F.col("content"))
    return scoped.withColumn("content", marked), query, template_query, name


@register(
    "append_template_hits",
    f"WITH {_RENDERING} SELECT priority, place, chunk_id, round(similarity, 6) AS similarity FROM context",
)
def append_template_hits(spark, sf_dir):
    scoped, query, template_query, name = _rendering_request(spark, sf_dir)
    found = retrieval.request_candidates(scoped, query, template_query, name, 6, 3)
    merged = retrieval.merge_direct_hits(found.where("kind = 1"), found.where("kind = 0"))
    context = retrieval.append_template_hits(merged, found.where("kind = 2"))
    return rounded(context.select("priority", "place", "chunk_id", "similarity"))


@register(
    "filter_by_class",
    f"""WITH {_CHUNKS}, ranked AS (SELECT 1 AS priority, chunk_id AS place, *, list_cosine_similarity(embedding, {_Q.format(5)}) AS similarity FROM chunks),
    word AS (SELECT split_part(trim(text), ' ', 1) AS w FROM documents WHERE doc_id = 5),
    p AS (SELECT * FROM ranked WHERE contains(lower(content), lower((SELECT w FROM word)))),
    s AS (SELECT * FROM ranked WHERE NOT contains(lower(content), lower((SELECT w FROM word))) AND chunk_type <> 'template_info'
          AND similarity >= 0.2 ORDER BY priority, place LIMIT 3)
    SELECT chunk_id, false AS is_secondary FROM p UNION ALL SELECT chunk_id, true FROM s""",
)
def filter_by_class(spark, sf_dir):
    """Documents mentioning the first word of document 5, then three others near its vector."""
    scored = chunks(spark, sf_dir).select(
        F.lit(1).alias("priority"), F.col("chunk_id").alias("place"), "*",
        retrieval.similarity_to(vector_of(spark, sf_dir, 5), F.col("embedding")).alias("similarity"),
    )
    text = table(spark, sf_dir, "documents").where("doc_id = 5").select(F.trim("text")).head()[0]
    kept = retrieval.filter_by_class(scored, text.split(" ")[0], min_similarity=0.2)
    return kept.select("chunk_id", "is_secondary")


@register(
    "hybrid_context",
    f"""WITH {_RENDERING}, word AS (SELECT lower(max(source)) AS w FROM documents),
    p AS (SELECT *, false AS is_secondary FROM context WHERE contains(lower(content), (SELECT w FROM word))),
    s AS (SELECT *, true AS is_secondary FROM context WHERE NOT contains(lower(content), (SELECT w FROM word))
          AND chunk_type <> 'template_info' AND similarity >= 0.2 ORDER BY priority, place LIMIT 3)
    SELECT priority, place, chunk_id, is_secondary, round(similarity, 6) AS similarity FROM (SELECT * FROM p UNION ALL SELECT * FROM s)""",
)
def hybrid_context(spark, sf_dir):
    scoped, query, template_query, name = _rendering_request(spark, sf_dir)
    context = retrieval.hybrid_context(scoped, query, template_query, class_name=name, min_similarity=0.2)
    return rounded(context.select("priority", "place", "chunk_id", "is_secondary", "similarity"))


_BLOCK = "'private readonly Part' || (s_suppkey % 97) || ' $a; $x = PART' || s_suppkey || 'Controller::class; Request::class; private Part' || (s_suppkey % 7) || 'Con $b; Nope::class'"


@register(
    "related_classes",
    f"""WITH b AS (SELECT s_suppkey, unnest(['Part' || (s_suppkey % 97), 'PART' || s_suppkey || 'Controller', 'Part' || (s_suppkey % 7) || 'Con']) AS reference FROM supplier),
    c AS (SELECT p_partkey AS chunk_id, {ct.CLASS} AS class_name FROM part),
    m AS (SELECT b.*, chunk_id, class_name, row_number() OVER (PARTITION BY s_suppkey, reference ORDER BY chunk_id) AS n
          FROM (SELECT DISTINCT * FROM b) b JOIN c ON class_name ILIKE '%' || reference || '%')
    SELECT s_suppkey, reference, chunk_id, 'La classe ' || class_name AS content FROM m WHERE n = 1""",
)
def related_classes(spark, sf_dir):
    """First chunk of each class that a supplier's code block refers to."""
    blocks = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'shop' AS project_id", f"{_BLOCK} AS code")
    corpus = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS chunk_id", "'shop' AS project_id", f"{ct.CLASS} AS class_name", f"'La classe ' || {ct.CLASS} AS content"
    )
    found = retrieval.related_classes(blocks, corpus, "s_suppkey", "code")
    return found.select("s_suppkey", "reference", "chunk_id", "content")


@register(
    "embed",
    """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM documents),
    s AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 7))::BIGINT % 64 AS slot, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
    l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM s GROUP BY doc_id)
    SELECT d.doc_id, 64 AS size, round(coalesce(max(n / length) FILTER (slot = 7), 0.0), 4) AS slot_7,
        round(coalesce(max(n / length), 0.0), 4) AS largest FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
)
def embed(spark, sf_dir):
    """Vectors of whole document texts from the hashing encoder."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = retrieval.embed(documents, "text", retrieval.hashing_encoder())
    return out.select(
        "doc_id",
        F.size("embedding").alias("size"),
        F.round(F.get("embedding", F.lit(7)).cast("double"), 4).alias("slot_7"),
        F.round(F.array_max("embedding").cast("double"), 4).alias("largest"),
    )
