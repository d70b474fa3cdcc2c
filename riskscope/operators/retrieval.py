"""Exact retrieval over the chunk table: nearest vectors, name lookups, their combination."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.functions import vectors
from riskscope.llm.words import slices
from riskscope.operators import pruned_search
from riskscope.scaling import checked_position, join_on
from riskscope.session import materialise

# How many chunks are retrieved, and the filter on those of other classes.
DEFAULT_LIMIT = 8
LIMIT_WITH_CLASS = 6
LIMIT_WITHOUT_CLASS = 10
TEMPLATE_LIMIT_WITH_CLASS = 3
TEMPLATE_LIMIT_WITHOUT_CLASS = 5
MIN_SECONDARY_SIMILARITY = 0.65
MAX_SECONDARY = 3
TEMPLATE_TYPE = "template_info"

# Framework classes that are never looked up.
IGNORED_CLASSES = ["Request", "Response", "AbstractController", "Yaml", "EntityManager", "FormView"]

# Scores of a nearest-neighbour join that a task holds at a time, and how many share a maximum.
SCORE_CELLS = 1 << 20
SCORE_GROUP = 32


@dataclass(frozen=True)
class ChunkColumns:
    """Names of the chunk table's columns."""

    id: str = "chunk_id"
    project: str = "project_id"
    type: str = "chunk_type"
    class_name: str = "class_name"
    content: str = "content"
    embedding: str = "embedding"


def similarity_to(query: Sequence[float], embedding: Column) -> Column:
    """Cosine similarity to a query vector, its length taken once on the driver.

    A stored vector of another size is an error, not a miss.
    """
    length = float(np.linalg.norm(np.asarray(query, dtype="float64")))
    product = vectors.dot(embedding, vectors.literal_vector(query))
    wrong = F.raise_error(F.concat(F.lit(f"the query has {len(query)} elements, a stored vector "), F.size(embedding).cast("string")))
    return (
        F.when(embedding.isNull(), F.lit(None).cast("double"))
        .when(F.size(embedding) != len(query), wrong.cast("double"))
        .otherwise(F.try_divide(product, vectors.norm(embedding) * F.lit(length)))
    )


def top_k(
    chunks: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_LIMIT,
    project: str | None = None,
    cols: ChunkColumns = ChunkColumns(),
) -> DataFrame:
    """The k nearest chunks by cosine distance, ties by id.

    The project filter prunes partitions; the limit is a distributed top-k, so no sort of
    the whole table takes place. Null and zero vectors have no distance and are left out.
    """
    scoped = chunks if project is None else chunks.where(F.col(cols.project) == project)
    scored = scoped.withColumn("similarity", similarity_to(query, F.col(cols.embedding)))
    return (
        scored.where(F.col("similarity").isNotNull())
        .drop(cols.embedding)
        .orderBy(F.col("similarity").desc(), F.col(cols.id))
        .limit(k)
    )


def _parts(
    queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, project: str, chunk_id: str, embedding: str
) -> tuple[DataFrame, DataFrame]:
    # Floats stay floats until a task scores them in doubles.
    floats = {queries.schema[query_vector].dataType.simpleString(), corpus.schema[embedding].dataType.simpleString()} == {"array<float>"}
    kind = "array<float>" if floats else "array<double>"
    q = queries.select(
        F.col(project).alias("project"), F.col(query_id).alias("qid"), F.col(query_vector).cast(kind).alias("vector")
    )
    c = corpus.select(F.col(project).alias("project"), F.col(chunk_id).alias("cid"), F.col(embedding).cast(kind).alias("vector"))
    return q, c


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    project: str = "project_id",
    chunk_id: str = "chunk_id",
    embedding: str = "embedding",
    cell_rows: int = pruned_search.CELL_ROWS,
) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): k nearest chunks of the same project per query.

    Exact: chunks lie in cells around centroids of their project, and a query visits only the
    cells that its k-th similarity so far does not rule out, see `pruned_search`. Ties of 12
    digits go to the smaller id.
    """
    q, c = _parts(queries, corpus, query_id, query_vector, project, chunk_id, embedding)
    found, _ = pruned_search.pruned_neighbours(q, pruned_search.build_cells(c, cell_rows), k, _cell_nearest)
    return found.select(F.col("qid").alias(query_id), F.col("cid").alias(chunk_id), "similarity", "rank")


def knn_probe(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    probes: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    project: str = "project_id",
    chunk_id: str = "chunk_id",
    embedding: str = "embedding",
    cell_rows: int = pruned_search.CELL_ROWS,
) -> DataFrame:
    """As `knn_join`, from the `probes` nearest cells only: approximate, and bounded work per query."""
    q, c = _parts(queries, corpus, query_id, query_vector, project, chunk_id, embedding)
    found = pruned_search.probe(q, pruned_search.build_cells(c, cell_rows), k, _cell_nearest, probes)
    return found.select(F.col("qid").alias(query_id), F.col("cid").alias(chunk_id), "similarity", "rank")


def _best_of(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, chunk row, similarity) of the k best chunks of each query; chunk rows are in id order."""
    scores = np.round(q @ c.T, 12)
    if k < len(c):
        least = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], scores[row, col][place < k]


def _few_copies(c: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have k equal ones before them, which no query has among its k best."""
    if len(c) <= k:
        return np.arange(len(c))
    kind = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(kind, kind="stable")
    place = np.arange(len(c)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[place < k])


def _best_above(
    q: np.ndarray, c: np.ndarray, c32: np.ndarray, k: int, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_best_of`, without rows under `least` (NaN: no such bound).

    Scores in single precision, off by less than `margin` for rows of length one, only tell which
    pairs cannot be among the best; the others are scored again in doubles. The k-th best of the
    maxima of groups is a bound, as each group has a row that reaches its maximum.
    """
    width = len(c) // SCORE_GROUP
    if width >= 4 * k:
        margin = (c.shape[1] + 8) * 2.0**-24
        scores = q.astype(np.float32) @ c32.T
        grouped = scores[:, : SCORE_GROUP * width].reshape(len(q), SCORE_GROUP, width)
        tops = grouped.max(axis=1)
        bound = np.partition(tops, width - k, axis=1)[:, width - k] - 2 * margin
        bound = np.fmax(bound, least - margin).astype(np.float32)
        # A NaN, from a vector of infinite length, makes no bound.
        if np.isfinite(tops).all():
            at, group = np.divmod(np.flatnonzero(tops >= bound[:, None]), width)
            hit, turn = np.nonzero(grouped[at, :, group] >= bound[at][:, None])
            rest, last = np.nonzero(scores[:, SCORE_GROUP * width :] >= bound[:, None])
            row = np.concatenate([at[hit], rest])
            col = np.concatenate([turn * width + group[hit], last + SCORE_GROUP * width])
            if len(row) <= scores.size // 16:
                score = np.round(np.einsum("ij,ij->i", q[row], c[col]), 12)
                order = np.lexsort((col, -score, row))
                order = order[~(score < least[row])[order]]
                row, col, score = row[order], col[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                return row[best], col[best], score[best]
    row, col, score = _best_of(q, c, k)
    kept = ~(score < least[row])
    return row[kept], col[kept], score[kept]


def _cell_nearest(k: int, query_id: str, chunk_id: str) -> Callable:
    """Folds sorted rows: the chunks of a place, then the queries that visit it, a few in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, units, matrix, single = None, [], [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "slot", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, to in pairwise([0, *cuts.tolist(), len(keys)] if len(keys) else []):
                part, (*here, side) = batch.slice(at, to - at), keys[at].tolist()
                if place != here:
                    place, ids, units, matrix = here, [], [], None
                if side == 0:
                    unit, live = pruned_search.unit_rows(part.column("vector"))
                    ids.append(part.column("cid").filter(pa.array(live)))
                    units.append(unit[live])
                    continue
                if matrix is None and units:
                    matrix, ids = np.concatenate(units), pa.concat_arrays(ids)
                    few = _few_copies(matrix, k)
                    matrix, ids, units = matrix[few], ids.take(pa.array(few)), []
                    single = matrix.astype(np.float32)
                names = part.column("qid").flatten()
                kind = part.schema.field("vector").type.value_type.to_pandas_dtype()
                unit, _ = pruned_search.unit_matrix(np.frombuffer(b"".join(part.column("packed").to_pylist()), kind), len(names))
                least = part.column("least").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if matrix is None or not len(matrix):
                    continue
                step = max(1, SCORE_CELLS // len(matrix))
                for start in range(0, len(unit), step):
                    row, col, score = _best_above(unit[start : start + step], matrix, single, k, least[start : start + step])
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(start + row)), ids.take(pa.array(col)), pa.array(score)], [query_id, chunk_id, "similarity"]
                    )

    return run


def ilike_lookup(chunks: DataFrame, name: str, project: str | None = None, cols: ChunkColumns = ChunkColumns()) -> DataFrame:
    """Chunks whose class name contains `name`, ignoring case; `%` and `_` act as wildcards."""
    scoped = chunks if project is None else chunks.where(F.col(cols.project) == project)
    return scoped.where(F.col(cols.class_name).ilike(f"%{name}%")).drop(cols.embedding)


def request_candidates(
    chunks: DataFrame,
    query: Sequence[float],
    template_query: Sequence[float],
    class_name: str | None,
    limit: int,
    template_limit: int,
    cols: ChunkColumns = ChunkColumns(),
) -> DataFrame:
    """(kind, similarity, chunk columns…) of one request: 0 name hits, 1 nearest chunks, 2 nearest for the template query.

    Two scans of the corpus: the vectors give the few nearest ids of both queries, then their
    texts and those of the name hits are read together. The result is stored, so what is built
    on it does not go back to the corpus.
    """
    scores = chunks.select(
        F.col(cols.id).alias("__id"),
        F.posexplode(
            F.array(similarity_to(query, F.col(cols.embedding)), similarity_to(template_query, F.col(cols.embedding)))
        ).alias("__query", "__similarity"),
    ).where(F.col("__similarity").isNotNull())
    nearest = Window.partitionBy("__query").orderBy(F.col("__similarity").desc(), "__id")
    ranked = scores.withColumn("__rank", F.row_number().over(nearest)).where(F.col("__rank") <= max(limit, template_limit))
    taken = F.when(F.col("__query") == 0, F.col("__rank") <= limit).otherwise(F.col("__rank") <= template_limit)
    # At most limit + template_limit rows.
    picked = ranked.where(taken).groupBy("__id").agg(
        F.collect_list(F.struct((F.col("__query") + 1).alias("kind"), F.col("__similarity").alias("similarity"))).alias("__picks")
    )
    named = F.col(cols.class_name).ilike(f"%{class_name}%") if class_name else F.lit(False)
    own = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0.0).alias("similarity")))
    nothing = F.array().cast("array<struct<kind: int, similarity: double>>")
    both = chunks.select(*_result(cols)).join(F.broadcast(picked), F.col(cols.id) == F.col("__id"), "left")
    kinds = F.concat(F.when(named, own).otherwise(nothing), F.coalesce("__picks", nothing))
    return materialise(both.select(F.explode(kinds).alias("__k"), *_result(cols)).select("__k.*", *_result(cols)))


def merge_direct_hits(hits: DataFrame, direct: DataFrame, cols: ChunkColumns = ChunkColumns()) -> DataFrame:
    """Name-lookup chunks whose content was not retrieved yet, put in front in reverse id order.

    Both sides carry (`priority`, `place`) afterwards: sort on them to read the list. Ids may
    be numbers or strings. `hits` holds at most k rows, so it is the broadcast side of the
    anti join.
    """
    new = direct.join(F.broadcast(hits.select(cols.content)), cols.content, "left_anti").select(*_result(cols))
    front = checked_position(new, [], [F.col(cols.id).desc()], "place").select(
        F.lit(0).alias("priority"), "place", *_result(cols), F.lit(0.0).alias("similarity")
    )
    ranked = hits.select(
        F.lit(1).alias("priority"),
        F.row_number().over(Window.orderBy(F.col("similarity").desc(), F.col(cols.id))).cast("long").alias("place"),
        *_result(cols),
        "similarity",
    )
    return front.unionByName(ranked)


def append_template_hits(context: DataFrame, templates: DataFrame, cols: ChunkColumns = ChunkColumns()) -> DataFrame:
    """Template hits (at most k rows) not in the context yet, at the end, if any chunk renders a page."""
    lowered = F.lower(cols.content)
    renders = context.where(lowered.contains("render") | lowered.contains("template:"))
    needed = templates.where(renders.select(F.lit(1)).exists())
    seen = context.join(F.broadcast(templates.select(cols.content)), cols.content, "left_semi")
    new = needed.join(seen.select(cols.content).distinct(), cols.content, "left_anti")
    tail = new.select(
        F.lit(2).alias("priority"),
        F.row_number().over(Window.orderBy(F.col("similarity").desc(), F.col(cols.id))).cast("long").alias("place"),
        *_result(cols),
        "similarity",
    )
    return context.unionByName(tail)


def _result(cols: ChunkColumns) -> list[str]:
    return [cols.id, cols.type, cols.class_name, cols.content]


def filter_by_class(
    context: DataFrame,
    class_name: str,
    order: Sequence[str] = ("priority", "place"),
    min_similarity: float = MIN_SECONDARY_SIMILARITY,
    max_secondary: int = MAX_SECONDARY,
    cols: ChunkColumns = ChunkColumns(),
) -> DataFrame:
    """Chunks that mention the class, then at most three very similar others that are not templates."""
    mentions = F.lower(cols.content).contains(class_name.lower())
    primary = context.where(mentions).withColumn("is_secondary", F.lit(False))
    secondary = (
        context.where(
            ~mentions
            & (F.coalesce(F.col(cols.type), F.lit("")) != TEMPLATE_TYPE)
            & (F.col("similarity") >= min_similarity)
        )
        .orderBy(*order)
        .limit(max_secondary)
        .withColumn("is_secondary", F.lit(True))
    )
    return primary.unionByName(secondary)


def hybrid_context(
    chunks: DataFrame,
    query: Sequence[float],
    template_query: Sequence[float],
    project: str | None = None,
    class_name: str | None = None,
    cols: ChunkColumns = ChunkColumns(),
    min_similarity: float = MIN_SECONDARY_SIMILARITY,
) -> DataFrame:
    """Context of one request: nearest chunks, name hits in front, template hits behind, filtered."""
    scoped = chunks if project is None else chunks.where(F.col(cols.project) == project)
    limit = LIMIT_WITH_CLASS if class_name else LIMIT_WITHOUT_CLASS
    template_limit = TEMPLATE_LIMIT_WITH_CLASS if class_name else TEMPLATE_LIMIT_WITHOUT_CLASS
    found = request_candidates(scoped, query, template_query, class_name, limit, template_limit, cols)
    of = lambda kind: found.where(F.col("kind") == kind).drop("kind")
    context = append_template_hits(merge_direct_hits(of(1), of(0), cols), of(2), cols)
    if class_name:
        return filter_by_class(context, class_name, min_similarity=min_similarity, cols=cols)
    return context.withColumn("is_secondary", F.lit(False))


def class_references(code: Column) -> Column:
    """Distinct classes a code block refers to, framework classes left out."""
    static = F.regexp_extract_all(code, F.lit(r"([A-Z][a-zA-Z0-9]+)::class"), 1)
    injected = F.regexp_extract_all(
        code, F.lit(r"(?U)private\s+(?:readonly\s+)?([A-Z][a-zA-Z0-9]+)\s+\$"), 1
    )
    return F.array_except(F.array_distinct(F.concat(static, injected)), F.array(*map(F.lit, IGNORED_CLASSES)))


def related_classes(
    blocks: DataFrame, chunks: DataFrame, block_id: str, code: str, cols: ChunkColumns = ChunkColumns()
) -> DataFrame:
    """(block_id, project, reference, chunk_id, content): first chunk of each class a block refers to.

    A class matches when its name contains the reference, ignoring case. Chunks are first
    reduced to one per class name; the names, not the chunks, are then expanded to their
    pieces of the lengths that occur, which makes the containment an equi-join.
    """
    references = (
        blocks.select(
            block_id, F.col(cols.project).alias("__project"), F.explode_outer(class_references(F.col(code))).alias("reference")
        )
        .where(F.col("reference").isNotNull())
        .withColumn("__piece", F.lower("reference"))
    )
    wanted = references.select("__project", "__piece").distinct()
    firsts = chunks.groupBy(F.col(cols.project).alias("__project"), F.lower(cols.class_name).alias("__name")).agg(
        F.min_by(F.struct(cols.id, cols.content), cols.id).alias("first")
    )
    # At most as many lengths as a name has letters, so one short row per project.
    lengths = wanted.groupBy("__project").agg(F.collect_set(F.length("__piece")).alias("__lengths"))
    name, length = F.col("__name"), F.length("__name")
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("__lengths", lambda n: n <= length),
                lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(name, i, n)),
            )
        )
    )
    matches = (
        firsts.join(lengths, "__project")
        .select("__project", "first", F.explode_outer(pieces).alias("__piece"))
        .join(wanted, ["__project", "__piece"])
        .groupBy("__project", "__piece")
        .agg(F.min("first").alias("first"))
    )
    return references.join(matches, ["__project", "__piece"]).select(
        block_id,
        F.col("__project").alias(cols.project),
        "reference",
        F.col(f"first.{cols.id}").alias(cols.id),
        F.col(f"first.{cols.content}").alias(cols.content),
    )


def embed(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], output: str = "embedding") -> DataFrame:
    """Add unit vectors of a text column from a user-supplied encoder; a null text is encoded as an empty one.

    A batch of any size is encoded in slices of bounded bytes, so a task holds few texts as objects at once.
    """

    def unit(texts: pa.Array) -> pa.Array:
        raw = np.asarray(encode(pc.fill_null(texts, "").to_pylist()), dtype="float32")
        length = np.linalg.norm(raw, axis=1, keepdims=True)
        values = (raw / np.where(length == 0, 1, length)).astype("float32")
        at = np.arange(len(values) + 1, dtype="int32") * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()))

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [unit(part.column(0)) for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(output, run(F.col(text)))


def hashing_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests: counts of words by the first hexadecimal digits of their md5."""
    import hashlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype="float32")
        for i, text in enumerate(texts):
            for word in text.split():
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % size] += 1.0
        return out

    return encode
