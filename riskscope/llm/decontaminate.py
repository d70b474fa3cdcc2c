"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over 13 consecutive tokens, or over a whole shorter item, that ignores
some of them. The span is cut into two blocks more than the rule below admits substitutions,
and each mask ignores as many blocks as there can be substitutions, so every pattern of
them leaves one mask untouched. The masked tokens of every position of every benchmark item
and of every document are hashed and joined. A hit fixes
the diagonal of an item in a document; around it the tokens are compared one by one, and the
document is contaminated where an aligned stretch of words agrees in at least 80 percent,
substitutions allowed. The stretch is `SPAN` words, or the whole item where it is shorter.

The index of the benchmark is counted first. Up to `INDEX_ROWS` seeds it is shipped to the
tasks, which look up whole slices of positions at once; a larger one is joined by the seed
hash, and the few documents with hits meet their items by id. Both ways give the same hits.

Tokens are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased, so
punctuation and spacing do not matter.

Defined cases: a null or empty text has no tokens and is clean; items without tokens match
nothing; items shorter than `SPAN` are matched whole, by the same share, where they have at
least `MIN_ITEM` tokens, and otherwise match nothing; repeated rows are judged each; null ids are
kept; further columns pass through the filter; empty tables give clean or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskscope.llm.words import Scan, mix, scan, slices
from riskscope.session import materialise

SPAN = 13
MIN_SHARE = 80
MIN_ITEM = 5
# Seeds of a shipped index: 16 bytes each with their item and position, 32 MB in all.
INDEX_ROWS = 2_000_000
MAX_SHIPPED_BYTES = 32 << 20

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_FOLD = np.where(_TOKEN, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32


class Tokens(Scan):
    """A scan whose words are the folded tokens."""

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        raw = scan(texts)
        return cls(_FOLD[raw.data], raw.text_at)

    def seeds(self, width: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of its first token) of each mask at each run of `width` tokens, in the texts `of` or in all."""
        at = self.windows(width)
        if of is not None:
            at = at[np.isin(self.text_of[at], of)]
        ends = blocks(width)
        part = [self.window_hash(at + a, b - a) for a, b in zip(ends, ends[1:])]
        hashes = []
        for k, kept in enumerate(masks(width)):
            h = np.full(len(at), 0x9E3779B97F4A7C15 + 256 * width + k, np.uint64)
            for j in kept:
                h = mix(h ^ part[j])
            hashes.append(h)
        return np.concatenate(hashes), np.tile(at, len(hashes))


def substitutions(width: int) -> int:
    """How many words of an aligned stretch may differ."""
    return width - -(-MIN_SHARE * width // 100)


def blocks(width: int) -> list[int]:
    """The borders of the blocks of a stretch, two more than words that may differ."""
    n = substitutions(width) + 2
    return [width * i // n for i in range(n + 1)]


def masks(width: int) -> list[tuple[int, ...]]:
    """The blocks that each mask keeps: all choices of two, as the others may hold a substitution each."""
    return list(combinations(range(len(blocks(width)) - 1), 2))


def _item_rows(ids: list, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item row, position in the item) of the seeds of benchmark items."""
    found = [tokens.seeds(SPAN)]
    for width in range(MIN_ITEM, SPAN):
        own = np.flatnonzero(tokens.n_words == width)
        if len(own):
            found.append(tokens.seeds(width, own))
    h, at = (np.concatenate([f[i] for f in found]) for i in range(2))
    rows = tokens.text_of[at]
    return h, rows, at - tokens.first[rows]


def _overlaps(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
    """The best aligned stretch of an item in a document over some diagonals: (first word, words, equal words)."""
    best = None
    for d in diagonals.tolist():
        a, b = max(d, 0), min(d + len(item), len(doc))
        span = min(SPAN, len(item))
        if b - a < span:
            continue
        equal = (doc[a:b] == item[a - d : b - d]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(equal)])
        inside = total[span:] - total[:-span]
        good = np.flatnonzero(100 * inside >= MIN_SHARE * span)
        if len(good):
            covered = np.zeros(b - a + 1, np.int64)
            np.add.at(covered, good, 1)
            np.add.at(covered, good + span, -1)
            on = np.cumsum(covered)[:-1] > 0
            found = (a + int(good[0]), int(on.sum()), int(equal[on].sum()))
            if best is None or found[2] > best[2]:
                best = found
    return best


def _verify(words: np.ndarray, hits: dict[int, set], items: dict[int, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(item, first word, words, equal words) of the items that overlap a document."""
    found = []
    for item, diagonals in sorted(hits.items()):
        got = _overlaps(words, items[item], np.array(sorted(diagonals)))
        if got:
            found.append((item, *got))
    return found


OVERLAP = "array<struct<item_row:bigint,start:bigint,n_words:bigint,n_equal:bigint>>"


class Index:
    """The seeds of the benchmark in arrays, with a bit table that turns most positions away."""

    def __init__(self, texts: list[str]):
        tokens = Tokens.of(pa.array(texts, pa.string()))
        h, self.rows, self.position = _item_rows(list(range(len(texts))), tokens)
        order = np.argsort(h)
        self.h, self.rows, self.position = h[order], self.rows[order], self.position[order]
        bits = max(16, min(26, int(len(h) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(h >> self.shift).astype(np.int64)] = True
        self.widths = sorted({int(n) for n in tokens.n_words if MIN_ITEM <= n < SPAN})
        first = tokens.first
        self.items = {i: tokens.word_hash[first[i] : first[i + 1]] for i in range(len(texts))}

    def lookup(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index entry, token index) of every hit."""
        maybe = self.table[(h >> self.shift).astype(np.int64)]
        h, at = h[maybe], at[maybe]
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return entry, np.repeat(at, n)

    def overlaps(self, tokens: Tokens) -> list[list[tuple[int, int, int, int]]]:
        """The overlaps of each text."""
        found = [self.lookup(*tokens.seeds(w)) for w in [SPAN, *self.widths]]
        entry, at = (np.concatenate([f[i] for f in found]) for i in range(2))
        out = [[] for _ in range(tokens.n_texts)]
        if not len(entry):
            return out
        text = tokens.text_of[at]
        diagonal = at - tokens.first[text] - self.position[entry]
        triples = np.unique(np.stack([text, self.rows[entry], diagonal]), axis=1)
        for t in np.unique(triples[0]).tolist():
            hits: dict[int, set] = {}
            for item, d in triples[1:, triples[0] == t].T.tolist():
                hits.setdefault(item, set()).add(d)
            out[t] = _verify(tokens.word_hash[tokens.first[t] : tokens.first[t + 1]], hits, self.items)
        return out


def _seed_rows(df: DataFrame, id_column: str, text: str, widths: list[int], items: bool) -> DataFrame:
    """(id, h, position) of the seeds of every row."""
    sent = df.select(F.col(id_column), F.col(text).alias("__text"))
    schema = sent.select(id_column, F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("position")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            tokens = Tokens.of(part.column("__text"))
            if items:
                h, row, position = _item_rows([], tokens)
            else:
                found = [tokens.seeds(w) for w in [SPAN, *widths]]
                h, at = (np.concatenate([f[i] for f in found]) for i in range(2))
                row = tokens.text_of[at]
                position = at - tokens.first[row]
            taken = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken, pa.array(h.view(np.int64)), pa.array(position)], [id_column, "h", "position"])

    return sent.mapInArrow(rows, schema)


def _joined_overlaps(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """(__row, overlaps) by a join on the seed hash, for an index too large to ship.

    Items are shuffled by hash with the document seeds; adaptive execution splits a common
    hash. Only documents with hits meet the texts of their items.
    """
    left = _seed_rows(docs, "__row", "__text", widths, False).withColumnRenamed("position", "__at")
    right = _seed_rows(items, "item_row", "text", widths, True)
    hits = left.join(right, "h").select("__row", "item_row", (F.col("__at") - F.col("position")).alias("d")).distinct()
    near = hits.join(docs, "__row").join(items, "item_row").select("__row", "item_row", "d", "__text", "text")
    schema = near.select("__row", F.lit(None).cast(OVERLAP).alias("overlaps")).schema

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "__text"):
                texts, theirs = Tokens.of(part.column("__text")), Tokens.of(part.column("text"))
                rows, found = [], []
                for i, (item, d) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    own = texts.word_hash[texts.first[i] : texts.first[i + 1]]
                    it = theirs.word_hash[theirs.first[i] : theirs.first[i + 1]]
                    got = _overlaps(own, it, np.array([d]))
                    if got:
                        rows.append(i)
                        found.append([dict(zip(("item_row", "start", "n_words", "n_equal"), (item, *got), strict=True))])
                taken = part.column(0).take(pa.array(rows, pa.int64()))
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_row", "start", "n_words", "n_equal")]))
                yield pa.RecordBatch.from_arrays([taken, pa.array(found, kind)], ["__row", "overlaps"])

    one = near.mapInArrow(check, schema).select("__row", F.explode("overlaps").alias("o"))
    best = one.groupBy("__row", "o.item_row").agg(F.max_by("o", F.struct("o.n_equal", -F.col("o.start"))).alias("o"))
    return best.groupBy("__row").agg(F.array_sort(F.collect_list("o")).alias("overlaps"))


def with_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """The rows of `docs` with `__overlaps`, an array of (item_id, start, n_words, n_equal).

    The benchmark is measured before anything is shipped.
    """
    items = benchmark.select(
        F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")
    )
    size, rows = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).head()
    own = [F.col(f"`{c}`") for c in docs.columns]
    item_type = benchmark.schema[item_id].dataType.simpleString()
    shape = f"array<struct<item_id:{item_type},start:bigint,n_words:bigint,n_equal:bigint>>"
    # A token has two bytes at least with its border, and gives one seed per mask.
    if (size or 0) * len(masks(SPAN)) // 2 <= index_rows and (size or 0) <= MAX_SHIPPED_BYTES and rows <= index_rows:
        found = items.orderBy("item_id", "text").collect()
        ids, texts = [r[0] for r in found], [r[1] for r in found]
        sent = docs.select(*own, F.col(f"`{text}`").cast("string").alias("__text"))
        schema = sent.drop("__text").withColumn("__overlaps", F.lit(None).cast(shape)).schema
        shipped = docs.sparkSession.sparkContext.broadcast(texts)
        kept: dict[str, Index] = {}

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if "index" not in kept:
                kept["index"] = Index(shipped.value)
            index = kept["index"]
            for part in slices(batches, "__text"):
                tokens = Tokens.of(part.column("__text"))
                overlaps = [
                    [{"item_id": ids[i], "start": a, "n_words": n, "n_equal": e} for i, a, n, e in one]
                    for one in index.overlaps(tokens)
                ]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                out = pa.array(overlaps, pa.list_(pa.struct([("item_id", _arrow(item_type)), *[(n, pa.int64()) for n in ("start", "n_words", "n_equal")]])))
                yield pa.RecordBatch.from_arrays([*columns, out], [*part.schema.names[:-1], "__overlaps"])

        return sent.mapInArrow(search, schema)
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    listed = materialise(items.withColumn("item_row", F.monotonically_increasing_id()))
    found = _joined_overlaps(
        numbered.select("__row", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")),
        listed,
        list(range(MIN_ITEM, SPAN)),
    )
    named = (
        found.select("__row", F.explode("overlaps").alias("o"))
        .join(listed.select(F.col("item_row").alias("__item"), "item_id"), F.col("o.item_row") == F.col("__item"))
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list(F.struct("item_id", "o.start", "o.n_words", "o.n_equal"))).cast(shape).alias("__overlaps"))
    )
    return numbered.join(named, "__row", "left").select(*own, F.coalesce("__overlaps", F.array().cast(shape)).alias("__overlaps"))


def _arrow(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[simple]


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: whether it holds benchmark text, how many items, which, and the words covered."""
    kept = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`"))
    found = with_overlaps(kept, benchmark, text)
    return found.select(
        id_column,
        (F.size("__overlaps") > 0).alias("contaminated"),
        F.size("__overlaps").cast("long").alias("n_items"),
        F.transform("__overlaps", lambda o: o["item_id"]).alias("item_ids"),
        F.col("__overlaps").alias("overlaps"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without benchmark text, with their own columns."""
    found = with_overlaps(docs, benchmark, text)
    return found.where(F.size("__overlaps") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
