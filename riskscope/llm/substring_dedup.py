"""Substring dedup with fixed-block anchors.

A run of 50 words that two documents share holds a whole aligned block of 25 words of the
earlier one, wherever the run begins. So the non-overlapping 25-word blocks of every document
are indexed, every rolling 25-word window of every document probes them, and only windows of
50 words around a hit are compared in full: the windows found in an earlier document join to
the maximal exact repeats, whose words are removed.

Documents meet in bundles of about equal bytes, by a hash of their id. A bundle folds its
windows to distinct hashes before anything is shuffled, so a passage that a third of the
corpus shares is sent once per bundle. Hashes go to ranges of the hash space in packed
arrays, and each range answers a bundle with one bit per hash in the order they were sent;
the bundle derives that order again from its texts. Copies are never paired with each other.

1. bundle -> range: distinct 25-word hashes, each marked if it is an aligned block and if
   several documents of the bundle hold it. Answer: the hash is an anchor (a block somewhere,
   and in several documents). Truncation may add anchors, which step 2 weeds out.
2. bundle -> range: distinct 96-bit hashes of the 50-word windows around anchors, with the
   smallest document of the bundle. Answer: a smaller document elsewhere holds the window.
3. bundle: the windows so marked, or held by a smaller document of the same bundle.

Defined cases: a null or blank text has no words; a null id counts as larger than every id;
repeated rows of one id do not remove each other's words; further columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskscope.llm.words import Scan, scan

WINDOW = 50
# Text bytes of a bundle and words of a hash range; both bound what one task holds at a time.
BUNDLE_BYTES = 3 << 20
RANGE_WORDS = 1 << 20
NO_ID = np.iinfo(np.int64).max

PROBES = "rng bigint, bundle bigint, keys binary, marks binary, docs binary, counts binary"
ANSWERS = "bundle bigint, kind int, rng bigint, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:bigint,end:bigint>>"
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _docs(table: pa.Table) -> tuple[np.ndarray, pa.Array, Scan]:
    ids = table.column("doc_id").combine_chunks()
    texts = table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
    numbers = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, texts, scan(texts)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin."""
    change = np.zeros(len(sorted_keys[0]), bool)
    change[:1] = True
    for k in sorted_keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class Blocks:
    """The distinct rolling hashes of a bundle, ordered by (range, key)."""

    def __init__(self, words: Scan, ids: np.ndarray, width: int, ranges: int):
        self.words = words
        self.at = words.windows(width)
        h = words.window_hash(self.at, width)
        code = ((h >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(code)
        code = code[order]
        begin = _starts(code) if len(code) else np.zeros(0, np.int64)
        self.codes = code[begin]
        self.group = np.empty(len(code), np.int64)
        self.group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(code))))
        self.rng = (self.codes >> np.uint64(32)).astype(np.int64)
        if not len(begin):
            self.marks = np.zeros(0, np.uint8)
            return
        text = words.text_of[self.at]
        aligned = (self.at - words.first[text]) % width == 0
        doc = ids[text][order]
        several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        self.marks = np.logical_or.reduceat(aligned[order], begin).astype(np.uint8) | several.astype(np.uint8) << 1


class Windows:
    """The distinct 50-word windows of a bundle around its anchors, ordered by (range, smallest document, key)."""

    def __init__(self, blocks: Blocks, anchor: np.ndarray, ids: np.ndarray, width: int, block: int, ranges: int):
        words = blocks.words
        hit = np.zeros(len(words.start) + width + 1, np.int64)
        hit[blocks.at[anchor[blocks.group]]] = 1
        hits = np.concatenate([[0], np.cumsum(hit)])
        at = words.windows(width)
        self.at = at[hits[at + width - block + 1] > hits[at]]
        h = words.window_hash(self.at, width)
        low = (words.window_hash(self.at, width, 0x5BD1E995) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.doc = ids[words.text_of[self.at]]
        order = np.lexsort((low, h))
        begin = _starts(h[order], low[order]) if len(order) else np.zeros(0, np.int64)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        least = np.minimum.reduceat(self.doc[order], begin) if len(order) else np.zeros(0, np.int64)
        keys = np.zeros(len(begin), _KEY)
        keys["a"], keys["b"] = h[order][begin], low[order][begin]
        rng = ((keys["a"] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        sent = np.lexsort((keys["b"], keys["a"], least, rng))
        self.keys, self.least, self.rng = keys[sent], least[sent], rng[sent]
        place = np.empty(len(sent), np.int64)
        place[sent] = np.arange(len(sent))
        self.group = place[group]


def _cuts(rng: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges in a sorted array, and where each lies."""
    begin = _starts(rng) if len(rng) else np.zeros(0, np.int64)
    for a, b in zip(begin, np.append(begin[1:], len(rng)), strict=True):
        yield int(rng[a]), slice(int(a), int(b))


def _bits(answers: pa.Table, kind: int, rng: np.ndarray) -> np.ndarray:
    """The answers of one kind, laid out in the order of the sent hashes."""
    own = {r: b for k, r, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "rng", "bits")), strict=True) if k == kind}
    out = np.zeros(len(rng), bool)
    for r, where in _cuts(rng):
        out[where] = np.unpackbits(np.frombuffer(own[r], np.uint8), count=where.stop - where.start).astype(bool)
    return out


def _probe_rows(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in PROBES.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _answer_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bundle", "kind", "rng", "bits"])


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For one range: which of each bundle's hashes are anchors."""
    bundles, sent = table.column("bundle").to_pylist(), table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(sent), "<u4")
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8)
    order = np.argsort(keys, kind="stable")
    begin = _starts(keys[order])
    size = np.diff(np.append(begin, len(keys)))
    seen = np.bitwise_or.reduceat(marks[order], begin)
    anchor = (seen & 1 > 0) & ((size > 1) | (seen & 2 > 0))
    flags = np.empty(len(keys), bool)
    flags[order] = np.repeat(anchor, size)
    return _answers(table, bundles, [len(s) // 4 for s in sent], flags, 1)


def _answer_windows(table: pa.Table) -> pa.Table:
    """For one range: which of each bundle's windows a smaller document elsewhere holds."""
    bundles, sent = table.column("bundle").to_pylist(), table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(sent), _KEY)
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), "<i8")
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    least = np.repeat(docs, counts)
    order = np.lexsort((keys["b"], keys["a"]))
    begin = _starts(keys["a"][order], keys["b"][order])
    smallest = np.empty(len(keys), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(keys))))
    return _answers(table, bundles, [len(s) // _KEY.itemsize for s in sent], smallest < least, 2)


def _answers(table: pa.Table, bundles: list[int], sizes: list[int], flags: np.ndarray, kind: int) -> pa.Table:
    rng, at, rows = table.column("rng")[0].as_py(), 0, []
    for bundle, size in zip(bundles, sizes, strict=True):
        rows.append((bundle, kind, rng, np.packbits(flags[at : at + size]).tobytes()))
        at += size
    return _answer_rows(rows)


def _kept(texts: pa.Array, words: Scan, removed: np.ndarray) -> list[str]:
    out = []
    for i, text in enumerate(texts.to_pylist()):
        own = (text or "").encode().split()
        gone = removed[words.first[i] : words.first[i + 1]]
        if gone.any():
            own = [own[j] for j in np.flatnonzero(~gone).tolist()]
        out.append(b" ".join(own).decode())
    return out


def _spans(words: Scan, removed: np.ndarray) -> list[list[dict]]:
    out = []
    for i in range(words.n_texts):
        own = removed[words.first[i] : words.first[i + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        out.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text and the spans of removed words.

    A word goes if a window of `window` words around it also starts in a document of smaller id.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).head()[0] or 0
    bundles, ranges = size // BUNDLE_BYTES + 1, size // (6 * RANGE_WORDS) + 1
    sent = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(f"`{id_column}`").cast("long")), F.lit(bundles)).alias("bundle"),
    )
    by_bundle = sent.groupBy("bundle")

    def probe(table: pa.Table) -> pa.Table:
        ids, _, words = _docs(table)
        bundle = table.column("bundle")[0].as_py()
        blocks = Blocks(words, ids, block, ranges)
        keys = (blocks.codes & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _probe_rows(
            [(r, bundle, keys[w].tobytes(), blocks.marks[w].tobytes(), b"", b"") for r, w in _cuts(blocks.rng)]
        )

    def around(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, pa.Array, Scan, Windows]:
        ids, texts, words = _docs(table)
        blocks = Blocks(words, ids, block, ranges)
        return ids, texts, words, Windows(blocks, _bits(answers, 1, blocks.rng), ids, window, block, ranges)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _probe_rows([])
        windows = around(table, answers)[3]
        bundle = table.column("bundle")[0].as_py()
        rows = []
        for r, w in _cuts(windows.rng):
            least = windows.least[w]
            begin = _starts(least)
            counts = np.diff(np.append(begin, len(least))).astype("<u4")
            rows.append((r, bundle, windows.keys[w].tobytes(), b"", least[begin].astype("<i8").tobytes(), counts.tobytes()))
        return _probe_rows(rows)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in out_schema], schema=out_schema)
        ids, texts, words, windows = around(table, answers)
        elsewhere = _bits(answers, 2, windows.rng)
        known = elsewhere[windows.group] | (windows.doc > windows.least[windows.group])
        removed = words.cover(windows.at[known], window)
        return pa.table(
            [
                table.column("doc_id").combine_chunks(),
                pa.array(words.n_words.astype(np.int64)),
                pa.array(words.per_text(removed, words.first)),
                pa.array(_kept(texts, words, removed), pa.string()),
                pa.array(_spans(words, removed), out_schema.field("spans").type),
            ],
            schema=out_schema,
        )

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out_schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", span)]
    )
    anchors = by_bundle.applyInArrow(probe, PROBES).groupBy("rng").applyInArrow(_answer_anchors, ANSWERS)
    probes = by_bundle.cogroup(anchors.groupBy("bundle")).applyInArrow(extend, PROBES)
    found = probes.groupBy("rng").applyInArrow(_answer_windows, ANSWERS)
    return by_bundle.cogroup(anchors.union(found).groupBy("bundle")).applyInArrow(remove, RESULT)
