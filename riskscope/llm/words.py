"""Words, lines and rolling windows of whole Arrow batches, without a Python step per word.

A word is a run of bytes other than the six ASCII white-space bytes. All arrays cover a
slice of a batch: the UTF-8 bytes of its texts laid end to end, so one pass of numpy
serves many documents. Hashes are polynomial in 64 bits, mixed at the end; equal input
gives equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Texts are handled in slices of about this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values, so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        table = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            table.append(np.cumprod(p, dtype=np.uint64))
        known = (table[0], table[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + size * np.uint64(0xA0761D6478BD642F))


@dataclass
class Scan:
    """The bytes of a slice and where its texts begin: text i is data[text_at[i]:text_at[i+1]]."""

    data: np.ndarray
    text_at: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.text_at) - 1

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.empty(len(self.data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(SPACE[self.data], out=inside[1:-1])
        change = inside[1:] != inside[:-1]
        at = np.flatnonzero(change)
        start, end = at[0::2], at[1::2]
        # A text border inside a run of word bytes separates two words.
        cut = np.unique(self.text_at[1:-1])
        cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        return start, end

    @property
    def start(self) -> np.ndarray:
        return self._edges[0]

    @property
    def end(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each text; one more entry closes the last."""
        return np.searchsorted(self.start, self.text_at)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_texts), self.n_words)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end, _BYTE_BASE)

    def windows(self, width: int) -> np.ndarray:
        """Index of the first word of each window of `width` words inside one text."""
        i = np.arange(len(self.start))
        return i[i + width <= self.first[self.text_of + 1]]

    def window_hash(self, at: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
        """Hash of the `width` words that begin at each word index in `at`."""
        words = mix(self.word_hash + np.uint64(salt)) if salt else self.word_hash
        return spans_hash(words, at, at + width, _WORD_BASE)

    def cover(self, at: np.ndarray, width: int) -> np.ndarray:
        """True for each word inside a window of `width` words that begins at an index in `at`."""
        step = np.zeros(len(self.start) + width + 1, np.int64)
        np.add.at(step, at, 1)
        np.subtract.at(step, at + width, 1)
        return np.cumsum(step)[: len(self.start)] > 0

    def per_text(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of `values` between the borders `at`, one per text."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[at])


def scan(texts: pa.Array) -> Scan:
    """The bytes of an Arrow string array; a null text is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0]) if len(at) else 0
    raw = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return Scan(raw, (at - at[0]) if len(at) else np.zeros(1, np.int64))


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
