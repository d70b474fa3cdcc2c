"""Encoding of texts with a public tokenizer inside Arrow functions.

Long texts are split where the tokenizer's own chain is certain to split: at ASCII white
space, and in runs of plain characters (printable ASCII and Latin-1 letters, which its
normalizer only lower-cases) also at its pre-tokenizer's pieces. The ids of a text are those
of its parts in order. Parts repeat far more often than texts do, so each task remembers the
ids of the parts it has met, up to a fixed number; a part it does not know goes to the
library: a plain piece straight to its merges, any other word through its whole chain, in
batches of equal bytes.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Parts remembered by one task, and the longest part worth remembering.
MEMO_PARTS = 400_000
MEMO_CHARS = 40
# Words outside the plain characters go to the library in batches of about this many characters.
BATCH_CHARS = 1 << 16

#: Fixed value: the pre-tokenizer pattern for which the plain split below holds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = "a-zß-öø-ÿ"
_PLAIN = "!-~À-ÖØ-öø-ÿ"
# The alternatives of the pattern; letters come first, as no other alternative begins with one.
_PIECES = re.compile(f"[{_LOWER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\t-\\r {_LOWER}0-9]+").findall
_ALL_PLAIN = re.compile(f"[\\t-\\r {_PLAIN}]*").fullmatch
_WORD = re.compile("[^\\t-\\r ]+")


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PartIds(dict):
    """Part of a text to its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.library = library(path)
        settings = json.loads(self.library.to_str())
        steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x["type"] for x in (settings.get("normalizer") or {}).get("normalizers", [])]
        self.splits = (
            [x.get("pattern") for x in steps] == [{"Regex": PATTERN}, None]
            and steps[1]["type"] == "ByteLevel"
            and normal == ["NFC", "Replace", "Lowercase"]
            and all(x["content"].startswith("<|") for x in settings["added_tokens"])
        )
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.merge = self.library.model.tokenize

    @staticmethod
    def value(ids: list[int]):
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str):
        found = self.value([t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.bytes_of))])
        if len(piece) <= MEMO_CHARS:
            self[piece] = found
        return found

    def _whole(self, words: list[str]) -> list:
        """Values of words that go through the whole chain of the library."""
        out, part, size = [], [], 0
        for i, word in enumerate(words):
            part.append(word)
            size += len(word)
            if size >= BATCH_CHARS or i + 1 == len(words):
                out += [self.value(e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
        return out

    def of(self, text: str) -> list:
        """The values of the parts of a text, in order."""
        if len(self) > MEMO_PARTS:
            self.clear()
        if not self.splits:
            return self._whole([text])
        if "<|" not in text and _ALL_PLAIN(text):
            return [self[p] for p in _PIECES(text.lower())]
        # Words with a character that is not plain, or with what may be a special token.
        odd = [m for m in _WORD.finditer(text) if "<|" in m.group() or not _ALL_PLAIN(m.group())]
        out, at = [], 0
        for match, value in zip(odd, self._whole([m.group() for m in odd]), strict=True):
            out += [self[p] for p in _PIECES(text[at : match.start()].lower())]
            out.append(value)
            at = match.end()
        out += [self[p] for p in _PIECES(text[at:].lower())]
        return out


class PartLengths(PartIds):
    """Part of a text to its number of ids."""

    @staticmethod
    def value(ids: list[int]):
        return len(ids)


@lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    return PartIds(path)


@lru_cache(maxsize=2)
def part_lengths(path: str) -> PartLengths:
    return PartLengths(path)
