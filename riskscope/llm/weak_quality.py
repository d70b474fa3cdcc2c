"""Quality rules as weak supervision: rules vote or abstain, a label model weighs the votes.

Every document gets whole-text counts. Each rule turns them into a vote: good (1), bad (-1)
or abstain (0). The latent quality and the reliability of each rule are estimated by
expectation-maximisation over all documents, and the posterior probability of being good
decides. The votes of a document form one pattern, and there are 3 ** rules patterns at
most, so the corpus is reduced to pattern counts in one aggregation and EM runs on that
bounded table, whatever the corpus holds.

Defined cases: a null or blank text has no words and fails the base rule; a null doc_id is
kept as null; repeated rows are judged each by itself; columns other than the text and the
id pass through `quality_filter` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskscope.llm.words import SPACE, Scan, mix, scan, slices, spans_hash

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
THRESHOLD = 0.5
EM_ROUNDS = 200
FALSE_ALARMS = 0.005
# Bad documents come in kinds, and a rule made for one kind votes on the others as it does on good
# documents: so much of its votes on bad documents, other than bad votes, is estimated from them.
OWN_VOTES = 0.2
#: Votes (bad, abstain, good) that a bad and a good class are assumed to have cast beforehand; they
#: matter only where a corpus has few documents.
PRIOR_VOTES = np.array([[1.0, 0.2, 4.0], [0.05, 2.0, 18.0]])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"'")] = True

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_stop_lines", "n_upper", "n_letters", "n_digits", "n_distinct_words", "n_bangs",
]


def _repeat_words(words: Scan) -> np.ndarray:
    """Words of each text inside a window of five words that the text holds twice or more."""
    at = words.windows(REPEAT_WINDOW)
    if not len(at):
        return np.zeros(words.n_texts, np.int64)
    text = words.text_of[at].astype(np.uint64)
    key = words.window_hash(at, REPEAT_WINDOW) ^ mix(text + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return words.per_text(words.cover(at[repeated], REPEAT_WINDOW), words.first)


def _lines(words: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, those of them equal to an earlier one, and those with a closing mark."""
    empty = np.zeros(words.n_texts, np.int64)
    breaks = np.flatnonzero(words.data == 10)
    start = np.unique(np.concatenate([words.text_at[:-1], breaks + 1]))
    start = start[start < len(words.data)]
    if not len(start):
        return empty, empty, empty
    end = np.append(start[1:], len(words.data))
    end = end - (words.data[end - 1] == 10)
    last = np.searchsorted(words.start, end)
    worded = last > np.searchsorted(words.start, start)
    start, end, last = start[worded], end[worded], last[worded]
    text = np.searchsorted(words.text_at, start, "right") - 1
    # Empty texts share a border with their successor; the last text at a border owns the bytes.
    key = spans_hash(words.data, start, end, 0x9E3779B97F4A7C15) ^ mix(text.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[kept] = False
    closed = _STOP[words.data[words.end[last - 1] - 1]] if len(last) else np.zeros(0, bool)
    count = lambda which: np.bincount(text[which], minlength=words.n_texts)
    return count(slice(None)), count(again), count(closed)


def text_counts(words: Scan) -> dict[str, np.ndarray]:
    """The whole-text counts of each text, by name."""
    data = words.data
    per_byte = lambda flags: words.per_text(flags, words.text_at)
    lines, dup_lines, stop_lines = _lines(words)
    distinct = np.unique(words.word_hash ^ mix(words.text_of.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    return {
        "n_words": words.n_words,
        "word_chars": per_byte(((data & 0xC0) != 0x80) & ~SPACE[data]),
        "n_symbols": per_byte(_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeat_words(words),
        "n_lines": lines,
        "n_stop_lines": stop_lines,
        "n_upper": per_byte(_UPPER[data]),
        "n_letters": per_byte(_LETTER[data]),
        "n_digits": per_byte(_DIGIT[data]),
        "n_distinct_words": np.bincount(words.text_of[distinct], minlength=words.n_texts),
        "n_bangs": per_byte(data == 33),
    }


def with_counts(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The `keep` columns (default: all) with a struct `__counts` of the counts of `text`."""
    keep = docs.columns if keep is None else list(keep)
    fields = [docs.schema[c] for c in keep]
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    sent = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    out = sent.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast(f"struct<{counts}>").alias("__counts")).schema
    assert len(out) == len(fields) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            found = text_counts(scan(part.column("__text")))
            struct = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], COUNTS)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [struct], [*keep, "__counts"])

    return sent.mapInArrow(count, out)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (F.lit(100) * n_repeat_words > F.lit(MAX_REPEAT_PERCENT) * n_words)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rule_votes(c: Column) -> dict[str, Column]:
    """One vote per rule from the counts struct `c`. Ratios are compared without division."""
    words, lines, letters = c["n_words"], c["n_lines"], c["n_letters"]
    return {
        "word_length": _vote(
            (c["word_chars"] < 3 * words) | (c["word_chars"] > 12 * words), c["word_chars"].between(4 * words, 8 * words)
        ),
        "symbols": _vote(20 * c["n_symbols"] > words, 200 * c["n_symbols"] <= words),
        "repeated_lines": _vote(10 * c["n_dup_lines"] > 3 * lines, (c["n_dup_lines"] == 0) & (lines >= 2)),
        "repeated_words": _vote(100 * c["n_repeat_words"] > 15 * words, 50 * c["n_repeat_words"] <= words),
        "few_distinct_words": _vote(
            (8 * c["n_distinct_words"] < words) & (words < 2000), 2 * c["n_distinct_words"] >= words
        ),
        "capitals": _vote(10 * c["n_upper"] > 3 * letters, 10 * c["n_upper"] <= letters),
        "digits": _vote(4 * c["n_digits"] > letters, 50 * c["n_digits"] <= letters),
        "exclamations": _vote(5 * c["n_bangs"] > words, 100 * c["n_bangs"] <= words),
        "closed_lines": _vote(10 * c["n_stop_lines"] < lines, 10 * c["n_stop_lines"] >= 7 * lines),
    }


def vote_pattern(votes: Sequence[Column]) -> Column:
    """The votes as one number: digit j in base 3 is vote j plus one."""
    total = F.lit(0)
    for j, vote in enumerate(votes):
        total = total + (vote + 1) * (3**j)
    return total.cast("int")


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """P(good) of each vote pattern, by EM over a two-class model with one vote table per rule.

    The start lowers the belief in a pattern to a fifth for each bad vote. A rule is assumed to be better
    than chance: it calls at most `FALSE_ALARMS` of the good documents bad, and calls bad ones
    bad more often than good ones. This keeps the meaning of the two classes.
    """
    if not len(patterns):
        return np.zeros(0)
    digits = (patterns[:, None] // 3 ** np.arange(rules)[None, :]) % 3
    onehot = np.eye(3)[digits]
    posterior = 0.995 * 0.2 ** (digits == 0).sum(1)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("cp,prv->crv", weight, onehot) + PRIOR_VOTES[:, None, :]
        table /= table.sum(2, keepdims=True)
        alarm = np.minimum(table[1, :, 0], FALSE_ALARMS)
        other = (1 - OWN_VOTES) * table[1] + OWN_VOTES * table[0]
        table = np.stack([_with_bad(other, np.maximum(table[0, :, 0], 2 * alarm)), _with_bad(table[1], alarm)])
        share = (weight.sum(1) + 1.0) / (weight.sum() + 2.0)
        score = np.log(share)[:, None] + np.einsum("prv,crv->cp", onehot, np.log(table))
        new = 1.0 / (1.0 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            return new
        posterior = new
    return posterior


def _with_bad(table: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The vote table of one class with the probability of a bad vote set, the rest in proportion."""
    rest = table[:, 1:] / table[:, 1:].sum(1, keepdims=True)
    return np.concatenate([bad[:, None], rest * (1 - bad)[:, None]], axis=1)


def judged(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The `keep` columns with `__counts`, `__failed` (base rule) and `__good`, the posterior.

    Two passes over the texts: one for the pattern counts, one for the verdicts.
    """
    spark = docs.sparkSession
    votes = list(rule_votes(F.col("__counts")).values())
    failed = base_failed(F.col("__counts.n_words"), F.col("__counts.n_repeat_words"))

    def marked(columns):
        counted = with_counts(docs, text, columns)
        return counted.withColumns({"__failed": failed, "__pattern": vote_pattern(votes)})

    # At most 3 ** rules rows reach the driver.
    rows = marked([]).where(~F.col("__failed")).groupBy("__pattern").count().orderBy("__pattern").collect()
    patterns = np.array([r[0] for r in rows], np.int64)
    posterior = fit_label_model(patterns, np.array([r[1] for r in rows], float), len(votes))
    table = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, posterior, strict=True)], "__pattern int, __good double"
    )
    return marked(keep).join(F.broadcast(table), "__pattern", "left").drop("__pattern")


def quality_verdicts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its counts, base verdict, posterior quality and whether it is kept."""
    c = F.col("__counts")
    return judged(docs, keep=["doc_id"]).select(
        "doc_id",
        *[c[n].alias(n) for n in COUNTS],
        F.col("__failed").alias("base_failed"),
        F.col("__good").alias("quality"),
        (~F.col("__failed") & (F.coalesce(F.col("__good"), F.lit(0.0)) >= threshold)).alias("kept"),
    )


def quality_filter(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with their own columns."""
    keep = ~F.col("__failed") & (F.coalesce(F.col("__good"), F.lit(0.0)) >= threshold)
    return judged(docs).where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
