"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A text is the set of its shingles of `WIDTH` words, ASCII letters lower-cased; with fewer words
it is the whole sequence as one shingle, without words the empty set, which links with nothing.
Shingles stand in the order of their 64-bit hashes, and ranges of that order are fragments.

Candidates. Two sets of n and m shingles that reach the similarity differ in at most
(100 - p) (n + m) / (100 + p) shingles. With more non-empty fragments than that, one of them is
touched by no difference, so it is equal in both sets. Sizes fall into classes so narrow that
partners are in the same or the next one; a set cuts the order once for its class, and once for
the next if a partner may be there, and gives a signature for each non-empty fragment. A set with too few non-empty
fragments cuts a re-salted order as well, until one cut has enough (shingle by shingle in the
end): two similar sets can only both miss a cut if both go on to the next one.

Counts. Candidates are verified in `PIECES` other fragments. Each set has the size and a digest of
its pieces; pieces that agree are counted whole, and pairs whose sizes and digests already tell
too many differences are dropped. For the pieces that differ the shared shingles are counted
separately and summed by pair, so only their contents are shuffled. The pieces also spread a set
with many partners over as many tasks.

Large groups. Equal sets are folded first. Each set of a signature is paired with one of its
sets only, the one that meets most others, so that the copies of a text meet the text they were
made from. Sets that share a signature but not a class after that are paired directly, if at most
`CROWD` sets of different classes hold it. Those of larger groups are cut once more, shingle by shingle: rare
shingles first, two similar sets meet within the differences they may have, and a pair is taken at
its first common shingle only if what lies behind can still reach the overlap. A class is the
connected component, so none of this changes one, and no link between classes is left out.

Defined cases: null and empty texts have size 0 and are their own class; repeated rows share a
class; a null id never names a class, which is null if no member has an id; texts of any length
are read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskscope.llm.components import component_labels
from riskscope.llm.words import Scan, mix, scan, slices
from riskscope.session import materialise, release

WIDTH = 3
MIN_PERCENT = 90
#: Fragments in which overlaps are counted.
PIECES = 64
#: Salted orders before every shingle is a fragment of its own.
ORDERS = 16
#: Sets of a signature that are paired directly.
CROWD = 64
# Buckets of shingle counts that order the shingles of crowded signatures; 8 MB.
BUCKETS = 1 << 20
# Set keys that may be shipped to every task: 16 bytes each, 32 MB.
SHIPPED_KEYS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): set i is hashes[first[i]:first[i+1]], ascending and without repeats."""
    raw = scan(texts)
    words = Scan(_LOWER[raw.data], raw.text_at)
    at = words.windows(width)
    few = np.flatnonzero((words.n_words > 0) & (words.n_words < width))
    h = np.concatenate([words.window_hash(at, width), words.window_hash(words.first[few], words.n_words[few])])
    text = np.concatenate([words.text_of[at], few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(words.n_texts + 1))


def size_classes(most: int, percent: int) -> np.ndarray:
    """First size of each class, two classes beyond `most`; partners are in one class or two adjacent ones.

    Wider classes have more fragments than their small sets need, narrower ones more sets that
    may have a partner in the next; about half as wide again as their first size is the least.
    """
    lows = [1]
    while len(lows) < 4 or lows[-3] <= most:
        lows.append(max(lows[-1] + 1, 100 * lows[-1] // percent, 3 * lows[-1] // 2))
    return np.array(lows)


def most_differences(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 - percent) * (a + b) // (100 + percent)


def _runs(h: np.ndarray, text: np.ndarray, parts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, fragment, digest) of the non-empty fragments, `parts` of them for each entry."""
    g = mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if salt else h
    at = ((g >> np.uint64(32)) * parts.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    if salt >= ORDERS:
        at = np.arange(len(h))
    elif salt:
        order = np.lexsort((at, text))
        h, text, at = h[order], text[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    digest = total[np.append(start[1:], len(h))] - total[start]
    fragment = np.zeros(len(start), np.int64) if salt >= ORDERS else at[start]
    return text[start], fragment, digest


def signatures(h: np.ndarray, first: np.ndarray, percent: int = MIN_PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(first, signatures) of each set: similar but different sets have one in common."""
    n = np.diff(first)
    lows = size_classes(int(n.max(initial=0)), percent)
    own = np.searchsorted(lows, n, "right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    texts, found = [], []
    for step in (0, 1):
        level = own + step
        top = lows[level + 1] - 1
        apart = most_differences(top, top, percent)
        todo = (n > 0) & (apart > 0) & ((step == 0) | (100 * n // percent >= lows[level]))
        for salt in range(ORDERS + 1):
            use = todo[owner]
            if not use.any():
                break
            text = owner[use]
            # A tenth more fragments than needed, as some may be empty.
            run, fragment, digest = _runs(h[use], text, apart[text] + 1 + (apart[text] + 9) // 10, salt)
            place = (level[run].astype(np.uint64) << np.uint64(40)) + (np.uint64(salt) << np.uint64(34)) + fragment.astype(np.uint64)
            texts.append(run)
            found.append(mix(digest ^ mix(place + np.uint64(1))))
            todo &= np.bincount(run, minlength=len(n)) <= apart
    text = np.concatenate([*texts, np.zeros(0, np.int64)])
    flat = np.concatenate([*found, np.zeros(0, np.uint64)])
    order = np.argsort(text, kind="stable")
    return np.searchsorted(text[order], np.arange(len(n) + 1)), flat[order]


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = _running(mix(h))
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


_keys = set_keys


def _pieces(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of all sets begin, `PIECES` of each; one more entry closes the last."""
    n = np.diff(first)
    piece = ((h >> np.uint64(32)) * np.uint64(PIECES) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(np.repeat(np.arange(len(n)), n) * PIECES + piece, np.arange(len(n) * PIECES + 1))


def _nested(values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * PIECES, pa.int32()), values)


def piece_profiles(h: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Sizes and digests of the pieces of each set, as lists."""
    cuts = _pieces(h, first)
    total = _running(mix(h ^ np.uint64(0xE7037ED1A0B428DB)))
    digests = (total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)
    return _nested(pa.array(np.diff(cuts)), len(first) - 1), _nested(pa.array(digests), len(first) - 1)


def _table(docs: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, s, n, sigs, sizes, digests) of every row; s is the key of the set, the last two are those of its pieces."""
    sent = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    long = F.lit(0).cast("long")
    lists = [F.array(long).alias(c) for c in ("sigs", "sizes", "digests")]
    schema = sent.select(id_column, long.alias("s"), long.alias("n"), *lists).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            h, first = shingle_sets(part.column("__text"), width)
            n = np.diff(first)
            sig_at, sigs = signatures(h, first, percent)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(set_keys(h, first).view(np.int64)),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(sig_at, pa.int32()), pa.array(sigs.view(np.int64))),
                    *piece_profiles(h, first),
                ],
                [id_column, "s", "n", "sigs", "sizes", "digests"],
            )

    return sent.mapInArrow(fold, schema)


def _set_pieces(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(s, pieces, …): the shingles of the sets in `wanted` by piece, a row for each text, with the columns of `wanted`."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            h, first = shingle_sets(part.column("__text"), width)
            pieces = pa.ListArray.from_arrays(pa.array(_pieces(h, first), pa.int32()), pa.array(h.view(np.int64)))
            key = pa.array(set_keys(h, first).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, _nested(pieces, len(key))], ["s", "pieces"])

    sets = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(fold, "s bigint, pieces array<array<bigint>>")
    shipped = F.broadcast(wanted) if wanted.count() <= SHIPPED_KEYS else wanted
    return sets.join(shipped, "s")


def _contents(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(s, k, part): the shingles of the wanted (s, mask of pieces); other pieces make no row."""
    asked = "filter(transform(pieces, (part, k) -> struct(k, part)), p -> (shiftright(mask, p.k) & 1) = 1)"
    apart = _set_pieces(docs, text, width, wanted).select("s", F.explode(F.expr(asked)).alias("p"))
    return apart.select("s", "p.k", "p.part").dropDuplicates(["s", "k"])


def similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def _told_apart(pairs: DataFrame, profiles: DataFrame, percent: int, trial: int) -> DataFrame:
    """(u, v, n, m, same, apart, left, tried, least) of the pairs that may be similar: shingles in equal pieces, and the other pieces.

    `apart` has the first `trial` of these, `left` the rest as a mask. All but the rest makes `tried` - 2 * shared differences, if `shared`
    counts the equal pieces too, and the rest `least` at the fewest.
    """
    left, right = (profiles.select(*[F.col(c).alias(f"{x}_{c}") for c in profiles.columns]) for x in ("u", "v"))
    joined = pairs.join(left.hint("merge"), F.col("u") == F.col("u_s")).join(right.hint("merge"), F.col("v") == F.col("v_s"))
    joined = joined.withColumnsRenamed({"u_n": "n", "v_n": "m"})
    found = joined.withColumn("apart", F.expr(f"filter(sequence(0, {PIECES - 1}), k -> u_digests[k] <> v_digests[k])"))
    fewest = "aggregate({}, 0L, (d, k) -> d + greatest(abs(u_sizes[k] - v_sizes[k]), if(u_sizes[k] = v_sizes[k], 2L, 1L)))"
    least = F.expr(fewest.format("apart"))
    whole = F.expr("aggregate(apart, n, (c, k) -> c - u_sizes[k])")
    return found.where(_near_enough(least, percent)).select(
        "u",
        "v",
        "n",
        "m",
        whole.alias("same"),
        F.slice("apart", 1, trial).alias("apart"),
        _mask(f"slice(apart, {trial + 1}, {PIECES})").alias("left"),
        (2 * whole + F.expr(f"aggregate(slice(apart, 1, {trial}), 0L, (d, k) -> d + u_sizes[k] + v_sizes[k])")).alias("tried"),
        F.expr(fewest.format(f"slice(apart, {trial + 1}, {PIECES})")).alias("least"),
    )


def _near_enough(differences: Column, percent: int) -> Column:
    return (100 + percent) * differences <= (100 - percent) * (F.col("n") + F.col("m"))


def _mask(pieces: str) -> Column:
    return F.expr(f"aggregate({pieces}, 0L, (b, k) -> b | shiftleft(1L, k))")


def _overlaps(pairs: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """`partial_overlaps` of stored pairs, with the contents read from `docs`; the result is stored."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("s"), _mask("apart").alias("mask"))
    wanted = materialise(ends.groupBy("s").agg(F.bit_or("mask").alias("mask")))
    contents = materialise(_contents(docs, text, width, wanted))
    counted = materialise(partial_overlaps(pairs, contents))
    release(wanted, contents)
    return counted


def partial_overlaps(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(u, v, n, m, …, shared) of the pairs (u, v, n, m, …, same, apart): overlaps of each piece, summed."""
    kept = [c for c in pairs.columns if c not in ("same", "apart")]
    left, right = (contents.select(F.col("s").alias(x), "k", F.col("part").alias(f"{x}_part")) for x in ("u", "v"))
    spread = pairs.select(*kept, "same", F.explode("apart").alias("k"))
    counted = spread.join(left.hint("merge"), ["u", "k"]).join(right.hint("merge"), ["v", "k"])
    counted = counted.select(*kept, "same", F.size(F.array_intersect("u_part", "v_part")).cast("long").alias("c"))
    whole = [F.max(c).alias(c) for c in (*kept[2:], "same")]
    return counted.groupBy("u", "v").agg(*whole, F.sum("c").alias("c")).select(*kept, (F.col("same") + F.col("c")).alias("shared"))


def verified_links(
    pairs: DataFrame,
    profiles: DataFrame,
    docs: DataFrame,
    text: str = "text",
    width: int = WIDTH,
    percent: int = MIN_PERCENT,
    trial: int = PIECES,
) -> DataFrame:
    """(u, v) of the different candidate pairs (u, v) that reach the similarity.

    `profiles` (s, n, sizes, digests) has one row for each set of the pairs; contents are read from `docs`. With a `trial`, that many
    differing pieces are counted first, and the others only for pairs that may still be similar: one more pass over
    the texts, and a fraction of the contents where few candidates are similar.
    """
    close = materialise(_told_apart(pairs, profiles, percent, trial))
    counted = _overlaps(close, docs, text, width)
    alike = similar(F.col("shared"), F.col("n"), F.col("m"), percent)
    if trial >= PIECES:
        links = materialise(counted.where(alike).select("u", "v"))
        release(close, counted)
        return links
    rest = F.expr(f"filter(sequence(0, {PIECES - 1}), k -> (shiftright(left, k) & 1) = 1)").alias("apart")
    hopeful = counted.where("left <> 0").where(_near_enough(F.col("tried") - 2 * F.col("shared") + F.col("least"), percent))
    hopeful = materialise(hopeful.select("u", "v", "n", "m", F.col("shared").alias("same"), rest))
    whole = _overlaps(hopeful, docs, text, width)
    links = materialise(counted.where("left = 0").where(alike).select("u", "v").union(whole.where(alike).select("u", "v")))
    release(close, counted, hopeful, whole)
    return links


def crowd_pairs(crowd: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(u, v) of the sets of `crowd` (s, label) that may be similar and have different labels."""
    # The shingles of a set in one row, never of a group; copies go before the shuffle.
    whole = _set_pieces(docs, text, width, crowd.select("s")).select("s", F.flatten("pieces").alias("tokens"))
    sets = materialise(whole.dropDuplicates(["s"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held += np.bincount((tokens % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["bucket", "c"])

    # A row a bucket at most. They set the order of all sets, so collisions cost candidates, never links.
    found = sets.mapInArrow(count, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    rarity = np.zeros(BUCKETS, np.int64)
    rarity[found.column("bucket").to_numpy()] = found.column("c").to_numpy()
    order = docs.sparkSession.sparkContext.broadcast(rarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prefixes = [], []
            for tokens in batch.column(1):
                h = tokens.values.to_numpy(zero_copy_only=False)
                rank = order.value[(h.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)]
                size.append(len(h))
                prefixes.append(h[np.lexsort((h, rank))[: len(h) - (percent * len(h) + 99) // 100 + 1]])
            lists = pa.array(prefixes, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), lists], ["s", "n", "prefix"])

    short = materialise(sets.mapInArrow(cut, "s bigint, n bigint, prefix array<bigint>").join(crowd, "s"))
    placed = short.select("s", "n", "label", "prefix", F.posexplode("prefix").alias("i", "token"))
    a = placed.select("token", *[F.col(c).alias(x) for c, x in (("s", "u"), ("n", "n"), ("label", "x"), ("prefix", "p"), ("i", "i"))])
    b = placed.select("token", *[F.col(c).alias(x) for c, x in (("s", "v"), ("n", "m"), ("label", "y"), ("prefix", "q"), ("i", "j"))])
    most = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    near = (F.col("u") < F.col("v")) & (F.col("x") != F.col("y")) & similar(most, F.col("n"), F.col("m"), percent)
    at_first = F.get(F.array_intersect("p", "q"), F.lit(0)) == a["token"]
    return a.join(b, (a["token"] == b["token"]) & near & at_first).select("u", "v")


def jaccard_classes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = MIN_PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; a class is named by its smallest id."""
    found = materialise(_table(docs, id_column, text, width, percent))
    some = found.where("n > 0")
    distinct = materialise(some.groupBy("s").agg(F.min(id_column).alias("__first"), F.max("n").alias("n")))
    # Copies give the same rows, which are combined before the shuffle. Joins are sorted ones at every size.
    signed = some.select("s", F.explode("sigs").alias("h"))
    met = signed.groupBy("h").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("h")
    members = materialise(signed.join(met.hint("merge"), "h").distinct())
    meets = members.groupBy("h").agg(F.count(F.lit(1)).alias("n_sets"))
    weight = members.join(meets, "h").groupBy("s").agg(F.sum("n_sets").alias("weight"))
    members = materialise(members.join(weight.hint("merge"), "s"))
    shared = weight.select("s").hint("merge")
    profiles = materialise(some.select("s", "n", "sizes", "digests").join(shared, "s", "left_semi").dropDuplicates(["s"]))

    verified = lambda pairs: verified_links(pairs, profiles, docs, text, width, percent)
    leads = members.groupBy("h").agg(F.max(F.struct("weight", "s")).alias("lead")).select("h", F.col("lead.s").alias("lead"))
    stars = members.join(leads, "h").where("s <> lead")
    stars = materialise(stars.select(F.least("s", "lead").alias("u"), F.greatest("s", "lead").alias("v")).distinct())
    links = verified(stars)
    labels = materialise(component_labels(links)).withColumnRenamed("node", "s")
    named = materialise(members.select("h", "s").join(labels, "s", "left").withColumn("label", F.coalesce("label", "s")))
    split = named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    rest = materialise(named.join(split, "h", "left_semi"))
    held = rest.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    rest = materialise(rest.join(held, "h"))
    few = rest.where(F.col("held") <= CROWD)
    a = few.select("h", F.col("s").alias("u"), F.col("label").alias("x"))
    b = few.select("h", F.col("s").alias("v"), F.col("label").alias("y"))
    pairs = a.join(b, "h").where("u < v AND x <> y").select("u", "v")
    crowd = materialise(rest.where(F.col("held") > CROWD).select("s", "label").distinct())
    if not crowd.isEmpty():
        pairs = pairs.union(crowd_pairs(crowd, docs, text, width, percent))
    links = links.union(verified(pairs.distinct().join(stars, ["u", "v"], "left_anti")))
    labels = component_labels(links).withColumnRenamed("node", "s")
    classed = distinct.join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))
    least = classed.groupBy("label").agg(F.min("__first").alias("component_id"))
    classes = classed.join(least, "label").select("s", "component_id")
    named = some.select(id_column, "n", "s").join(classes, "s").select(id_column, F.col("n").alias("n_shingles"), "component_id")
    none = found.where("n = 0").select(id_column, F.col("n").alias("n_shingles"), F.col(id_column).alias("component_id"))
    return named.union(none)
