"""Every overlap that the rule admits is found, whatever words differ."""

from itertools import combinations

import brute
import numpy as np
import pyarrow as pa
import pytest

from riskscope.llm import decontaminate
from riskscope.llm.decontaminate import MIN_ITEM, MIN_SHARE, SPAN


def found(items, texts):
    return [[o[0] for o in one] for one in decontaminate.Index(items).overlaps(decontaminate.Tokens.of(pa.array(texts)))]


@pytest.mark.parametrize("width", range(MIN_ITEM, SPAN + 1))
def test_all_patterns_of_substitutions(width):
    item = [f"w{i}" for i in range(width)]
    most = max(k for k in range(width) if 100 * (width - k) >= MIN_SHARE * width)
    assert most == decontaminate.substitutions(width)
    patterns = [p for k in range(most + 1) for p in combinations(range(width), k)]
    texts = [" ".join(["pre"] * 3 + [f"x{i}" if i in p else w for i, w in enumerate(item)] + ["post"]) for p in patterns]
    assert found([" ".join(item)], texts) == [[0]] * len(texts)


def test_every_fifth_word_replaced():
    item = [f"w{i}" for i in range(200)]
    text = " ".join("x" if i % 5 == 4 else w for i, w in enumerate(item))
    assert brute.contaminated(text, [" ".join(item)], SPAN, MIN_SHARE) == [0] and found([" ".join(item)], [text]) == [[0]]


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_random_substitutions(share):
    rng = np.random.default_rng(7)
    items = [[f"w{k}x{i}" for i in range(n)] for k, n in enumerate([5, 7, 9, 10, 11, 12, 13, 15, 20, 30])]
    texts = [" ".join("y" if rng.random() < share else w for w in item) for item in items for _ in range(40)]
    items = [" ".join(item) for item in items]
    assert found(items, texts) == [brute.contaminated(t, items, SPAN, MIN_SHARE) for t in texts]


def test_joined_index_finds_the_same(spark):
    item = [f"w{i}" for i in range(12)]
    texts = [" ".join("x" if i in p else w for i, w in enumerate(item)) for p in combinations(range(12), 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    for rows in (0, 2_000_000):
        out = decontaminate.with_overlaps(docs, bench, index_rows=rows).collect()
        assert len(out) == len(texts) and all(len(r["__overlaps"]) == 1 for r in out)
