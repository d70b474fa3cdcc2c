"""Group folds that are even in rows and positives."""

import numpy as np
import pytest

from riskscope.operators import folds


@pytest.mark.parametrize("seed", range(4))
def test_deal_is_even(seed):
    rng = np.random.default_rng(seed)
    classes = sorted({(int(n), int(rng.integers(0, n + 1))) for n in rng.integers(1, 40, 60)})
    classes = [(n, p, int(rng.integers(1, 30))) for n, p in classes]
    quotas = folds.deal_classes(classes, 5)
    assert [sum(q) for q in quotas] == [c for _, _, c in classes]
    rows = [sum(n * q[f] for (n, _, _), q in zip(classes, quotas)) for f in range(5)]
    pos = [sum(p * q[f] for (_, p, _), q in zip(classes, quotas)) for f in range(5)]
    assert max(rows) - min(rows) <= 40 and max(pos) - min(pos) <= 40


def test_folds_keep_groups_whole_and_repeat(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", int(rng.random() < 0.3)) for g in range(60) for _ in range(int(rng.integers(1, 20)))]
    rows += [("big", i % 2) for i in range(300)] + [(None, 1), ("none", None)]
    df = spark.createDataFrame(rows, "file string, label int")
    dealt = folds.balanced_group_folds(df, "file", "label", 4).collect()
    assert len(dealt) == 63 and {r.fold for r in dealt} == set(range(4)) and sum(r.n_rows for r in dealt) == len(rows)
    again = folds.balanced_group_folds(df.repartition(3), "file", "label", 4).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, again))
    others = [sum(r.n_rows for r in dealt if r.fold == f) for f in range(4) if not any(r.file == "big" and r.fold == f for r in dealt)]
    assert max(others) - min(others) <= 20
    assert folds.balanced_group_folds(df.limit(0), "file", "label", 4).count() == 0
