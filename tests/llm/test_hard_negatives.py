"""Hard negatives against scoring every pair in Python's integers."""

import math
import random

import pytest

from stowage.llm import hard_negatives
from stowage.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int, id string"
ODD = [(None, [1.0] * 8, 1), (9001, None, 1), (9002, [1.0] * 7 + [None], 1), (9003, [float("nan")] + [1.0] * 7, 2), (9004, [float("inf")] * 8, 2), (9005, [1.0] * 8, None), (9006, [0.0] * 8, 3), (9010, [1.0] * 5, 1), (9020, [1.0] * 5, 2), (9030, [], 4), (9040, [], 5)]


def brute(rows, anchors, positives=5, negatives=5):
    good = {(i, l, tuple(v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, l, v in good:
        if not anchors(i):
            continue
        score = lambda w: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))  # noqa: B023, E731
        near = [(-score(w), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in near if x[2] == l)[:positives]:
            fit = sorted((n, k) for n, k, m in near if m != l and 80 * -p <= 100 * -n <= 100 * -p)
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit[:negatives])]
    return sorted(out)


def rows(n=300, dim=8, seed=1):
    rng = random.Random(seed)
    made = [(i, [rng.choice([-0.5, 0.25, 0.5, 0.75]) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    hot = [(1000 + i, made[0][1], i % 2) for i in range(n // 2)]  # one vector a third of the rows hold, in two labels
    return made + hot + made[:20] + [(5, made[6][1], 1)] + ODD


def frame(spark, some):
    return spark.createDataFrame([(i, v, l, "r", 3, "x") for i, v, l in some], SCHEMA)


@pytest.mark.parametrize(("size", "block"), [(hard_negatives.PASS, hard_negatives.CANDIDATES), (700, 16)])
def test_against_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(hard_negatives, "PASS", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", block)
    some = rows()
    df = frame(spark, some)
    got = hard_negatives.mine(df, df.filter("vec_id % 10 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(some, lambda i: i % 10 == 0)


def test_few_rows_and_none(spark):
    few = [(10, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (30, [0.9, 0.1], 2)]
    df = frame(spark, few)
    assert sorted(map(tuple, hard_negatives.mine(df, df).collect())) == brute(few, lambda i: True)
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives.mine(df, df.limit(0)).count() == 0
    assert hard_negatives.mine(df.filter("label = 2"), df.filter("label = 2")).count() == 0


def test_scores_beyond_doubles(spark):
    """The last bits of scores above 2^53 decide."""
    big = 2.0**18
    some = [(0, [big, big, 1 / 256], 1), (1, [big, big, 2 / 256], 1), (2, [big, big, 1 / 256], 1), (3, [big, big, 0.0], 2), (4, [big, big, 1 / 256], 2)]
    df = frame(spark, some)
    got = sorted(map(tuple, hard_negatives.mine(df, df.filter("vec_id = 0")).collect()))
    assert got == brute(some, lambda i: i == 0) and got[0][4] > 2**53
    huge = frame(spark, [(0, [1e30], 1), (1, [1e30], 1)])
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(huge, huge)


def test_query_moves_labels(spark, tmp_path):
    some = [(i, v, None if l is None else l + 8) for i, v, l in rows(220, seed=4)]
    frame(spark, some).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (l + 1) % 10 if i is not None and l is not None and i % 7 == 0 else l) for i, v, l in some]
    assert sorted(map(tuple, op11_hard_negatives(spark, str(tmp_path)).collect())) == brute(moved, lambda i: i % 100 == 0)
