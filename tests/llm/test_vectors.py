"""Vector operators against all pairs."""

import numpy as np
import pytest

from stowage.llm import ann, embedding_dedup

BAD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0] * 15 + [None]), (9005, [float("nan")] + [1.0] * 15), (9006, [float("inf")] + [1.0] * 15), (9007, [1.0] * 7)]


def vectors(n=400, dim=16, seed=0, unit=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):  # near copies of the first half
        x[i] = x[i % 20] + rng.standard_normal(dim) * rng.choice([0.02, 0.08, 0.3])
    x[n - 40 :] = x[3]  # equal vectors
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def frame(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(0, x[0].tolist()), (None, x[0].tolist())]
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, rank int, component_id string")


def brute(x, threshold):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= threshold
    np.fill_diagonal(close, False)
    return close.sum(1), embedding_dedup.linked_groups(close)


@pytest.mark.parametrize(("block", "group"), [(2048, 16384), (16, 16384), (16, 40), (16, 1)])
def test_links_and_groups(spark, monkeypatch, block, group):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "GROUP", group)
    x = vectors()
    alone = [9.0, -9.0] * 8
    df = frame(spark, x)
    more = spark.createDataFrame([(None, alone, 1, "c"), (None, [c * 2 for c in alone], 1, "c"), (None, None, 1, "c")], df.schema)
    every = embedding_dedup.near_duplicates(df.unionByName(more), 0.95).collect()
    links, groups = brute(x, 0.95)
    # rows without a key: one that equals row 0, two that link with each other only, one without a vector
    assert sorted((g["n_links"], str(g["component_id"]), g["kept"]) for g in every if g["vec_id"] is None) == sorted([(links[0] + 1, "0", False), (1, "None", True), (1, "None", True), (0, "None", True)])
    got = [g for g in every if g["vec_id"] is not None]
    links = links + (x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0]) >= 0.95)
    of = {g["vec_id"]: g for g in got}
    assert len(got) == len(of) == len(x) + len(BAD)
    for i in range(len(x)):
        assert (of[i]["n_links"], of[i]["component_id"], of[i]["kept"]) == (links[i], groups[i], groups[i] == i), i
    for i, _ in BAD:
        assert (of[i]["n_links"], of[i]["component_id"], of[i]["kept"]) == (0, i, True)
    assert embedding_dedup.near_duplicates(frame(spark, x).limit(0)).count() == 0


def test_both_zeros_are_equal(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (2, [-0.0, 1.0, 2.0]), (3, [1.0, 0.0, -0.0]), (4, [1.0, -0.0, 0.0])]
    for kind in ("float", "double"):
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_partners_at_the_threshold_share_a_filter():
    rng = np.random.default_rng(2)
    for n, dim in ((10_000, 64), (300_000, 64), (100_000, 256)):
        code = embedding_dedup.choose_code(n, dim, 0.95)
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal(x.shape)
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = embedding_dedup.decode(x, code), embedding_dedup.decode(y, code)
        assert sum(not np.intersect1d(p, q).size for p, q in zip(a, b)) <= 1


def test_decoding_equals_visiting_every_filter():
    code = embedding_dedup.Code(12, 2, 9, 0.35, 1)
    x = np.random.default_rng(3).standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, (a, b) = code.directions()
    every = np.array([np.r_[p, q] for p in a for q in b])
    score = x @ rotation @ every.T
    for row, found in zip(score, embedding_dedup.decode(x, code)):
        want = np.nonzero(row >= code.alpha)[0]
        if len(want):
            assert sorted(found.tolist()) == want.tolist()
    assert np.allclose(np.linalg.norm(every, axis=1), 1)


@pytest.mark.parametrize("unit", [True, False])
def test_nearest_rows(spark, monkeypatch, unit):
    monkeypatch.setattr(ann, "PART", 150)
    monkeypatch.setattr(ann, "QUERIES", 20)
    x = vectors(unit=unit)
    df = frame(spark, x)
    got = ann.nearest(df, df.filter("vec_id % 10 = 0"), 20).collect()
    of = {}
    for g in sorted(got, key=lambda g: (g["query_id"], g["rank"])):
        of.setdefault(g["query_id"], []).append((g["vec_id"], g["score"], g["rank"]))
    hits = total = 0
    u = x.astype(np.float64)
    for q in range(0, len(x), 10):
        s = ann.exact(u, u[q])
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert [r for *_, r in of[q]] == list(range(1, 21))
        for i, score, _ in of[q]:
            assert score == s[i]
        assert of[q] == sorted(of[q], key=lambda t: (-t[1], t[0]))
        hits += len({i for i, *_ in of[q]} & set(want))
        total += 20
    assert hits / total >= 0.95
    assert ann.nearest(df.limit(0), df, 20).count() == 0
    assert ann.nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0"), 20).count() == 4


def test_chi_square():
    assert ann.chi_square_cdf(ann.stop_ratio(0.97)) == pytest.approx(0.97)
    draws = (np.random.default_rng(0).standard_normal((20_000, ann.PROJECTED)) ** 2).sum(1)
    assert (draws <= ann.stop_ratio(0.9)).mean() == pytest.approx(0.9, abs=0.01)


def test_doubles_stay_doubles(spark):
    x = [[1.0 + 1e-12, 0.0], [1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {(g["query_id"], g["vec_id"]): g["score"] for g in ann.nearest(df, df.filter("vec_id = 0"), 2).collect()}
    assert got == {(0, 1): 1.0 + 1e-12, (0, 2): 0.0}
    assert {g["vec_id"]: g["n_links"] for g in embedding_dedup.near_duplicates(df).collect()} == {0: 1, 1: 1, 2: 0}
