"""Whitening against sums in Python's integers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stowage.llm import whitening
from stowage.llm.queries import op13_whitening

BAD = [(9001, None), (9002, [1.0] * 7 + [None]), (9003, [float("nan")] + [1.0] * 7), (9004, [float("-inf")] * 8)]


def whole(rows, scale=64, shift=1_000_000):
    return [(i, tuple(math.floor(scale * c) + shift for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def covariance(fit):
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[i] for x in fit), n) for i in range(d)]
    return np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "w", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, x string, label int")


def vectors(n=200, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.linspace(0.2, 2, dim)
    made = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    return made + [(1000 + i, made[0][1]) for i in range(n // 2)] + [made[1], made[1], (None, made[2][1]), (None, None), (7, made[3][1])]


def held(got, rows, components):
    """Everything that the contract states, from the rows alone."""
    x = whole(rows)
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    v = covariance(fit)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(w, sums))) for i, w in x), key=str)
    assert sorted(((g["vec_id"], int(g["deviation"])) for g in got), key=str) == want
    assert {g["n"] for g in got} == {n}
    k = min(components, d)
    for g in got[:50]:
        assert len(g["whitened"]) == len(g["explained"]) == k
        assert g["explained"] == pytest.approx((e[:k] / np.trace(v)).tolist(), rel=1e-9)
    by_id = {i: w for i, w in x if i is not None and i != 7}
    some = [g for g in got if g["vec_id"] in by_id]
    centred = np.array([[float(a - Fraction(s, n)) for a, s in zip(by_id[g["vec_id"]], sums)] for g in some])
    have, plain = np.array([g["whitened"] for g in some]), centred @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((have * plain).sum(axis=0))
    assert np.allclose(have, plain * sign, atol=1e-8)
    errors = {g["identity_error"] for g in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_against_integers(spark):
    rows = vectors() + BAD
    got = whitening.whiten(frame(spark, rows), 5)
    assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    held(got.collect(), rows, 5)
    held(whitening.whiten(frame(spark, rows, "double"), 16).collect(), rows, 16)


def test_lengths_and_rank(spark):
    flat = [(i, [float(i % 5), 1.0, 2.0 * (i % 5)]) for i in range(20)]  # one direction only
    single = [(100, [1.0, 2.0]), (101, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, flat + single + [(200, [])] + BAD), 16).collect()
    by = {g["vec_id"]: g for g in got}
    assert len(by) == 23 and by[200]["whitened"] == [] and by[200]["deviation"] == 0 and by[200]["n"] == 1
    assert by[100]["whitened"] == [None, None] and by[100]["explained"] == [0.0, 0.0] and by[100]["identity_error"] is None and by[100]["deviation"] == 0
    assert by[0]["n"] == 5 and by[0]["whitened"][1:] == [None, None] and by[0]["explained"][0] == pytest.approx(1) and by[0]["identity_error"] < 1e-12
    assert np.var([by[i]["whitened"][0] for i in range(5)]) == pytest.approx(1)
    assert whitening.whiten(frame(spark, flat).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, BAD)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 + i * 3.0, float(i * i), -1e9]) for i in range(40)]
    held(whitening.whiten(frame(spark, rows, "double"), 2).collect(), rows, 2)
    with pytest.raises(Exception, match="after scaling"):
        whitening.whiten(frame(spark, [(1, [1e300]), (2, [1.0])], "double"))


def test_limbs():
    values = np.array([0, 1, -1, 2**31, -(2**31), 2**95 + 12345, -(3**80)], dtype=object)
    total = np.zeros(len(values), object)
    for place, limb in whitening.limbs(values):
        total += limb.astype(object) << whitening.LIMB * place
    assert total.tolist() == values.tolist()
    x = np.random.default_rng(0).integers(-(2**40), 2**40, (30, 4))
    assert whitening.exact_products(x).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in x.T] for p in x.T]


def test_query_rows(spark, tmp_path):
    rows = vectors(120, 20, 5) + BAD
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 16 * len(whole(rows))
    assert {g["component"] for g in got} == set(range(1, 17))
    first = [g["whitened"] for g in got if g["component"] == 1 and g["vec_id"] is not None and g["vec_id"] < 120 and g["vec_id"] != 7]
    assert abs(np.mean(first)) < 0.2
