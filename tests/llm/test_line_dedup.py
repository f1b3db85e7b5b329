"""Line dedup against dictionaries of lines, and its perfect hash."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from stowage.llm import line_dedup
from stowage.llm.queries import op12_line_dedup

BLANKS = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=3):
    holders = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append((n, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), ())
            known = [d for _, d in held if d is not None]
            if len(held) < min_docs or not known or doc == max(known):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows(seed=0):
    rng = random.Random(seed)
    lines = [f"A common LINE of text number {i} é" for i in range(30)] + ["short", "", "   ", "exactly twenty chars", "nineteen characters", "é" * 20, "É" * 19, " kept blank of another kind ", "İstanbul line with a dotted capital"]
    made = []
    for i in range(200):
        own = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(lines)) + rng.choice(["", "\v", "\f "]) for _ in range(rng.randrange(8))]
        made.append((i, "\n".join([*own, f"a line of document {i} alone, long enough"])))
    hot = [(300 + i, "the line that a third of all documents hold\n" + ("the line that a third of all documents hold\n" * (i % 3))) for i in range(100)]
    odd = [(None, "no id here, but a long line\nA common LINE of text number 1 é"), (None, "no id here, but a long line"), (None, "no id here, but a long line"), (None, None), (500, None), (501, ""), (502, "\n"), (503, "\n\n"), (7, made[3][1]), (7, made[3][1]), (-5, made[4][1])]
    return made + hot + odd + made[:5] + [(600, "x" * 3_000_000 + "\n" + "y" * 50), (601, "x" * 3_000_000 + " "), (602, "X" * 3_000_000)]


def frame(spark, some):
    return spark.createDataFrame([(d, t, "s", 1, "h", 2) for d, t in some], "doc_id long, text string, shard string, last int, high string, row int")


@pytest.mark.parametrize("shipped", [line_dedup.SHIPPED, 0])
def test_against_dictionaries(spark, monkeypatch, shipped):
    monkeypatch.setattr(line_dedup, "SHIPPED", shipped)
    monkeypatch.setattr(line_dedup, "SHARD", 10)
    monkeypatch.setattr(line_dedup, "PROBES", 40)
    monkeypatch.setattr(line_dedup, "TOGETHER", 7)
    some = rows()
    df = frame(spark, some)
    for least in (2, 3, 50):
        got = line_dedup.drop_repeated_lines(df, least)
        assert got.columns == ["doc_id", "kept", "n_lines", "n_dropped"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(some, least)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        line_dedup.drop_repeated_lines(df, 1)


def test_query_digests(spark, tmp_path):
    some = rows(3)
    frame(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, k, n, g in brute(some)), key=str)
    assert sorted(map(tuple, op12_line_dedup(spark, str(tmp_path)).collect()), key=str) == want


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000, 100_000):
        high, low = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        high[: n // 10] = high[0]  # equal halves are no trouble
        levels, bits = line_dedup.levels_of(high, low)
        shard = line_dedup.Shard(levels, bits)
        slots = shard.slots(high, low)
        assert sorted(slots.tolist()) == list(range(n))
        assert n < 1000 or 8 * len(bits) < 3.6 * n
        order = np.argsort(slots)
        shard = line_dedup.Shard(levels, bits, low[order].tobytes(), np.full(n, 3, "<i4").tobytes(), np.arange(n, dtype="<i8").tobytes())
        count, last = shard.look_up(high, low)
        assert (count == 3).all() and (last == slots).all()
        foreign = rng.integers(0, 2**64, 5000, dtype=np.uint64)
        assert not shard.look_up(foreign, foreign[::-1].copy())[0].any()
