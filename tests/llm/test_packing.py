"""Packing: the plan's invariants, the library's ids, and whole pieces through Spark."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stowage.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(counts, capacity):
    made = packing.plan(dict(counts), capacity)
    got = Counter()
    for n, content in made:
        assert n > 0 and sum(length * k for length, k in content) <= capacity
        for length, k in content:
            got[length] += n * k
    assert +got == +Counter(counts)
    return sum(n for n, _ in made)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plans_hold_everything(counts):
    n = check_plan(counts, 30)
    total = sum(k * v for k, v in counts.items())
    assert n >= -(-total // 30)
    assert n <= 2 * -(-total // 30) + 1


def test_exact_complements_fill_sequences():
    assert check_plan({1500: 10, 548: 10}, 2048) == 10
    assert check_plan({1000: 4, 600: 4, 448: 4}, 2048) == 4
    assert check_plan({1000: 4, 600: 4, 300: 4, 148: 4}, 2048) == 4
    assert check_plan({2048: 7}, 2048) == 7
    assert check_plan({}, 2048) == 0


def test_near_the_bound_on_many_lengths():
    r = random.Random(1)
    counts = Counter(min(2048, int(r.paretovariate(1.1) * 60)) for _ in range(30_000))
    n = check_plan(counts, 2048)
    assert n <= 1.004 * -(-sum(k * v for k, v in counts.items()) // 2048)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]
    assert packing.cut(4, 4) == [(0, 4)]


def brute_pieces(tokenizer, doc, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    for n, (at, length) in enumerate(packing.cut(len(ids), capacity)):
        yield doc, n, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())


def test_whole_documents(spark):
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    words = "alpha beta gamma <|endoftext|> déjà \n\n   日本 1234".split(" ")
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 120))), "en", 7) for i in range(60)] + [(100, None, "en", 0), (101, "", "en", 0), (102, "long " * 700, "de", 1)]
    rows += [(200, "the same", "en", 1)] * 30  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, length int")
    got = packing.pack_documents(df, PATH, 64).collect()
    want = Counter(x for k, text, *_ in rows for x in brute_pieces(t, k, text, 64))
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    held = defaultdict(list)
    for g in got:
        held[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in held.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 64
    assert len(held) <= 1.05 * -(-sum(g["length"] for g in got) // 64) + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def best_fit_decreasing(counts, capacity):
    """Piece by piece: the fullest sequence that still takes it."""
    rooms = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else capacity) - length)
    return len(rooms)


def test_never_more_than_best_fit_decreasing():
    for seed in range(12):
        r = random.Random(seed)
        low, high = sorted(r.sample(range(1, 257), 2))
        counts = {k: r.randint(1, 6) for k in r.sample(range(low, high + 1), min(high - low + 1, r.randint(1, 90)))}
        assert check_plan(counts, 256) <= best_fit_decreasing(counts, 256)
    for lengths, low, high in ((800, 1, 2048), (300, 300, 1400), (200, 400, 900)):
        r = random.Random(5)
        counts = {k: r.randint(1, 3) for k in r.sample(range(low, high + 1), lengths)}
        assert check_plan(counts, 2048) <= best_fit_decreasing(counts, 2048)


def test_index_holds_all_sums():
    r = random.Random(3)
    for _ in range(20):
        counts = {k: r.randint(1, 3) for k in r.sample(range(1, 60), 8)}
        index = packing.Complements(counts, 100)
        for first in list(counts):
            gap = 100 - first
            pieces = list((Counter(counts) - Counter([first])).elements())
            reach = {1: set(pieces), 2: {a + b for i, a in enumerate(pieces) for b in pieces[:i]}}
            reach[3] = {a + b + c for i, a in enumerate(pieces) for j, b in enumerate(pieces[:i]) for c in pieces[:j]}
            fewest = next((n for n in (1, 2, 3) if gap in reach[n]), None)
            for large in (False, True):
                found = index.fill(first, large)
                assert (found is None) == (fewest is None)
                if found:
                    assert found[0] == first and sum(found) == 100 and len(found) == 1 + fewest and index.available(found)


def test_vocabulary_in_another_order_is_refused(tmp_path):
    import json

    import pytest

    with open(PATH, encoding="utf-8") as f:
        told = json.load(f)
    merges = told["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    with open(tmp_path / "other.json", "w", encoding="utf-8") as f:
        json.dump(told, f)
    with pytest.raises(ValueError, match="order"):
        packing.byte_bpe(str(tmp_path / "other.json"))


def test_long_runs_of_white_space(spark):
    """Runs that the faster library's pattern can't take: the ids are the library's all the same."""
    texts = [c * n for c in " \t\n\u00a0" for n in (999_998, 999_999, 2_000_000)]
    texts += [f"words before{c * 1_000_003}and after" for c in (" ", "\r\n")] + ["x" * 1_500_000, None, "", "x", "x"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(4)
    library = Tokenizer.from_file(PATH)
    got = defaultdict(dict)
    for g in packing.pack_documents(docs, PATH, 2048).collect():
        got[g["doc_id"]][g["piece"]] = (g["start"], g["length"], g["ids_crc32"])
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want = {n: (at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes())) for n, (at, k) in enumerate(packing.cut(len(ids), 2048))}
        assert got[i] == want
    assert packing.pack_documents(docs.limit(0), PATH, 2048).count() == 0
