"""The automaton against the tokenizers library, and its round trip through Spark."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stowage.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.WordBpe(PATH), t


def texts():
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéüñß '’.,!<|>0123456789AΣİ \nńẛ̣日\U0001d518"
    whole = ["<|endoftext|>", "<|startoftext|>", "aaaaaaaaaaaaa", "!!!!!!!", "it'll", "ﬁ", "Å", "\t  "]
    for _ in range(2000):
        yield "".join(r.choice(letters) if r.random() < 0.93 else r.choice(whole) for _ in range(r.randint(0, 40)))
    for n in range(1, 40):
        yield "a" * n
        yield "ha" * n


def test_equal_to_the_library(both):
    own, lib = both
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert own.both(t)[1] == own.decode(ids)


def test_small_caches_change_nothing(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "MAX_ARCS", 5)
    for t in list(texts())[:100] + ["one two three four five six seven eight nine ten"]:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_gadgets_on_a_toy_merge_list():
    """Every word over two letters, against merging by rank and from the left."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    machine = bpe.Automaton(vocab, merges)

    def by_rank(word):
        parts = list(word)
        for pair in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = [pair[0] + pair[1]]
                i += 1
        return parts

    for n in range(1, 11):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert [machine.label[i] for i in machine.encode(word)] == by_rank(word), word


def test_digests_of_odd_rows(spark, both):
    own, lib = both
    rows = [(1, "Hello there", "x", 5), (2, None, "x", 5), (3, "", "y", 6), (3, "", "y", 6), (4, "word " * 3000, None, None), (None, "null key", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(bpe.digests(df, PATH).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "") for k, t, *_ in rows if k == r["doc_id"])
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode(df, PATH).collect()}
    assert full[1]["ids"] == lib.encode("Hello there", add_special_tokens=False).ids
    assert full[2]["ids"] == [] and full[2]["decoded"] == ""
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_any_code_points(both):
    """Letters, numbers and cases of all of Unicode, also where Python's tables are older or newer than the library's."""
    own, lib = both
    r = random.Random(8)
    for _ in range(20_000):
        spans = (0x250, 0x3000, 0x20000, 0x110000)
        points = [r.randrange(r.choice(spans)) for _ in range(r.randint(1, 12))]
        t = "".join(chr(c) for c in points if not 0xD800 <= c < 0xE000)
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, ascii(t)
    for t in ("a\U00018fae~", "\U0001908cb", "xᲉy"):
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_a_long_word_takes_linear_time(both):
    import time

    own, lib = both
    r = random.Random(2)
    took = []
    for n in (20_000, 160_000):
        word = "".join(r.choice("etaoinshrdlu") for _ in range(n))
        began = time.process_time()
        assert own.encode(word) == lib.encode(word, add_special_tokens=False).ids
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]  # 64 times if it were quadratic


def test_a_small_table_changes_nothing(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "MAX_ENTRIES", 3)
    for t in ["one two three", "aaaaaaaaaaaaa", "strengths and weaknesses"]:
        own.ids.clear()
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    own.automaton.reset()
