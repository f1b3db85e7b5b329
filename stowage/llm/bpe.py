"""BPE encoding and decoding with a tokenization automaton.

A word's BPE encoding is the only path of tokens over it in which every two neighbours could stand side by side
after all merges.  The token automaton's states are the tokens last read (and a start); the arc ``x -y-> y`` exists
if ``y`` may follow ``x``.  It starts with arcs between all alphabet symbols, and the gadget of the merge
``(a, b) -> c`` then removes the arc ``a -b->``, adds ``c`` with the arcs that leave ``b``, and lets every state that had an arc
``a`` have an arc ``c``.  So an arc of a younger token was copied from an older token's arc, and ``Automaton.arc``
replays the gadgets for one arc.

Words are read by the deterministic automaton over symbols that the subset construction makes of it: a state holds, for each place
where a token may have begun, the token before and how far the trie of tokens was read since.  After each symbol exactly one
token can end there, the last one of the encoding of what was read, and the table names it.  With 48,894 merges
the whole table would have billions of entries, so a state's row is made when a word first needs it, and kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Compiled arcs, table entries and encoded words that a worker keeps; when full, a store starts anew (results do not change).
MAX_ARCS, MAX_ENTRIES, MAX_WORDS = 1_000_000, 500_000, 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """Compiled merges: encode a word of symbols to token ids, and ids to the labels of their arcs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.label = {i: t for t, i in vocab.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, gadget's number
        self.merged: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.parts.setdefault(whole, (vocab[a], vocab[b], n))
            self.merged.setdefault((vocab[a], vocab[b]), n)
        self.arcs: dict[int, bool] = {}
        dead = {c for c, (a, b, n) in self.parts.items() if not self._replay(a, b, n)}  # gadgets that found no such arc
        self.nodes: list[dict[str, int]] = [{}]  # the trie of tokens: children by symbol
        self.ends: list[int | None] = [None]
        self.span: dict[int, int] = {}
        for token, i in vocab.items():
            if i in dead:
                continue
            path = self.symbols(token[: -len(suffix)], True) if suffix and token.endswith(suffix) else self.symbols(token, False)
            at = 0
            for symbol in path:
                if symbol not in self.nodes[at]:
                    self.nodes[at][symbol] = len(self.nodes)
                    self.nodes.append({})
                    self.ends.append(None)
                at = self.nodes[at][symbol]
            self.ends[at], self.span[i] = i, len(path)
        self.reset()

    def symbols(self, word: str, last: bool) -> list[str]:
        """Symbols of a word, the last one marked by the suffix where the word ends there."""
        return [*word[:-1], word[-1] + self.suffix] if last and word else list(word)

    def reset(self) -> None:
        """The table with its start only: before any symbol a token may begin, with none before it."""
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {((0, -1),): 0}
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.table: list[dict[str, tuple[int, int]]] = [{}]
        self.entries = 0

    def arc(self, x: int, y: int) -> bool:
        """True if the table has the arc from state ``x`` to ``y`` after all gadgets."""
        known = self.arcs.get(x << 32 | y)
        if known is None:
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            known = self.arcs[x << 32 | y] = self._replay(x, y, len(self.merged))
        return known

    def _replay(self, x: int, y: int, limit: int) -> bool:
        """Whether the arc was there before gadget ``limit``, from the last gadget back: it is gone once an earlier gadget merges its ends, and a younger token's arcs are those its part had when its gadget ran."""
        parts, merged = self.parts, self.merged
        while True:
            gone = merged.get((x, y))
            if gone is not None and gone < limit:
                return False
            of_x, of_y = parts.get(x), parts.get(y)
            born_x, born_y = of_x[2] if of_x else -1, of_y[2] if of_y else -1
            if born_x < 0 and born_y < 0:
                return True
            if born_x > born_y:  # x's arcs were copied from its right part's before that gadget removed any
                x, limit = of_x[1], born_x
            else:  # y's arcs came where its left part had one, new states included, after that gadget removed its own
                y, limit = of_y[0], born_y + 1

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The table's entry: the next state, and the token that ends with ``symbol``."""
        ended, open_ = None, []
        for node, x in self.states[state]:
            to = self.nodes[node].get(symbol)
            if to is None:
                continue
            y = self.ends[to]
            if y is not None and ended is None and (x < 0 or self.arc(x, y)):
                ended = y
            if self.nodes[to]:
                open_.append((to, x))
        if ended is None:
            raise ValueError(f"no token ends with {symbol!r}")
        key = (*open_, (0, ended))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.table.append({})
        self.entries += 1
        found = self.table[state][symbol] = (number, ended)
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-split word, given as symbols: one table entry for each symbol, then back along the tokens that ended."""
        if self.entries > MAX_ENTRIES:
            self.reset()
        state, table, ended = 0, self.table, []
        for symbol in self.symbols(word, True):
            found = table[state].get(symbol)
            state, y = found if found is not None else self.step(state, symbol)
            ended.append(y)
        ids, at = [], len(ended)
        while at:
            ids.append(ended[at - 1])
            at -= self.span[ids[-1]]
        return ids[::-1]


#: Texts without these have only code points that have long been assigned.
RARE = re.compile("[^\0-\u0377\u2010-\u2027\u2030-\u205e]")
#: A character of each class that the splits tell apart, none of them part of a contraction.
STAND_INS = {r"\p{L}+": "a", r"\p{N}+": "0", r"\s+": " "}


@cache
def stand_ins() -> dict[int, str]:
    """Code points that the tokenizers library puts into another class than the ``regex`` module does, and a character of the library's class."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    theirs, ours = np.full(len(every), "!"), np.full(len(every), "!")
    for pattern, stands in STAND_INS.items():
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            theirs[a:b] = stands
        for m in regex.finditer(pattern, every):
            ours[m.start() : m.end()] = stands
    return {ord(every[i]): str(theirs[i]) for i in np.flatnonzero(theirs != ours)}


@cache
def unassigned() -> re.Pattern:
    """Code points that Python's Unicode tables do not know; the library's may be newer."""
    known = np.fromiter((unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], known, [True]]).astype(np.int8)))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2)) + "]")


class WordBpe:
    """The steps of a tokenizer file (normalizer, splits, byte symbols, merges) around the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        steps = told["normalizer"]["normalizers"] if told["normalizer"] else []
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or told["decoder"] is not None or told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != known:
            raise ValueError(f"{path}: other steps than this class knows")
        self.words = regex.compile(known)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.symbols = byte_symbols()
        self.ids: dict[str, str] = {}
        self.labels: dict[str, str] = {}

    def normalize(self, text: str) -> str:
        """NFC, then lower case character by character; runs of white space stay, as the splits drop them anyway.

        Texts with code points younger than Python's tables are normalized by the library, whose tables the ids depend on.
        """
        if text.isascii():
            return text.lower()
        if RARE.search(text) and unassigned().search(text):
            return self.normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def split(self, text: str) -> list[str]:
        """Words of a normalized text, by the library's classes of letters, numbers and spaces."""
        if RARE.search(text):
            told = text.translate(stand_ins())
            if told != text:
                return [text[m.start() : m.end()] for m in self.words.finditer(told)]
        return self.words.findall(text)

    def word(self, word: str) -> list[int]:
        return self.automaton.encode("".join([self.symbols[b] for b in word.encode()]))

    def learn(self, words: set[str]) -> None:
        """Keep ids in decimal and arcs' labels, each joined by spaces, of ``words``."""
        if len(self.ids) + len(words) > MAX_WORDS:
            self.ids.clear()
            self.labels.clear()
        label = self.automaton.label
        for w in words:
            found = self.word(w)
            self.ids[w] = " ".join(map(str, found))
            self.labels[w] = " ".join([label[i] for i in found])

    def both(self, text: str) -> tuple[str, str]:
        """Ids and labels of a whole text, each joined by spaces."""
        ids: list[str] = []
        labels: list[str] = []
        for k, piece in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                ids.append(str(self.special[piece]))
                labels.append(piece)
                continue
            piece = self.normalize(piece)
            words = self.split(piece)
            found = list(map(self.ids.get, words))
            if None in found:
                self.learn({w for w, x in zip(words, found) if x is None})
                found = list(map(self.ids.get, words))
                if None in found:  # the store was emptied meanwhile
                    self.learn(set(words))
                    found = list(map(self.ids.get, words))
            ids += found
            labels += map(self.labels.get, words)
        return " ".join(ids), " ".join(labels)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.both(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Labels of the ids' arcs, joined by spaces, as this file names no other decoder."""
        of_special = {i: t for t, i in self.special.items()}
        return " ".join(of_special.get(i) or self.automaton.label[i] for i in ids)


_READY: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One compiled automaton for each worker process."""
    if path not in _READY:
        _READY[path] = WordBpe(path)
    return _READY[path]


def encode(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded text of every row: (key, ids array<int>, decoded).  A null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            both = [bpe.both(t or "") for t in batch.column(1).to_pylist()]
            ids = [[int(i) for i in a.split()] for a, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([b for _, b in both], pa.string())], ["key", "ids", "decoded"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`encode`, but only (key, n_tokens, ids_sha256, decoded_sha256), made where the row is encoded.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded text in UTF-8.
    Null and empty texts have no tokens; every row, repeated ones too, is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids, labels = bpe.both(t.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(labels.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
