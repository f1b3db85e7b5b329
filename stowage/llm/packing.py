"""Best-fit packing of tokenized documents by exact-complement hashing.

Only the histogram of piece lengths (``capacity`` counts at most, whatever the input) reaches the driver.  The
plan made from it says how many sequences hold which combination of lengths; a distributed join on (length,
rank within the length) then deals the pieces to their places.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import materialize, parallelism

#: How the tokenizer file splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_READY: dict[str, tiktoken.Encoding] = {}
_LIBRARY: dict[str, Tokenizer] = {}


def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE file ``path`` with its ids as ranks: the same ids, several times faster."""
    if path not in _READY:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        step = told["pre_tokenizer"]
        if told["normalizer"] is not None or (step["type"], step["add_prefix_space"], step["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: other steps than byte-level splits")
        back = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(back[s] for s in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        # ids serve as ranks, so they must be in the order of the merges
        merges = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        made = [told["model"]["vocab"][m.replace(" ", "")] for m in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(ranks) or made[0] < 256:
            raise ValueError(f"{path}: ids are not in the order of the merges")
        _READY[path] = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _READY[path]


def ids_of(path: str, text: str | None) -> list[int]:
    """Ids as the tokenizer file has them, special tokens' strings included.

    A run of some 1,000,000 white-space characters is more than the faster library's pattern can take; such a text goes to the file's own library.
    """
    try:
        return byte_bpe(path).encode(text or "", allowed_special="all")
    except ValueError:
        if path not in _LIBRARY:
            _LIBRARY[path] = Tokenizer.from_file(path)
            _LIBRARY[path].no_truncation()
            _LIBRARY[path].no_padding()
        return _LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(documents: DataFrame, path: str, capacity: int = 2048, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Tokenize every whole text (null: empty), end it with ``end_id`` and cut it: (doc_id, piece, start, length, ids_crc32).

    A text may be of any length, and hold runs of one kind of character of any length.  Rows without a key and repeated rows are cut as often as
    they come; an empty table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, told in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*ids_of(path, told.as_py()), end_id], dtype="<u4")
                for n, (at, length) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(out, (doc, n, at, length, zlib.crc32(ids[at : at + length].tobytes()))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col(key).cast("long"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Made = list[tuple[int, tuple[tuple[int, int], ...]]]


class Complements:
    """Lengths that are left, and an index of the sums of one, two and three of them.

    Each index is the bits of an integer (bit t: some combination sums to t), so a shift and an OR add a length to all sums
    at once.  Lengths that were used up may still be in the index; availability counts decide.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, Counter({k: n for k, n in counts.items() if n})
        self.index()

    def index(self) -> None:
        every = (1 << (self.capacity + 1)) - 1
        one = two = three = 0
        for k in self.left:
            one |= 1 << k
        for k in self.left:
            two |= one << k & every
        for k in self.left:
            three |= two << k & every
        self.sums, self.gone = (one, two, three), 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            del self.left[length]
            self.gone += 1
            if self.gone > 64:  # keep the index close to what is left
                self.index()

    def available(self, combination: tuple[int, ...]) -> int:
        """How often ``combination`` can be taken."""
        return min(self.left[x] // n for x, n in Counter(combination).items())

    def complement(self, total: int, most: int, large: bool, less: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Up to ``most`` lengths of this sum that are available besides ``less``, by its larger members.

        One length if that fits.  Else the most even combination, or (``large``) the one with the largest member.
        """
        if total > 0 and self.left[total] and self.available((*less, total)):
            return (total,)
        if most == 1 or not any(self.sums[k] >> total & 1 for k in range(1, most)):
            return None
        fewest = -(-total // most)
        members = range(total - 1, fewest - 1, -1) if large else range(fewest, total)
        rest = self.sums[most - 2]
        for a in members:
            if self.left[a] and (rest >> (total - a) & 1 or most == 3 and self.sums[0] >> (total - a) & 1):
                others = self.complement(total - a, most - 1, large, (*less, a))
                if others and self.available((*less, a, *others)):
                    return a, *others
        return None

    def fill(self, first: int, large: bool, upto: int = 3) -> tuple[int, ...] | None:
        """``first`` and the fewest other lengths, ``upto`` at most, that fill the gap beside it exactly."""
        gap = self.capacity - first
        if gap == 0:
            return (first,)
        for most in range(1, upto + 1):
            if found := self.complement(gap, most, large, (first,)):
                return first, *found
        return None


def exact(counts: dict[int, int], capacity: int, large: bool, upto: int) -> tuple[Made, list[tuple[int, int]]]:
    """Sequences that a length and ``upto`` others at most fill exactly, from the longest length down and as often as the counts allow at once; and the rest."""
    index = Complements(counts, capacity)
    done: Made = []
    residue: list[tuple[int, int]] = []
    for length in sorted(index.left, reverse=True):
        while index.left[length]:
            found = index.fill(length, large, upto)
            if found is None:
                residue.append((length, index.left[length]))
                index.take(length, index.left[length])
                break
            n = index.available(found)
            for x, k in Counter(found).items():
                index.take(x, n * k)
            done.append((n, tuple(sorted(Counter(found).items(), reverse=True))))
    return done, residue


def best_fit(residue: list[tuple[int, int]], capacity: int) -> Made:
    """Lengths, longest first, each into the open sequence with the least room that still takes it."""
    rooms: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # open sequences by room
    for length, n in residue:
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                held = capacity // length
                whole, rest = divmod(n, held)
                for times, copies in ((whole, held), (1, rest)):
                    if times and copies:
                        rooms.setdefault(capacity - copies * length, []).append((times, ((length, copies),)))
                break
            times, content = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            held = room // length
            used = min(times, n // held) if n >= held else 0
            if used:
                rooms.setdefault(room - held * length, []).append((used, (*content, (length, held))))
                n -= used * held
            else:
                used = 1
                rooms.setdefault(room - n * length, []).append((1, (*content, (length, n))))
                n = 0
            if times > used:
                rooms.setdefault(room, []).append((times - used, content))
    return [x for same in rooms.values() for x in same]


def plan(counts: dict[int, int], capacity: int) -> Made:
    """Sequences that hold all pieces: (how many, ((length, copies), ...)).

    Combinations that fill a sequence exactly are consumed, then what is left goes by best fit, longest first.  Exact triples may
    use up the short pieces that long ones need, so the plan is made with triples, pairs and singles as the largest
    complements, and with even or with large members; the one with the fewest sequences is taken, and none has more than best fit
    alone, the last of them.  Work and result depend on the number of different lengths only.
    """
    made = []
    for upto, large in ((3, False), (3, True), (2, False), (1, False), (0, False)):
        done, residue = exact(counts, capacity, large, upto)
        made.append(done + best_fit(residue, capacity))
    return min(made, key=lambda m: sum(n for n, _ in m))


def places(made: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies, offset) of each part of the plan."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for n, content in made:
        offset = 0
        for length, copies in content:
            out.append((length, used[length], n * copies, sequence, copies, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pack(parts: DataFrame, capacity: int = 2048, *, salts: int | None = None) -> DataFrame:
    """Give every piece (any columns, ``length`` of 1..capacity among them) a ``sequence_id`` and an ``offset`` in it.

    Offsets in a sequence have no gaps.  Ranks within a length are taken in hash salts, so a length that most
    pieces share is no single task's; pieces that are equal in all columns are told apart by a number given when they were stored.
    The plan that is broadcast has at most ``capacity`` lengths times the combinations each is in, whatever the input.
    """
    spark = parts.sparkSession
    salts = salts or max(64, parallelism(spark))
    stored = materialize(parts.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    salted = stored.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("_row")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    schema = "length long, _first long, _ranks long, _sequence long, _copies long, _at long"
    where = F.broadcast(spark.createDataFrame(places(plan(counts, capacity)), schema))
    nth = F.col("_rank") - F.col("_first")
    return (
        ranked.join(where, "length").filter((nth >= 0) & (nth < F.col("_ranks")))
        .withColumn("sequence_id", F.col("_sequence") + F.call_function("div", nth, F.col("_copies")))
        .withColumn("offset", F.col("_at") + F.pmod(nth, F.col("_copies")) * F.col("length"))
        .select(*parts.columns, "sequence_id", "offset")
    )


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack whole documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null text is an empty one, whose only id is the end; a text of any length is cut and none is left out.  Repeated rows and rows without
    a key are packed as often as they come; an empty table gives no sequences; further columns are ignored.
    """
    return pack(pieces(documents, path, capacity), capacity)
