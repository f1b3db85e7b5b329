"""Line dedup: hashes of repeated lines in a sharded minimal perfect hash, whose arrays the documents probe.

Lines never travel: each document sends the 128-bit hashes of its long lines once to be counted.  Hashes found in two or
more documents are dealt to shards, each of which becomes a bit table (Limasset et al., 2017) and three arrays: fingerprint,
count and last document.  Documents look their own hashes up there and drop lines where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism
from .simhash import numbered

#: \x20 and \x09-\x0D.
BLANKS = b" \t\n\v\f\r"
#: Keys of a shard, on average at most; below that there are shards for all tasks, with at least SMALL keys.
SHARD, SMALL = 1 << 18, 1 << 12
#: Bits of a level for each key still to be placed.
GAMMA = 2
#: Bytes of arrays that are shipped to every executor; an index beyond that stays where it is, and the hashes go to it.
SHIPPED = 64 << 20
#: Hashes that look a shard up in one task.
PROBES = 1 << 20
#: Documents whose hashes are looked up together.
TOGETHER = 512
INDEX = "shard int, levels array<long>, bits binary, prints binary, counts binary, lasts binary"


def key_of(line: bytes) -> bytes:
    """A line of UTF-8 without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def digest_of(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key has fewer than ``least`` code points."""
    key = key_of(line)
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def digests_of(text: bytes | None, least: int) -> list[bytes]:
    """The different digests of a text's long lines."""
    return [*({digest_of(line, least) for line in (text or b"").split(b"\n")} - {None})]


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key at a level, 0..size-1."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mixed(high ^ mixed(low + salt)) % np.uint64(size)).astype(np.int64)


def levels_of(high: np.ndarray, low: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes and bits of the levels for distinct keys: a bit is set where one key alone falls; the others go to the next level."""
    left, sizes, bits = np.arange(len(high)), [], []
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = place(high[left], low[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[at]]
    return sizes, b"".join(bits)


class Shard:
    """One minimal perfect hash and its arrays."""

    def __init__(self, levels: list[int], bits: bytes, prints: bytes = b"", counts: bytes = b"", lasts: bytes = b"") -> None:
        self.levels, self.words = levels, np.frombuffer(bits, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.prints, self.counts, self.lasts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<i4"), np.frombuffer(lasts, "<i8")

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's own number from 0, without gaps; a foreign key gets any number, or -1."""
        found, left, start = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.levels):
            at = start + place(high[left], low[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = self.before[at[hit] >> 6] + below[hit]
            left, start = left[~hit], start + size
        return found

    def look_up(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, the last of them); a key that is not here counts 0."""
        slot = self.slots(high, low)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == low[known]
        count, last = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        count[known], last[known] = self.counts[slot[known]], self.lasts[slot[known]]
        return count, last


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high.view("<i8") % shards).astype(np.int32)


def hashed(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(high, low, docs, last) of the long lines of some documents each: added up by batch, a document counting once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: dict[bytes, int] = {}
            last: dict[bytes, int | None] = {}
            for doc, told in zip(batch.column(0).to_pylist(), batch.column(1)):
                for d in digests_of(told.as_py(), least):
                    docs[d] = docs.get(d, 0) + 1
                    known = last.get(d)
                    last[d] = doc if known is None or doc is not None and doc > known else known
            high, low = halves([*docs])
            arrays = [pa.array(high.view("<i8")), pa.array(low.view("<i8")), pa.array(docs.values(), pa.int64()), pa.array([last[d] for d in docs], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["high", "low", "docs", "last"])

    rows = documents.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return rows.mapInArrow(run, "high long, low long, docs long, last long")


def index_of(documents: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 20) -> tuple[DataFrame, int]:
    """(shards, their number): a stored row for each shard of the index of keys found in two or more documents.

    A key found once needs no place: its fingerprint tells it apart from all others (by 64 bits beside the place itself).
    Counts end at 2^31-1.  A key that only documents without an id hold is left out: it is dropped nowhere.
    """
    found = hashed(documents, key, text, least).groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
    repeated = materialize(found.filter("docs >= 2 and last is not null"))
    keys = repeated.count()
    shards = max(1, -(-keys // SHARD), min(parallelism(documents.sparkSession), -(-keys // SMALL)))

    def build(name: tuple, table: pa.Table) -> pa.Table:
        high, low = (table[c].to_numpy().view("<u8") for c in ("high", "low"))
        levels, bits = levels_of(high, low)
        slot = Shard(levels, bits).slots(high, low)
        order = np.argsort(slot)
        counts = np.minimum(table["docs"].to_numpy(), 2**31 - 1).astype("<i4")
        made = [name[0].as_py(), levels, bits, low[order].tobytes(), counts[order].tobytes(), table["last"].to_numpy().astype("<i8")[order].tobytes()]
        types = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.table({f.split()[0]: pa.array([x], t) for f, x, t in zip(INDEX.split(", "), made, types)})

    dealt = repeated.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(build, INDEX)), shards


def without(text: bytes, drops: set[bytes], least: int) -> tuple[bytes, int, int]:
    """(the other lines joined, lines, dropped lines)."""
    lines = text.split(b"\n")
    kept = [line for line in lines if digest_of(line, least) not in drops] if drops else lines
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drops_in_place(documents: DataFrame, shipped: list[tuple], shards: int, min_docs: int, least: int) -> DataFrame:
    """Every document looks its hashes up in the index, which each executor holds."""
    index = documents.sparkSession.sparkContext.broadcast(shipped)  # SHIPPED bytes at most
    ready: dict[int, Shard] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.update({name: Shard(*arrays) for name, *arrays in index.value})
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                ids, texts = some.column(0), some.column(1).to_pylist()
                each = [digests_of(t, least) for t in texts]
                many = [len(d) for d in each]
                high, low = halves([d for own in each for d in own])
                own, no_id = (np.repeat(x.to_numpy(zero_copy_only=False), many) for x in (ids.fill_null(0), ids.is_null()))
                shard = shard_of(high, shards)
                drop = np.zeros(len(high), bool)
                order = np.argsort(shard, kind="stable")
                for here in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                    if found := ready.get(int(shard[here[0]])):
                        count, last = found.look_up(high[here], low[here])
                        drop[here] = (count >= min_docs) & (no_id[here] | (last != own[here]))
                marks = [{d for d, gone in zip(mine, gones) if gone} for mine, gones in zip(each, np.split(drop, np.cumsum(many)[:-1]))]
                yield result(ids, [without(t or b"", m, least) for t, m in zip(texts, marks)])

    return documents.mapInArrow(run, "id long, kept string, n_lines long, n_dropped long")


def result(ids: pa.Array, done: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    kept, lines, dropped = zip(*done)
    return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()).cast(pa.string(), safe=False), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["id", "kept", "n_lines", "n_dropped"])


def drops_by_shard(documents: DataFrame, index: DataFrame, shards: int, min_docs: int, least: int) -> DataFrame:
    """The hashes go to the shards, those to be dropped come back; a shard that many ask for stands in several tasks."""
    rows = numbered(documents)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                each = [digests_of(t, least) for t in some.column(1).to_pylist()]
                high, low = halves([d for own in each for d in own])
                of = np.repeat(np.arange(len(each)), [len(d) for d in each])
                yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(of)), some.column(0).take(pa.array(of)), pa.array(high.view("<i8")), pa.array(low.view("<i8")), pa.array(shard_of(high, shards))], ["row", "id", "high", "low", "shard"])

    asked = materialize(rows.select("id", "text", "row").mapInArrow(ask, "row long, id long, high long, low long, shard int"))
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(PROBES)).cast("int").alias("parts"))
    dealt = asked.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    spread = index.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["row", "high", "low"]).slice(0, 0) if left.num_rows else pa.table({c: pa.array([], pa.int64()) for c in ("row", "high", "low")})
        shard = Shard(*[right[f.split()[0]][0].as_py() for f in INDEX.split(", ")[1:]])
        count, last = shard.look_up(*(left[c].to_numpy().view("<u8") for c in ("high", "low")))
        gone = (count >= min_docs) & (left["id"].is_null().to_numpy(zero_copy_only=False) | (last != left["id"].fill_null(0).to_numpy()))
        return left.select(["row", "high", "low"]).filter(pa.array(gone))

    found = dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(answer, "row long, high long, low long")
    marks = found.groupBy("row").agg(F.collect_list(F.struct("high", "low")).alias("drops"))  # a document's own lines at most

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for told, drops in zip(batch.column(1), batch.column(2)):
                gone = {d["high"].to_bytes(8, "little", signed=True) + d["low"].to_bytes(8, "little", signed=True) for d in drops.as_py() or []}
                done.append(without(told.as_py() or b"", gone, least))
            if done:
                yield result(batch.column(0), done)

    return rows.join(marks, "row", "left").select("id", "text", "drops").mapInArrow(rebuild, "id long, kept string, n_lines long, n_dropped long")


def drop_repeated_lines(documents: DataFrame, min_docs: int = 3, least: int = 20, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_lines, n_dropped) of every row: lines whose key is in ``min_docs`` documents or more go, but for the document of the largest id.

    A key is a line (ends: \\n) without blanks at its ends and with A-Z lower-cased; those of fewer than ``least`` code points
    stay.  A null or empty text is one empty line.  Each row is a document: repeated rows count as often as they come, and all
    rows with the largest id keep their lines, as often as these stand there.  A row without an id counts, and keeps a key's lines only
    if all that hold it have no id.  An empty table gives an empty result; further columns are ignored.  A line is read whole, whatever
    its length.  An index of up to SHIPPED bytes is looked up where the documents are; beyond that their hashes are sent to its shards.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    index, shards = index_of(documents, key=key, text=text, least=least)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("bits", "prints", "counts", "lasts")))).first()[0] or 0
    if size <= SHIPPED:
        done = drops_in_place(rows, [tuple(r) for r in index.collect()], shards, min_docs, least)
    else:
        done = drops_by_shard(rows, index, shards, min_docs, least)
    return done.withColumnRenamed("id", key)
