"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints with at most ``budget`` differing bits, cut into ``budget + 1`` blocks, can be read from some block on (going
round) so that after j blocks at most floor(j * budget / (budget + 1)) bits have differed: the first block agrees.  So the
join runs over one trie for each block order; node pairs are followed together, differing bits
add up, and a pair is dropped as soon as it is over that prefix's budget.  Spark deals the tries out by their
first block, and where many rows share it by some bits of the second, in which one bit at most may differ.

Links of texts whose sets of shingles are similar are found by the same join over several short fingerprints of
the sets, and then verified on the sets (``near_rows``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

BITS = 64
#: Node pairs that a task expands at once; the rest waits on a stack.
CHUNK = 1 << 17
#: Pairs of subtrees with at most so many fingerprint pairs are compared directly.
LEAF = 16
#: Rows of a task's trie; larger subtrees are dealt out as pairs of parts.
PART = 8192


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, A-Z lower-cased; fewer words: of all of them; none: no hash."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist())], dtype="<u8")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of ``words`` words, repeats included; fewer words: of all of them; none: zero."""
    hashes = shingle_hashes(text, words, seed)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """Each bit as over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 4, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, bits long")


def blocks(budget: int, width: int = BITS) -> list[int]:
    """Widths of the budget + 1 blocks of a fingerprint of ``width`` bits."""
    n = budget + 1
    return [width // n + (i < width % n) for i in range(n)]


def allowance(budget: int, turn: int, width: int = BITS) -> np.ndarray:
    """Differing bits allowed after each of the bits, read from block ``turn`` on."""
    widths = blocks(budget, width)
    widths = widths[turn:] + widths[:turn]
    return np.repeat([budget * (j + 1) // (budget + 1) for j in range(budget + 1)], widths)


def turned(bits: np.ndarray, by: int) -> np.ndarray:
    by = np.uint64(by % BITS)
    return bits if by == 0 else (bits << by) | (bits >> (np.uint64(BITS) - by))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (each vertex's root, the smallest of its group) after joining the pairs (a, b)."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def met(bits: np.ndarray, allowed: np.ndarray, labels: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of sorted ``bits`` whose leaves the joined traversal reaches; some may be over the budget.

    A range of the sorted array is a trie node.  ``allowed``: differing bits after each bit, whose number is the trie's depth.
    Node pairs whose members all have one label, as ``labels`` has them at that moment, are not followed.
    """
    n, deep = len(bits), len(allowed)
    if n < 2:
        return
    stack = [(0, np.array([[0, n, 0, n, 0]], dtype=np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > CHUNK:
            stack.append((depth, nodes[CHUNK:]))
            nodes = nodes[:CHUNK]
        now = labels()
        change = np.concatenate([[0], np.cumsum(now[1:] != now[:-1])])
        a0, a1, b0, b1, _ = nodes.T
        nodes = nodes[~((change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (now[a0] == now[b0]))]
        a0, a1, b0, b1, _ = nodes.T
        pairs = (a1 - a0) * (b1 - b0)
        small = pairs <= (LEAF if depth < deep else CHUNK)
        later = small & (np.cumsum(np.where(small, pairs, 0)) > LEAF * CHUNK)  # more than are compared at once
        if later.any():
            stack.append((depth, nodes[later]))
            nodes, small = nodes[~later], small[~later]
        if small.any():
            x0, x1, y0, y1, _ = nodes[small].T
            across = y1 - y0
            each = (x1 - x0) * across
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i = np.repeat(x0, each) + at // np.repeat(across, each)
            j = np.repeat(y0, each) + at % np.repeat(across, each)
            yield i[i < j], j[i < j]
        nodes = nodes[~small]
        if not len(nodes):
            continue
        a0, a1, b0, b1, differ = nodes.T
        bit = np.uint64(1) << np.uint64(max(0, BITS - 1 - depth))

        def halves(lo, hi):
            if depth == deep:  # equal fingerprints, too many for one comparison
                return (lo + hi + 1) // 2
            first = (bits[lo] & ~(bit - np.uint64(1))) | bit
            return np.clip(np.searchsorted(bits, first), lo, hi)

        am, bm = halves(a0, a1), halves(b0, b1)
        selfs, more = (a0 == b0) & (a1 == b1), int(depth < deep)
        children = [
            np.stack([a0, am, b0, bm, differ], 1),
            np.stack([am, a1, bm, b1, differ], 1),
            np.stack([a0, am, bm, b1, differ + more], 1),
            np.stack([am, a1, b0, bm, differ + more], 1)[~selfs],
        ]
        down = np.concatenate(children)
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= allowed[min(depth, deep - 1)])]
        if len(down):
            stack.append((depth + more, down))


Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]


def trie_links(bits: np.ndarray, side: np.ndarray | None, budget: int, allowed: np.ndarray, wide: np.ndarray | None = None, fits: Fits | None = None) -> np.ndarray:
    """Component roots of sorted ``bits`` under links of at most ``budget`` differing bits found in this trie.

    ``side``: only pairs of different values there count.  ``wide``: rows of words whose differing bits are counted,
    against ``budget``, for pairs that this trie finds.  ``fits(i, j)``: which pairs may link at all.
    """
    labels = np.arange(len(bits))
    for i, j in met(bits, allowed, lambda: labels):
        if wide is None:
            fine = np.bitwise_count(bits[i] ^ bits[j]) <= budget
        else:
            fine = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= budget
        if side is not None:
            fine &= side[i] != side[j]
        i, j = i[fine], j[fine]
        if fits is not None and len(i):
            fine = fits(i, j)
            i, j = i[fine], j[fine]
        labels = merged(labels, i, j)
    return labels


def forest(rep: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    """(u, v): each row of a group with the group's smallest row, which tasks that meet the same group mostly agree on."""
    least = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, rep)
    root = least[labels]
    return pa.RecordBatch.from_arrays([pa.array(rep[rep != root]), pa.array(root[rep != root])], ["u", "v"])


@dataclass
class Task:
    """One trie: rows sorted by their bits, read from block ``turn`` on; ``fits`` tells which pairs it may link."""

    turn: int
    bits: np.ndarray
    columns: dict[str, np.ndarray]
    fits: Fits | None


def trie_join(rows: DataFrame, width: int, budget: int, part: int, find: Callable[[Task], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``find`` returns for every trie over the rows (rep long, word int, bits long, any numbers).

    ``bits``: the word's fingerprint in its ``width`` highest bits; only rows of one word meet.  Every word is read from each of its
    blocks on.  A first block that more than ``part`` rows share is dealt out further by the next bits, of which one at most may
    differ: a row also visits, as a guest, each cell that has one of its ones there as a zero; two guests meet elsewhere.
    What is still heavy is split into parts, and every pair of parts is joined.
    """
    widths = blocks(budget, width)
    starts = [sum(widths[:i]) for i in range(budget + 1)]
    mask = F.lit(-1 << (BITS - width))
    others = [c for c in rows.columns if c not in ("rep", "word", "bits")]

    def read_from(turn: int) -> Column:
        at = starts[turn]
        if not at:
            return F.col("bits")
        return F.shiftleft("bits", at).bitwiseOR(F.shiftrightunsigned("bits", width - at)).bitwiseAND(mask)

    each = rows.select("rep", "word", *others, F.posexplode(F.array(*[read_from(t) for t in range(budget + 1)])).alias("turn", "bits"))
    # blocks differ in width by one bit; the narrowest decides how many heads a turn has
    first = F.lit(BITS) - F.element_at(F.array(*map(F.lit, widths)), F.col("turn") + 1)
    each = each.withColumn("head", F.call_function("shiftrightunsigned", "bits", first.cast("int")))
    heads = each.groupBy("word", "turn", "head").agg(F.count("*").alias("n"))  # at most words * (budget + 1) * 2^width rows
    second = F.element_at(F.array(*[F.lit(w) for w in (widths[1:] + widths[:1] if budget else [0])]), F.col("turn") + 1)
    more = F.least(second, F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(part))).cast("int")))
    # stored first: Spark then knows its size, and broadcasts it only if that is small
    deep = materialize(heads.select("word", "turn", "head", more.alias("more")).filter("more > 0"))
    each = each.join(deep, ["word", "turn", "head"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    below = F.call_function("shiftrightunsigned", "bits", (first - F.col("more")).cast("int")) - F.call_function("shiftleft", "head", "more")
    each = each.withColumn("below", below).withColumn("flip", F.explode(F.sequence(F.lit(0), F.col("more"))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.col("flip") - 1))
    each = each.withColumn("guest", F.col("flip") > 0).filter(~F.col("guest") | (F.col("below").bitwiseAND(one) != 0))
    cell = F.call_function("shiftleft", "head", "more") + F.col("below") - F.when(F.col("guest"), one).otherwise(0)
    each = each.withColumn("cell", F.shiftleft(cell, 5) + F.col("more"))
    heavy = each.filter("more > 0").groupBy("word", "turn", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > part)
    heavy = materialize(heavy.select("word", "turn", "cell", F.ceil(F.col("n") / F.lit(part)).cast("int").alias("parts")))
    each = each.join(heavy, ["word", "turn", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = each.withColumn("own", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).otherwise(0))
    # a light cell shares a task with others; a heavy one's part meets every part
    words = max(1, rows.select("word").distinct().count())
    groups = max(1, -(-rows.count() * 2 // (part * words)))
    group = F.when(F.col("parts") > 1, -1 - F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(groups)))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("rep", "bits", "guest", "own", *others, "word", "turn", group.alias("grp"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bits = table["bits"].to_numpy().view(np.uint64)
        order = np.argsort(bits, kind="stable")
        own, guest = table["own"].to_numpy()[order], table["guest"].to_numpy(zero_copy_only=False)[order]
        cross, guests = key[3].as_py() != key[4].as_py(), bool(guest.any())

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fine = np.ones(len(i), bool)
            if cross:
                fine &= own[i] != own[j]
            if guests:
                fine &= ~(guest[i] & guest[j])
            return fine

        columns = {c: table[c].to_numpy()[order] for c in ("rep", *others)}
        yield from find(Task(key[1].as_py(), bits[order], columns, fits if cross or guests else None))

    return each.groupBy("word", "turn", "grp", "i", "j").applyInArrow(join, schema)


def links(distinct: DataFrame, budget: int, part: int) -> DataFrame:
    """Forests (u, v) of the links between the rows (rep, bits): fingerprints with ``budget`` or fewer differing bits.

    A task returns a forest of its links, never all pairs.
    """

    def find(task: Task) -> Iterator[pa.RecordBatch]:
        rep = task.columns["rep"]
        yield forest(rep, trie_links(task.bits, None, budget, allowance(budget, task.turn), fits=task.fits))

    return trie_join(distinct.select("rep", F.lit(0).alias("word"), "bits"), BITS, budget, part, find, "u long, v long")


def near_groups(fps: DataFrame, budget: int = 4, part: int = PART) -> DataFrame:
    """(doc_id, bits, component_id) of fingerprints (doc_id, bits), linked at ``budget`` or fewer differing bits.

    component_id: the smallest doc_id reachable, null if no document reachable has one; equal fingerprints are joined first.
    """
    fps = materialize(fps)
    distinct = materialize(fps.groupBy("bits").agg(F.min("doc_id").alias("least")).select("bits", F.col("bits").alias("rep"), "least"))
    found = components(links(distinct, budget, part))
    joined = distinct.join(found, distinct["rep"] == found["id"], "left").select("bits", "least", F.coalesce("component", "rep").alias("component"))
    joined = materialize(joined)
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(joined.join(ids, "component").select("bits", "component_id"), "bits").select("doc_id", "bits", "component_id")


def near_duplicates(documents: DataFrame, *, words: int = 4, budget: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, linked at ``budget`` or fewer differing bits.

    fingerprint: 16 lower-case hex digits.  Null and blank texts have the fingerprint zero and are linked like any other;
    repeated rows are returned repeatedly.  Rows without a key are returned too and link like others; their component_id is that of the documents they reach, null
    if none has a key.  A text of any length is read whole; an empty table gives an empty result; further columns are ignored.
    """
    found = near_groups(fingerprints(documents, words, key=key, text=text), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Share of the pairs at the very threshold that no trie of ``near_rows`` finds, and share that the guard bits rule out.
MISS, RULED_OUT = 1e-3, 1e-5
#: Tries that a row is in at most (twice that for sets whose size is near SMALL, which get both kinds of votes), whatever the number of rows.
COPIES = 96
#: Random candidates that a row gets at most, as long as COPIES allow; the guard bits rule all but three in a million of them out.
RANDOM = 400
#: Further bits that a candidate pair is held against before its sets are.
GUARD = 128
#: Sets of at most so many shingles get finer votes (each shingle has VOTES of them), as few coarse ones tie too often.
SMALL, VOTES = 64, 9
#: Rows and shingles of a block of sets that one task compares with itself or another block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def bit_differs(similarity: float) -> float:
    """How often a bit of SimHash differs between two sets of this Jaccard similarity, at most: sets of one size have the largest angle."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@dataclass(frozen=True)
class Sketch:
    """``words`` fingerprints of ``width`` bits; two sets are candidates if one of these differs in ``budget`` bits at most."""

    words: int
    width: int
    budget: int

    def votes(self, hashes: np.ndarray) -> np.ndarray:
        """The words, in their highest bits, and the guard's, by the majority of the bits that multiplied hashes have."""
        own = self.words * self.width
        times = multipliers(-(-(own + GUARD) // 32))
        ones = np.zeros(32 * len(times), np.int64)
        for i in range(0, len(hashes), 255):  # so that a byte can count
            half = (hashes[i : i + 255, None] * times >> np.uint64(32)).astype("<u4")
            ones += np.add.reduce(np.unpackbits(half.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
        bits = 2 * ones > len(hashes)
        wide = np.zeros((self.words, BITS), bool)
        wide[:, : self.width] = bits[:own].reshape(self.words, self.width)
        flat = np.concatenate([wide.ravel(), bits[own : own + GUARD]])
        return np.packbits(flat).view(">u8").astype(np.uint64)


def guard_limit(similarity: float) -> int:
    """Guard bits that may differ: sets of this similarity exceed it in RULED_OUT of all cases at most."""
    p = bit_differs(similarity)
    return next(k for k in range(GUARD + 1) if 1 - at_most(k, GUARD, p) <= RULED_OUT)


@lru_cache(maxsize=8)
def multipliers(n: int, seed: int = 8) -> np.ndarray:
    """Odd 64-bit factors; a hash times one of them has new high bits."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=32)
def choose_sketch(n: int, similarity: float, miss: float = MISS) -> Sketch:
    """The cheapest words for ``n`` sets that leave out ``miss`` of the pairs at ``similarity``.

    Cost of a row: the tries it is in (COPIES at most, so that what is shuffled for a row does not grow with the rows), with the node pairs that
    random rows make there, and the random candidates it gets.  More rows ask for longer words; the share missed stays.
    """
    p, log_n = bit_differs(similarity), math.log2(max(2, n))
    best = None
    for width in range(16, BITS + 1, 4):
        for budget in range(1, 12):
            words = math.ceil(math.log(miss) / math.log1p(-at_most(budget, width, p)))
            if words * (budget + 1) > COPIES:
                continue
            allowed = allowance(budget, 0, width)
            paths = np.eye(1, budget + 2)[0]  # by differing bits, of the node pairs of one row
            for limit in allowed[: min(width, math.ceil(log_n))]:
                paths[1:] += paths[:-1].copy()
                paths[limit + 1 :] = 0
            random = words * n * at_most(budget, width, 0.5)
            cost = (max(random, RANDOM), words * (budget + 1) * (1 + paths.sum() / 16) + random)
            if best is None or cost < best[0]:
                best = (cost, Sketch(words, width, budget))
    return best[1]


def similar_links(sets: list[np.ndarray], rep: np.ndarray, similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """Roots of the sets (arrays without repeats) under links of this Jaccard similarity or more, each an index of the smallest ``rep``.

    Common shingles are counted over posting lists, so sets that share nothing are never compared.  ``side``: only pairs of
    different values there link.  Two empty sets are equal.
    """
    order = np.argsort(rep, kind="stable")
    size = np.array([len(sets[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), size)
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.empty(0, np.uint64)
    shingle = np.unique(flat, return_inverse=True)[1]
    posted = np.argsort(shingle, kind="stable")  # within a shingle by owner
    owners = owner[posted]
    place = np.empty(len(flat), np.int64)
    place[posted] = np.arange(len(flat))
    stop = np.cumsum(np.bincount(shingle))[shingle] if len(flat) else place
    ends = np.concatenate([[0], np.cumsum(size)])
    labels = np.arange(len(order))
    for i in range(len(order)):
        # owners after this one in the lists of its shingles
        a, n = place[ends[i] : ends[i + 1]] + 1, stop[ends[i] : ends[i + 1]] - place[ends[i] : ends[i + 1]] - 1
        after = owners[np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] if n.any() else np.empty(0, np.int64)
        both = np.bincount(after, minlength=len(order)) if len(after) else np.zeros(len(order), np.int64)
        if size[i] == 0:
            close = (size == 0) & (np.arange(len(order)) > i)
        else:
            close = both / (size[i] + size - both) >= similarity
        close &= labels != labels[i]
        if side is not None:
            close &= side[order] != side[order[i]]
        j = np.nonzero(close)[0]
        if len(j):
            labels = merged(labels, np.full(len(j), i), j)
    found = np.empty(len(order), np.int64)
    found[order] = order[labels]
    return found


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as ascending arrays; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def numbered(documents: DataFrame) -> DataFrame:
    """``documents``, which have no column of that name, stored with a number ``row`` for each row."""
    if "row" in documents.columns:
        raise ValueError("a column is named row already; put the columns into a struct first")
    return materialize(documents.withColumn("row", F.monotonically_increasing_id()))


def near_rows(rows: DataFrame, words: int = 5, similarity: float = 0.8, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(row, component) of stored ``rows`` (row long unique, text), linked where the sets of ``words``-word shingles have this Jaccard similarity or more.

    Equal sets are joined first.  Sets that a trie of one of their SimHash words brings together, with not too many guard bits
    differing, are candidates (at the very threshold all but MISS of the pairs, nearer ones more surely); tries return
    forests, which make groups of candidates.  Within a group the sets themselves decide, so no link is below ``similarity``: small groups
    share a task, of a large one every two blocks meet in a task, which again returns a forest.
    """
    sketch, limit = choose_sketch(rows.count(), similarity), guard_limit(similarity)
    split = multipliers(VOTES, 9)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "d0", "d1", "size", "plain", "fine"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            found = []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.unique(shingle_hashes(t.as_py(), words))
                n = len(hashes)
                d = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                # sets of similar sizes have the same kind of votes, or both
                plain = sketch.votes(hashes).view(np.int64) if n >= SMALL else None
                fine = sketch.votes((hashes[:, None] * split).ravel()).view(np.int64) if 0 < n * similarity <= SMALL else None
                found.append((row, *d, n, plain, fine))
            columns = zip(*found) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    def candidates(task: Task) -> Iterator[pa.RecordBatch]:
        rep, size = task.columns["rep"], task.columns["size"]
        g0, g1 = (task.columns[g].view(np.uint64) for g in ("g0", "g1"))

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fine = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            fine &= np.bitwise_count(g0[i] ^ g0[j]).astype(np.int64) + np.bitwise_count(g1[i] ^ g1[j]) <= limit
            return fine if task.fits is None else fine & task.fits(i, j)

        yield forest(rep, trie_links(task.bits, None, sketch.budget, allowance(sketch.budget, task.turn, sketch.width), fits=fits))

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in table["text"]]
        rep = table["rep"].to_numpy()
        roots = similar_links(sets, rep, similarity, table["own"].to_numpy() if key[1].as_py() != key[2].as_py() else None)
        yield forest(rep, roots)

    sketches = materialize(rows.select("row", "text").mapInArrow(draw, "row long, d0 long, d1 long, size int, plain array<long>, fine array<long>"))
    equal = materialize(sketches.groupBy("d0", "d1").agg(F.min("row").alias("rep")))
    distinct = materialize(sketches.join(equal.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "size", "plain", "fine"))
    told = []
    for k, kind in enumerate(("plain", "fine")):
        guard = [F.element_at(kind, sketch.words + 1 + g).alias(f"g{g}") for g in range(GUARD // BITS)]
        each = distinct.filter(f"{kind} is not null").select("rep", "size", *guard, F.posexplode(F.slice(kind, 1, sketch.words)).alias("word", "bits"))
        told.append(each.withColumn("word", F.col("word") + k * sketch.words))
    groups = components(trie_join(told[0].unionByName(told[1]), sketch.width, sketch.budget, part, candidates, "u long, v long"))

    # every candidate with its text, and of a large group once for each block that its own meets
    members = materialize(groups.join(distinct.select(F.col("rep").alias("id"), "size"), "id"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    large = materialize(sizes.select("component", F.greatest(F.lit(1), parts).alias("parts")).filter("parts > 1"))
    tasks = 1 + members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * 2 // BLOCK_SHINGLES + members.count() * 2 // block
    members = members.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") > 1, -1 - F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks)))
    members = members.select(F.col("id").alias("rep"), "own", group.alias("grp"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = rows.select(F.col("row").alias("rep"), "text")
    links = members.join(texts, "rep").groupBy("grp", "i", "j").applyInArrow(compare, "u long, v long")
    of = components(links)
    of = equal.join(of, equal["rep"] == of["id"], "left").select("d0", "d1", F.coalesce("component", "rep").alias("component"))
    return sketches.select("row", "d0", "d1").join(of, ["d0", "d1"]).select("row", "component")


def near_copies(documents: DataFrame, *, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): documents whose sets of ``words``-word shingles have this Jaccard similarity or more are linked.

    Links are exact, see ``near_rows``; copies of copies also link.  Null and blank texts are copies of each other; repeated rows
    are returned repeatedly, rows without a key left out.
    """
    rows = numbered(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null"))
    found = materialize(rows.select("row", "doc_id").join(near_rows(rows, words, similarity), "row"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "component_id")
