"""Near-duplicate vectors by spherical-cap filters (Becker, Ducas, Gama and Laarhoven, 2016).

Filter directions form a random product code: the rotated space is cut into blocks, each block has a few random
unit codewords, and a filter is one codeword from each block.  List decoding finds all filters whose cap holds a
vector without visiting the others.  Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, parallelism
from .vectors import as_numbers, lengths, matrix, usable

#: Expected vectors in a filter, the largest block that is compared with itself or another block at once, and the most vectors of a task.
BUCKET, BLOCK, GROUP = 256, 2048, 16384
#: Chance that all of a vector's filters miss a partner at the very threshold, for independent filters.
MISS = 1e-6


@dataclass(frozen=True)
class Code:
    """A product code of ``size ** blocks`` filters in ``dim`` dimensions; alpha: a cap's least inner product."""

    dim: int
    blocks: int
    size: int
    alpha: float
    least: int
    seed: int = 7

    def directions(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotation, and each block's codewords."""
        rng = np.random.default_rng(self.seed)
        rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        words = []
        for part in np.array_split(np.arange(self.dim), self.blocks):
            w = rng.standard_normal((self.size, len(part)))
            w *= math.sqrt(len(part) / self.dim) / np.linalg.norm(w, axis=1, keepdims=True)
            words.append(w)
        return rotation, words


def choose_code(n: int, dim: int, threshold: float) -> Code:
    """The code for ``n`` vectors: as many filters as keep buckets near BUCKET, and caps so wide that partners rarely miss.

    For a random direction f and a unit x, sqrt(dim) <x, f> is nearly standard normal, and a partner's product given x's is
    normal around threshold times it.
    """
    normal, spread = NormalDist(), math.sqrt(1 - threshold**2)
    filters, needed = 64.0, 8.0
    for _ in range(8):  # the caps' number and their width depend on each other
        tau = normal.inv_cdf(1 - min(0.4, needed / filters))
        grid = np.linspace(tau, tau + 5, 400)
        weight = np.exp(-(grid**2 - tau**2) / 2)
        both = np.array([1 - normal.cdf((tau - threshold * t) / spread) for t in grid])
        needed = -math.log(MISS) / float((weight * both).sum() / weight.sum())
        filters = max(64.0, n * needed / BUCKET)
    blocks = min(dim, max(1, math.ceil(math.log(filters) / math.log(256))))
    size = max(2, math.ceil(filters ** (1 / blocks)))
    tau = normal.inv_cdf(1 - min(0.4, needed / size**blocks))
    return Code(dim, blocks, size, tau / math.sqrt(dim), math.ceil(needed * 2 / 3))


def decode(unit: np.ndarray, code: Code) -> list[np.ndarray]:
    """For each unit row all filters whose direction exceeds the code's alpha; rows with fewer than ``least`` get a lower alpha."""
    rotation, words = code.directions()
    turned = unit @ rotation
    sums, at = [], 0
    for w in words:
        sums.append(turned[:, at : at + w.shape[1]] @ w.T)
        at += w.shape[1]
    best = np.stack([s.max(axis=1) for s in sums], 1)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(unit)
    todo, alpha = np.arange(len(unit)), code.alpha
    while len(todo):
        rows, names, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
        for k, s in enumerate(sums):
            reach = total[:, None] + s[rows]
            keep, word = np.nonzero(reach + best[rows, k + 1 :].sum(axis=1)[:, None] >= alpha)
            rows, names, total = rows[keep], names[keep] * code.size + word, reach[keep, word]
        order = np.argsort(rows, kind="stable")
        rows, names = rows[order], names[order]
        found = np.searchsorted(rows, todo), np.searchsorted(rows, todo, side="right")
        enough = (found[1] - found[0] >= min(code.least, code.size**code.blocks // 2)) | (alpha < -1)
        for i, a, b in zip(todo[enough], found[0][enough], found[1][enough]):
            out[i] = names[a:b]
        todo, alpha = todo[~enough], alpha - 0.25 / math.sqrt(code.dim)
    return out


def linked_groups(close: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(close)
    labels = np.full(n, -1)
    for i in range(n):
        if labels[i] >= 0:
            continue
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            labels[front] = i
            front = close[front].any(axis=0) & (labels < 0)
    return labels


def compare(name: int, threshold: float, rep: np.ndarray, copies: np.ndarray, unit: np.ndarray, caps: list[np.ndarray], apart: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) for the rows of one filter that have a link here.

    Every pair at the threshold joins groups; it is counted (with the partner's copies) only in the smallest
    filter that both are in.  ``apart``: labels by which a pair must differ.  Memory: two boolean matrices of the block, whatever the number of filters.
    """
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    for label in apart:
        close &= label[:, None] != label[None, :]
    some = np.nonzero(close.any(axis=1))[0]
    close = close[np.ix_(some, some)]
    rep, copies = rep[some], copies[some]
    first = close.copy()
    # rows of each smaller filter meet there already: their pairs are struck out filter by filter
    below = [caps[i][caps[i] < name] for i in some]
    names = np.concatenate(below) if below else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(some)), [len(b) for b in below])
    order = np.argsort(names, kind="stable")
    names, rows = names[order], rows[order]
    ends = np.flatnonzero(np.diff(names)) + 1
    for same in np.split(rows, ends):
        if len(same) > 1:
            first[np.ix_(same, same)] = False
    links = first.astype(np.float64) @ copies
    order = np.argsort(rep)
    roots = np.empty_like(rep)
    roots[order] = rep[order][linked_groups(close[np.ix_(order, order)])]
    return rep, links.astype(np.int64), roots


def compare_filter(name: int, threshold: float, rows: np.ndarray, rep: np.ndarray, copies: np.ndarray, unit: np.ndarray, caps: list[np.ndarray], own: np.ndarray | None) -> Iterator[tuple]:
    """As :func:`compare` for the ``rows`` of a filter, however many, every two blocks of them at a time; ``own``: a label by which pairs must differ."""
    blocks = np.array_split(rows, -(-len(rows) // BLOCK)) if len(rows) <= BLOCK else np.array_split(rows, -(-2 * len(rows) // BLOCK))
    for i, p in enumerate(blocks):
        for j in range(i, len(blocks)):
            both = p if i == j else np.concatenate([p, blocks[j]])
            apart = [] if own is None else [own[both]]
            if i != j:
                apart.append(np.repeat([0, 1], [len(p), len(blocks[j])]))
            yield compare(name, threshold, rep[both], copies[both], unit[both], [caps[k] for k in both], apart)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine of at least ``threshold``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, those of different lengths not with each other.
    Equal vectors are joined before the search and count as each other's links; rows that repeat key and vector
    count once and are returned once; a key with different vectors has a row for each.  component_id is the smallest key reachable, itself included; kept
    marks it.  Rows without a key are returned too and link like others; the component_id of a component without any key is null, and its rows are kept.  An
    empty table gives an empty result.  A filter with more than BLOCK vectors is compared block by block.  Further columns are ignored.
    """
    rows = as_numbers(vectors, key, vector).withColumnRenamed("id", "vec_id")
    good = materialize(rows.filter(usable(F.col("vector"))).distinct())
    rest = rows.filter(~usable(F.col("vector"))).select("vec_id").distinct()
    found = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dim in lengths(good, "vector"):
        found = found.unionByName(links_of_length(good.filter(F.size("vector") == dim), dim, threshold))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_of_length(good: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of stored (vec_id, vector), all of ``dim`` components."""
    spark, kind = good.sparkSession, dict(good.dtypes)["vector"]
    # a number for each vector, given as it is stored
    same = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    same = materialize(same.withColumn("rep", F.monotonically_increasing_id()))
    code = choose_code(same.count(), dim, threshold)

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            found: list[np.ndarray] = []
            step = max(1, (1 << 22) // (code.size**min(code.blocks, 2)))
            for i in range(0, len(unit), step):
                found += decode(unit[i : i + step], code)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64())).cast(name_of)], ["vector", "rep", "copies", "caps"])

    # a vector travels with the names of its filters, so they are as short as they can be
    small = code.size**code.blocks < 2**31
    name_of = pa.list_(pa.int32() if small else pa.int64())
    spread = same.select("vector", "rep", "copies").repartition(parallelism(spark), "rep")
    decoded = materialize(spread.mapInArrow(caps, f"vector {kind}, rep long, copies long, caps array<{'int' if small else 'long'}>"))
    # filters that differ in their last codeword only share a task where that is not too much, so a vector travels once for all of these
    prefix = F.array_distinct(F.transform("caps", lambda c: F.call_function("div", c, F.lit(code.size))))
    shared = code.blocks > 1 and (decoded.agg(F.sum(F.size(prefix))).first()[0] or 0) <= GROUP / 2 * code.size ** (code.blocks - 1)
    limit = GROUP if shared else BLOCK
    dealt = decoded.withColumn("grp", F.explode(prefix if shared else F.col("caps")))
    sizes = dealt.groupBy("grp").agg(F.count("*").alias("n"))
    # stored first: Spark then knows its size, and broadcasts it only if that is small
    heavy = materialize(sizes.filter(F.col("n") > limit).select("grp", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")))
    each = dealt.join(heavy, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = each.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        group, cross = key[0].as_py(), key[1].as_py() != key[2].as_py()
        x = matrix(table["vector"])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = table["caps"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        filters = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        rep, copies, own = table["rep"].to_numpy(), table["copies"].to_numpy().astype(np.float64), table["own"].to_numpy() if cross else None
        # this group's filters, each with its rows
        row = np.repeat(np.arange(len(rep)), np.diff(ends))
        here = flat // code.size == group if shared else flat == group
        names, row = flat[here], row[here]
        order = np.argsort(names, kind="stable")
        names, row = names[order], row[order]
        told = [[np.empty(0, np.int64)] for _ in range(3)]
        for rows in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
            if len(rows) > 1:
                for part in compare_filter(int(names[rows[0]]), threshold, row[rows], rep, copies, unit, filters, own):
                    for column, values in zip(told, part):
                        column.append(values)
        return pa.table({c: np.concatenate(v).astype(np.int64) for c, v in zip(("rep", "links", "root"), told)})

    found = materialize(each.groupBy("grp", "i", "j").applyInArrow(search, "rep long, links long, root long"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("rep"), "component")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # 128 bits of a vector stand for it from here on
    name = [F.xxhash64("vector").alias("h0"), F.xxhash64(F.lit(1), F.col("vector")).alias("h1")]
    by_vector = same.select("rep", "least", "copies", *name).join(counted, "rep", "left").join(groups, "rep", "left").select(
        "h0", "h1", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    ids = by_vector.groupBy("component").agg(F.min("least").alias("component_id"))
    return good.select("vec_id", *name).join(by_vector.join(ids, "component"), ["h0", "h1"]).select("vec_id", "n_links", "component_id")
