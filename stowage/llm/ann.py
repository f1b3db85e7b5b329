"""Nearest neighbours by low-dimensional stable projections in kd-trees (SRS; Sun, Wang, Qin, Zhang and Lin, 2014).

The largest inner product is the smallest distance once every row gets one more component, sqrt(max norm^2 - norm^2),
and every query a zero.  Squared projected distance over squared distance follows a chi-square law with PROJECTED
degrees of freedom, so a query may stop as soon as the next projected neighbour is so far off that a better row
would have been met by now with the wanted probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import keyed, lengths, matrix, usable

#: Projected dimensions (even, for the closed form of the law), rows in a leaf, and leaves that a query opens first.
PROJECTED, LEAF, STRIDE = 8, 32, 4
#: Queries that go through a tree together; once a round verifies one row in DENSE, all its products are made at once.
TOGETHER, DENSE = 256, 32
#: Rows in one kd-tree, and queries that meet it in one task.
PART, QUERIES = 8192, 2048


def chi_square_cdf(x: float, freedom: int = PROJECTED) -> float:
    """Closed form for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(confidence: float, freedom: int = PROJECTED) -> float:
    """The ratio of squared distances at which the law reaches ``confidence``."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, freedom) < confidence:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < confidence else (low, middle)
    return high


def projection(dim: int, seed: int = 11) -> np.ndarray:
    """A 2-stable (normal) projection of ``dim`` + 1 components."""
    return np.random.default_rng(seed).standard_normal((dim + 1, PROJECTED))


@dataclass
class Tree:
    """Rows in kd-tree order; leaves are slices, with the corners of their boxes."""

    order: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray


def kd_tree(points: np.ndarray) -> Tree:
    """Split at the median of the widest side until a node has LEAF rows at most; equal points are split by place."""
    order, leaves, stack = np.arange(len(points)), [], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= LEAF:
            leaves.append((a, b))
            continue
        inside = points[order[a:b]]
        side = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(inside[:, side], middle)]
        stack += [(a, a + middle), (a + middle, b)]
    begins, ends = np.array(sorted(leaves), dtype=np.int64).reshape(-1, 2).T
    placed = points[order]
    low = np.array([placed[a:b].min(axis=0) for a, b in zip(begins, ends)]).reshape(-1, points.shape[1])
    high = np.array([placed[a:b].max(axis=0) for a, b in zip(begins, ends)]).reshape(-1, points.shape[1])
    return Tree(order, begins, ends, low, high)


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; the same for equal rows, wherever they stand."""
    return (rows * query).sum(axis=1)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, top: float, confidence: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k nearest rows here.  top: the largest squared norm of all rows; floor: a score that k rows elsewhere reach."""
    if floor is None:
        floor = np.full(len(queries), -np.inf)
    points = lifted(rows, top)
    tree = kd_tree(points)
    ids, rows, points = ids[tree.order], rows[tree.order], points[tree.order]
    centres = queries @ projection(rows.shape[1])[:-1]
    ratio = stop_ratio(confidence)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(0, len(queries), TOGETHER):
        some = slice(i, i + TOGETHER)
        of, near = verified(tree, rows, points, queries[some], centres[some], k, top, ratio, floor[some])
        ends = np.searchsorted(of, np.arange(len(queries[some]) + 1))
        for query_id, query, a, b in zip(query_ids[some], queries[some], ends, ends[1:]):
            mine = near[a:b][ids[near[a:b]] != query_id]
            score = exact(rows[mine], query)
            pick = np.lexsort((ids[mine], -score))[:k]
            for column, x in zip(out, (np.full(len(pick), query_id), ids[mine[pick]], score[pick])):
                column.append(x)
    return tuple(np.concatenate(c) if c else np.empty(0) for c in out)


def verified(tree: Tree, rows: np.ndarray, points: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, top: float, ratio: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a query, row), ascending by query: the verified rows whose score may be among the query's k nearest.

    All queries go on together.  A round opens twice as many leaves of each query as the one before, nearest first and none past its
    stopping test; of the rows in open leaves those are verified that are nearer than any unopened leaf and pass the test.
    """
    norms = (queries**2).sum(axis=1)
    gap = np.maximum(np.maximum(tree.low[None] - centres[:, None], centres[:, None] - tree.high[None]), 0)
    far = (gap**2).sum(axis=2)
    ranked = np.column_stack([np.sort(far, axis=1), np.full(len(far), np.inf)])
    own, other = (points**2).sum(axis=1), (centres**2).sum(axis=1)
    apart = np.full((len(queries), len(rows)), np.inf)  # squared projected distances of rows in open leaves
    done, opened = np.zeros(apart.shape, bool), np.zeros(far.shape, bool)
    best = np.full((len(queries), k + 1), -np.inf)  # the query's own row may be one of them
    slack = lambda x: x - 1e-9 * (1 + np.abs(x))
    kept, scores, m = [], None, STRIDE
    while True:
        m = min(m, far.shape[1])
        limit = ratio * np.maximum(norms + top - 2 * least, 0.0)
        new = (far <= np.minimum(ranked[:, m - 1], limit)[:, None]) & ~opened
        for leaf in np.nonzero(new.any(axis=0))[0]:
            who, inside = np.nonzero(new[:, leaf])[0], slice(tree.begins[leaf], tree.ends[leaf])
            apart[who, inside] = other[who][:, None] + own[inside] - 2 * (centres[who] @ points[inside].T)
        opened |= new
        due = (apart <= np.minimum(ranked[:, m], limit)[:, None]) & ~done
        done |= due
        if scores is None and np.count_nonzero(due) * DENSE > due.size:
            scores = queries @ rows.T
        if scores is None:
            of, row = np.nonzero(due)
            found = (queries[of] * rows[row]).sum(axis=1)
            fine = found >= slack(least)[of]
            of, row, found = of[fine], row[fine], found[fine]
        else:
            of, row = np.nonzero(due & (scores >= slack(least)[:, None]))
            found = scores[of, row]
        kept.append((of, row, found))
        ends = np.searchsorted(of, np.arange(len(queries) + 1))
        for i in np.nonzero(np.diff(ends))[0]:
            best[i] = np.partition(np.concatenate([best[i], found[ends[i] : ends[i + 1]]]), -k - 1)[-k - 1 :]
        least = np.maximum(least, best.min(axis=1))
        limit = ratio * np.maximum(norms + top - 2 * least, 0.0)
        if m == far.shape[1] or not (ranked[:, m] <= limit).any():
            break
        m *= 2
    of, row, found = (np.concatenate(x) for x in zip(*kept))
    near = np.nonzero(found >= slack(least)[of])[0]
    near = near[np.argsort(of[near], kind="stable")]
    return of[near], row[near]


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """Projections of the rows with their further component."""
    lift = np.sqrt(np.maximum(top - (rows**2).sum(axis=1), 0))
    return np.column_stack([rows, lift]) @ projection(rows.shape[1])


#: Rows that the cells are cut by, at most, and cells at most.
SAMPLE, CELLS = 1 << 15, 1 << 10


@dataclass
class Cells:
    """Projected space cut by planes: a node is (side, place, node below, node above), a leaf the number of its cell."""

    root: tuple | int
    count: int

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, int):
                out[rows] = node
            else:
                below = points[rows, node[0]] < node[1]
                stack += [(node[2], rows[below]), (node[3], rows[~below])]
        return out


def cut_cells(points: np.ndarray, cells: int) -> Cells:
    """Cells of equally many sample points, cut at the median of the widest side."""
    made = 0

    def cut(inside: np.ndarray, n: int) -> tuple | int:
        nonlocal made
        wide = inside.max(axis=0) - inside.min(axis=0) if len(inside) else np.zeros(1)
        if n < 2 or len(inside) < 2 or not wide.max():
            made += 1
            return made - 1
        side = int(np.argmax(wide))
        place = float(np.median(inside[:, side]))
        if place <= inside[:, side].min():
            place = float(inside[inside[:, side] > place, side].min())
        below = inside[:, side] < place
        return side, place, cut(inside[below], n // 2), cut(inside[~below], n - n // 2)

    root = cut(points, cells)
    return Cells(root, made)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, confidence: float = 0.97, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of largest inner product, its own key excepted.

    The projected space is cut into cells by a sample of SAMPLE rows at most; every row is in a cell, and every cell in one or
    more kd-trees of PART rows or so.  Each query first searches its own cell; its k-th score there then bounds which other
    cells the stopping test leaves, and how far it goes in their trees.  Blocks of QUERIES queries meet a tree in a task, so neither
    side is ever collected.  Ties go to the smaller key.  Rows are searched among those of equal length.  Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows without a key; rows that repeat key and vector count once.
    An empty table on either side gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return keyed(df, key, vector).filter(usable(F.col("vector"))).distinct()

    rows, asked = materialize(clean(vectors)), materialize(clean(queries))
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in lengths(asked, "vector"):
        found = found.unionByName(nearest_of_length(*(df.filter(F.size("vector") == dim) for df in (rows, asked)), k, confidence))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_of_length(rows: DataFrame, asked: DataFrame, k: int, confidence: float) -> DataFrame:
    """(query_id, vec_id, score): more than the k nearest rows of each query, all vectors being of one length."""
    spark = rows.sparkSession
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top = rows.agg(F.count("*"), F.coalesce(F.max(squares), F.lit(0.0))).first()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    kind = dict(rows.dtypes)["vector"]
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(min(n, SAMPLE)).select("vector").toArrow()["vector"]
    cells = cut_cells(lifted(matrix(sample), top), max(1, min(CELLS, -(-n // PART))))
    shipped = spark.sparkContext.broadcast(cells)  # CELLS planes at most

    def place(lift: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))
                    points = lifted(x, top) if lift else x @ projection(x.shape[1])[:-1]
                    cell = shipped.value.of(points)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(list(points), pa.list_(pa.float64()))], ["id", "vector", "cell", "point"])

        return run

    placed = [materialize(df.select("id", "vector").mapInArrow(place(lift), f"id long, vector {kind}, cell int, point array<double>")) for df, lift in ((rows, True), (asked, False))]
    index, want = placed
    corner = [f(F.element_at("point", i + 1)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    told = index.groupBy("cell").agg(F.count("*").alias("n"), *corner).collect()  # CELLS rows at most
    parts = {r["cell"]: -(-r["n"] // PART) for r in told}
    order = sorted(parts)
    by_cell = {r["cell"]: r for r in told}
    low, high = (np.array([[by_cell[c][f"{name}{i}"] for i in range(PROJECTED)] for c in order]) for name in ("low", "high"))
    ratio = stop_ratio(confidence)

    def distances(points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
        return (gap**2).sum(axis=2)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query to its nearest cell, with no floor yet."""
        for batch in batches:
            if batch.num_rows:
                cell = np.array(order, np.int32)[np.concatenate([distances(p).argmin(axis=1) for p in np.array_split(matrix(batch.column(3)), -(-batch.num_rows // 64))])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cell), pa.array(np.full(len(cell), -np.inf))], ["id", "vector", "cell", "floor"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query to the other cells that its stopping test leaves."""
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                x, floor = matrix(some.column(1)), some.column(4).to_numpy(zero_copy_only=False)
                limit = ratio * np.maximum((x**2).sum(axis=1) + top - 2 * floor, 0.0)
                near = distances(matrix(some.column(3))) <= limit[:, None]
                near &= np.array(order)[None] != some.column(2).to_numpy()[:, None]
                query, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(query)), some.column(1).take(pa.array(query)), pa.array(np.array(order, np.int32)[cell]), pa.array(floor[query])], ["id", "vector", "cell", "floor"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            found = search(left["id"].to_numpy(), matrix(left["vector"]), right["id"].to_numpy(), matrix(right["vector"]), k, top, confidence, right["floor"].to_numpy())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query_id", "vec_id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})

    def searched(visits: DataFrame) -> DataFrame:
        counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
        made = [(c, parts[c], -(-m // QUERIES)) for c, m in counts.items()]
        plan = F.broadcast(spark.createDataFrame(made, "cell int, parts int, blocks int"))

        def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str, *columns: str) -> DataFrame:
            """Every row with its own part and, repeatedly, each part of the other side."""
            df = df.join(plan, "cell").withColumn(own, F.pmod(F.xxhash64("id", "vector"), F.col(n_own)).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("cell", "part", "block", "id", "vector", *columns)

        trees = dealt(index, "part", "parts", "block", "blocks").groupBy("cell", "part", "block")
        return trees.cogroup(dealt(visits, "block", "blocks", "part", "parts", "floor").groupBy("cell", "part", "block")).applyInArrow(meet, schema)

    visit = f"id long, vector {kind}, cell int, floor double"
    first = materialize(want.mapInArrow(home, visit))
    found = materialize(best_of(searched(first), k).drop("rank"))
    # a score that k rows reach; no floor where the home cell has fewer
    floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k)
    # a key may have several vectors, whose hits are ranked together; the floor of all holds for none of them alone
    single = want.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("id").alias("query_id"))
    floors = floors.join(single, "query_id", "left_semi").select(F.col("query_id").alias("id"), "floor")
    cell_of = first.select("id", F.xxhash64("vector").alias("v"), "cell")
    rest = want.drop("cell").withColumn("v", F.xxhash64("vector")).join(cell_of, ["id", "v"]).join(floors, "id", "left")
    rest = rest.select("id", "vector", "cell", "point", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    second = materialize(rest.mapInArrow(others, visit))
    return found.unionByName(searched(second)) if not second.isEmpty() else found
