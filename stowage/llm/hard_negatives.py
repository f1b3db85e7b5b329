"""Hard-negative mining: integer inner products of anchor blocks and candidate blocks by dense products in doubles.

Anchors are shipped to all tasks in passes of bounded size; every task multiplies them with its candidates block by block and
keeps the best few for each anchor, which Spark merges.  A first scan finds the positives, a second one the negatives whose scores
lie in each positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite, lengths, matrix

#: Bytes of anchors, as doubles, that a pass ships.
PASS = 64 << 20
#: Anchors and candidates of one product.
ANCHORS = CANDIDATES = 2048
#: Below every score.
NONE = -(1 << 62)


class Best:
    """The ``k`` best (score, id) of each anchor: higher scores first, then smaller ids."""

    def __init__(self, anchors: int, k: int) -> None:
        self.score, self.id = np.full((anchors, k), NONE, np.int64), np.full((anchors, k), np.iinfo(np.int64).max)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block: ``scores`` (NONE: not this one) of the anchors ``at`` and candidates of ascending ``ids``."""
        k = self.score.shape[1]
        top = scores.max(axis=1)
        rows = np.flatnonzero((top > NONE) & (top >= self.score[at, -1]))
        if not len(rows):
            return
        scores = scores[rows]
        each = np.arange(len(rows))
        found = [(self.score[at][rows], self.id[at][rows])]
        for _ in range(min(k, scores.shape[1])):
            column = scores.argmax(axis=1)  # of equal ones the first, whose id is the smallest
            value = scores[each, column]
            found.append((value.astype(np.int64)[:, None], np.where(value > NONE, ids[column], np.iinfo(np.int64).max)[:, None]))
            scores[each, column] = NONE
        score, name = (np.concatenate(x, axis=1) for x in zip(*found))
        order = np.lexsort((name, -score), axis=1)[:, :k]
        where = at.start + rows
        self.score[where], self.id[where] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, id, score) of all that was found."""
        anchor, place = np.nonzero(self.score > NONE)
        return anchor, self.id[anchor, place], self.score[anchor, place]


def products(anchors: tuple, batches: Iterator[pa.RecordBatch], scale: float, exact: type) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors' places, scores, same label, other id, candidates' ids ascending) of every block."""
    ids, labels, x = anchors
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy())
        near, near_label = batch.column(0).to_numpy()[order], batch.column(1).to_numpy()[order]
        y = np.floor(scale * matrix(batch.column(2))[order]).astype(exact)
        for j in range(0, len(y), CANDIDATES):
            some = slice(j, j + CANDIDATES)
            for i in range(0, len(x), ANCHORS):
                at = slice(i, min(i + ANCHORS, len(x)))
                yield at, x[at] @ y[some].T, labels[at][:, None] == near_label[some][None], ids[at][:, None] != near[some][None], near[some]


def exact_type(rows: DataFrame, scale: float) -> type:
    """Doubles if no score, nor any part of its sum, reaches 2^53; else longs, up to 2^55."""
    bound = F.aggregate("vector", F.lit(0.0), lambda a, c: a + F.pow(F.abs(c.cast("double") * scale) + 1, F.lit(2.0)))
    most = rows.agg(F.max(bound)).first()[0] or 0.0
    if most >= 2.0**55:
        raise ValueError(f"scores of up to {most:.3g} are too large")
    return np.float64 if most < 2.0**53 else np.int64


def labelled(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, each once."""
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("vector"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector"))).distinct()


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0, *, key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the ``anchors``, a part of ``vectors``.

    Each component c counts as floor(scale * c); a score is the integer inner product.  An anchor's positives are its best rows of the
    same label and another key; a positive's negatives are the best rows of other labels with a score of ``window`` per cent of the positive's
    score.  Ties go to the smaller key.  Rows without a key or label, and those whose vector is null or holds null or
    non-finite components, take no part; zero vectors do.  Rows that repeat key, label and vector count once; a key with several is a row, and
    an anchor, for each.  Vectors meet only those of their length.  Scores are exact: in doubles below 2^53, beyond that in longs,
    and from 2^55 on an error.  An empty table gives an empty result; further columns are ignored.
    """
    rows = materialize(labelled(vectors, key, label, vector))
    asked = materialize(labelled(anchors, key, label, vector))
    found = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for dim in lengths(asked, "vector"):
        here, mine_now = (df.filter(F.size("vector") == dim) for df in (rows, asked))
        exact = exact_type(here.unionByName(mine_now), scale)
        passes = max(1, -(-mine_now.count() * max(dim, 1) * 8 // PASS))
        dealt = mine_now.withColumn("pass", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(passes)))
        for n in range(passes):
            told = dealt.filter(F.col("pass") == n).select("id", "label", "vector").toArrow()  # PASS bytes or so
            if told.num_rows:
                some = told["id"].to_numpy(), told["label"].to_numpy(), np.floor(scale * matrix(told["vector"])).astype(exact)
                found = found.unionByName(one_pass(here, some, positives, negatives, window, scale, exact))
    return found


def best_of(found: DataFrame, k: int, *of: str) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_pass(rows: DataFrame, anchors: tuple, positives: int, negatives: int, window: tuple[int, int], scale: float, exact: type) -> DataFrame:
    """The finished rows of these anchors, stored."""
    spark, (low, high) = rows.sparkSession, window
    shipped = spark.sparkContext.broadcast(anchors)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(shipped.value[0]), positives)
        for at, scores, same, other, ids in products(shipped.value, batches, scale, exact):
            scores[~(same & other)] = NONE
            best.add(at, scores, ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["anchor", "id", "score"])

    first = best_of(rows.mapInArrow(near, "anchor long, id long, score long"), positives, "anchor").toArrow()  # ``positives`` for each anchor
    if not first.num_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    names, points = np.zeros((len(anchors[0]), positives), np.int64), np.zeros((len(anchors[0]), positives), np.int64)
    least, most = np.ones_like(points), np.zeros_like(points)  # an empty window where there is no positive
    anchor, place, score = first["anchor"].to_numpy(), first["rank"].to_numpy() - 1, first["score"].to_numpy()
    names[anchor, place], points[anchor, place] = first["id"].to_numpy(), score
    least[anchor, place], most[anchor, place] = -(-low * score // 100), high * score // 100
    windows = spark.sparkContext.broadcast((names, points, least, most))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points, least, most = windows.value
        best = [Best(len(names), negatives) for _ in range(positives)]
        for at, scores, same, _, ids in products(shipped.value, batches, scale, exact):
            scores[same] = NONE
            for p in range(positives):
                inside = (scores >= least[at, p][:, None]) & (scores <= most[at, p][:, None])
                best[p].add(at, np.where(inside, scores, NONE), ids)
        for p in range(positives):
            anchor, name, score = best[p].rows()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, shipped.value[0][anchor], names[anchor, p], points[anchor, p], np.full(len(anchor), p), name, score)], ["anchor", "anchor_id", "positive_id", "positive_score", "place", "id", "score"])

    kind = "anchor long, anchor_id long, positive_id long, positive_score long, place long, id long, score long"
    merged = best_of(rows.mapInArrow(hard, kind), negatives, "anchor", "place")
    return materialize(merged.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
