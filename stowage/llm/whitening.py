"""Whitening of embeddings from exact integer sums.

Vectors become integers; tasks add up sums and cross-products exactly, Spark adds their limbs, and the driver forms n·XᵀX - SSᵀ
in whole numbers.  Only then are there doubles, for the eigenvectors and the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite, lengths

#: Bits of a limb; sums of 2^32 limbs fit a long.
LIMB = 31
#: Rows that are multiplied at once.
ROWS = 4096


def exact_products(x: np.ndarray) -> np.ndarray:
    """xᵀx of whole numbers, exactly: in doubles where no sum reaches 2^53, else in Python's integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(len(x), 1) < 2**53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def limbs(value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, limbs) of Python integers of any size; a limb has its number's sign."""
    sign, rest, place = np.where(value < 0, -1, 1), abs(value), 0
    while place == 0 or (rest != 0).any():
        yield place, ((rest & (2**LIMB - 1)) * sign).astype(np.int64)
        rest, place = rest >> LIMB, place + 1


@dataclass(frozen=True)
class Model:
    """What a length's fit list gives: its size, sums about the shift, and unit eigenvectors as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values]

    def usable(self) -> np.ndarray:
        """Components of more variance than rounding makes."""
        return self.values > max(self.values.max(initial=0), 0) * len(self.sums) * np.finfo(float).eps

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n·y - S, exactly."""
        most = max(int(np.abs(y).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        kind = np.int64 if most < 2**61 else object
        return y.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Rows over the components; NaN where a component has no variance."""
        centred = (deviations / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred @ self.vectors / np.where(self.usable(), np.sqrt(np.abs(self.values)), np.nan)


def squares(deviations: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    most = int(np.abs(deviations).max(initial=0))
    if most * most * max(deviations.shape[1], 1) >= 2**63:
        deviations = deviations.astype(object)
    return (deviations * deviations).sum(axis=1).tolist()


def whole(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lattice(vectors: DataFrame, scale: float, shift: int, *, key: str, vector: str) -> DataFrame:
    """(id, x): each entry c of a finite vector as floor(scale * c) + shift."""
    rows = vectors.filter(finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("c"))
    fits = lambda c: F.abs(c * scale) < 2.0**61
    return rows.select("id", F.transform("c", lambda c: F.when(fits(c), F.floor(c * scale) + shift).otherwise(F.raise_error(F.lit("an entry of 2^61 or more after scaling")))).alias("x"))


def exact_scatter(fit: DataFrame, dim: int, shift: int) -> tuple[list[int], np.ndarray]:
    """(S, XᵀX) about the shift, in Python's integers; dim² sums reach the driver."""
    upper = np.triu_indices(dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                y = whole(batch.column(0).slice(i, ROWS)) - shift
                sums = sums + (y.sum(axis=0) if int(np.abs(y).max(initial=0)) < 2**50 else y.astype(object).sum(axis=0)).astype(object)
                cross = cross + exact_products(y)
        # the sums stand in a row before the first
        for row, column, value in ((np.full(dim, -1), np.arange(dim), sums), (*upper, cross[upper])):
            for place, limb in limbs(value):
                some = np.flatnonzero(limb)
                yield pa.RecordBatch.from_arrays([pa.array(row[some], pa.int32()), pa.array(column[some], pa.int32()), pa.array(np.full(len(some), place), pa.int32()), pa.array(limb[some])], ["i", "j", "place", "limb"])

    told = fit.mapInArrow(add, "i int, j int, place int, limb long").groupBy("i", "j", "place").agg(F.sum("limb").alias("limb")).toArrow()
    sums, cross = [0] * dim, np.zeros((dim, dim), object)
    for i, j, place, limb in zip(*(told[c].to_pylist() for c in ("i", "j", "place", "limb"))):
        if i < 0:
            sums[j] += limb << LIMB * place
        else:
            cross[i, j] += limb << LIMB * place
    return sums, cross + np.triu(cross, 1).T


def decompose(n: int, sums: list[int], cross: np.ndarray, components: int) -> Model:
    s = np.array(sums, dtype=object)
    exact = n * cross - np.outer(s, s)
    # the quotient of two Python integers is rounded once
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()], dtype=np.float64).reshape(len(sums), len(sums))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Model(n, sums, values, vectors, sum(exact.diagonal().tolist()) / (n * n))


def identity_error(fit: DataFrame, model: Model, shift: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance.

    The fit list's deviations add up to zero exactly, so its whitened rows are centred before they are multiplied.
    """
    some = np.flatnonzero(model.usable())
    if not len(some):
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(some), len(some)))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                w = model.whitened(model.deviations(whole(batch.column(0).slice(i, ROWS)) - shift))[:, some]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    told = fit.mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    covariance = np.zeros(len(some) ** 2)
    covariance[told["at"].to_numpy()] = told["value"].to_numpy() / model.n
    return float(np.abs(covariance.reshape(len(some), -1) - np.eye(len(some))).max())


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error) of every row with a finite vector.

    Each entry c counts as x = floor(scale * c) + shift.  The model comes from every distinct x vector once (n of them, sums S): covariance with
    divisor n, unit eigenvectors by falling eigenvalue, ``components`` of them at most, their largest entry positive.  deviation is the sum of (n·x - S)²,
    exact up to 38 digits; whitened is x - S/n on each component over the root of its eigenvalue, null where a component has no variance (fewer
    different vectors than components, or one alone; identity_error leaves these out, and is null if there are none).  Rows whose vector is null or
    holds null or non-finite entries are dropped; rows without a key and repeated rows are returned as they come.  Each length
    of vectors is a table of its own; empty vectors have no components, an empty table gives an empty result.  Further columns are ignored.
    Entries of 2^61 or more after scaling are an error.  The driver holds length² sums.
    """
    spark = vectors.sparkSession
    rows = lattice(vectors, scale, shift, key=key, vector=vector)
    fit = materialize(rows.select("x").distinct())
    found = spark.createDataFrame([], "id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    for dim in lengths(fit, "x"):
        own = fit.filter(F.size("x") == dim)
        n = own.count()
        if not dim:
            told = rows.filter(F.size("x") == 0).select("id", F.lit(n).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *[F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")], F.lit(None).cast("double").alias("identity_error"))
        else:
            model = decompose(n, *exact_scatter(own, dim, shift), components)
            told = applied(rows.filter(F.size("x") == dim), model, shift)
            told = told.withColumns({"n": F.lit(n).cast("long"), "explained": F.lit(model.explained()).cast("array<double>"), "identity_error": F.lit(identity_error(own, model, shift)).cast("double")})
        found = found.unionByName(told)
    return found.withColumnRenamed("id", key)


def applied(rows: DataFrame, model: Model, shift: int) -> DataFrame:
    """(id, deviation, whitened) of every row."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                d = model.deviations(whole(some.column(1)) - shift)
                w = model.whitened(d)
                flat = pa.array(w.ravel(), from_pandas=True)  # NaN: null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([*map(str, squares(d))]).cast(pa.decimal128(38, 0)), lists], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(project, "id long, deviation decimal(38,0), whitened array<double>")
