"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text.  The weights are learned from preference pairs (a document
of label 1 over one of label 0) by logistic loss on the difference of their features.  Documents below the
strength at the quantile of the labelled documents of label 0 are predicted to be of label 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, held_out, materialize

#: Preference pairs at least, if there are so many; beyond that every labelled row is in one.
PAIRS = 40_000
#: Scores from this on are predicted to be of label 1.
ACCEPT = 0.3

LETTERS, DIGITS, ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"[.!?](?:\s|$)")
SYMBOL = re.compile(r"[^\w\s.,;:'’\"()\-!?¿¡«»„“”]")
MARKS = re.compile(r"[^\w\s]{2,}")
NAMES = (
    "upper_words", "symbols", "mark_runs", "distinct", "repeats", "lone_marks", "word_length", "long_words", "digits",
    "letters", "line_repeats", "words", "distinct_pairs", "sentence_words",
)


def text_features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; a null or blank text has zeros, but counts as having neither words nor letters."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    lower = [w.lower() for w in words]
    distinct = len(set(lower))
    pairs = len(set(zip(lower, lower[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    cased = sum(1 for w in words if len(w) > 1 and w.isupper())
    alphabetic = sum(map(len, LETTERS.findall(text)))
    lone = sum(1 for w in words if len(w) <= 2 and not w[0].isalnum())
    ends = max(1, len(ENDS.findall(text)))
    return [
        cased / n,
        min(1.0, len(SYMBOL.findall(text)) / size),
        min(1.0, len(MARKS.findall(text)) / n),
        distinct / n ** 0.9,
        sum(map(str.__eq__, lower[1:], lower)) / n,
        lone / n,
        math.log1p(sum(map(len, words)) / n),
        sum(1 for w in words if len(w) > 25) / n,
        sum(map(len, DIGITS.findall(text))) / size,
        alphabetic / size,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n) / 10,
        pairs / max(1, n - 1),
        math.log1p(n / ends) / 5,
    ]


@dataclass(frozen=True)
class Ranking:
    """Standardised weights; ``cut``: the strength at the quantile, which gets the score ACCEPT; ``slope``: of the score."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, rising with the strength; ACCEPT at the cut."""
        at = self.slope * (self.strength(x) - self.cut) + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


def pair_sums(difference: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and then Hessian, row by row, of the logistic loss summed over pairs (better - worse)."""
    p = 1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))  # chance of the other order
    return np.concatenate([-(difference * p[:, None]).sum(axis=0), ((difference * (p * (1 - p))[:, None]).T @ difference).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], n: int, k: int, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Bradley-Terry weights of ``k`` features: minimum of the mean logistic loss of ``n`` pairs, whose ``sums`` a step needs once."""
    w = np.zeros(k)
    for _ in range(steps):
        found = sums(w) / n
        move = np.linalg.solve(found[k:].reshape(k, k) + ridge * np.eye(k), found[:k] + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights from rows in memory, paired at random."""
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    rng = np.random.default_rng(5)
    n = max(len(good), len(bad), min(pairs, len(good) * len(bad)))
    better, worse = good[np.arange(n) % len(good)], bad[rng.permutation(n) % len(bad)]
    difference = x[better] - x[worse]
    return newton(lambda w: pair_sums(difference, w), n, x.shape[1], ridge, steps)


def measured(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, x) of every row, stored: the features of its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "x": [text_features(t) for t in pdf["text"]]})

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInPandas(run, "doc_id long, held_out boolean, x array<double>"))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, stored, with their place ``at`` (from 0) in this order: their place in a task after the rows of the tasks before."""
    stored = materialize(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = stored.groupBy(F.shiftright("_id", 33).alias("_task")).agg(F.count("*").alias("_n"))  # a row for each task
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = stored.withColumn("_task", F.shiftright("_id", 33)).join(F.broadcast(starts), "_task")
    return placed.withColumn("at", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).select(*rows.columns, "at")


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def paired(told: DataFrame, counts: dict[int, int], mean: np.ndarray, scale: np.ndarray, pairs: int) -> DataFrame:
    """(d): standardised features of better less worse, stored.

    Every row is in a pair: those of the commoner label meet the other one's in turn, once each or as often as makes
    ``pairs`` (no two rows meet twice), so rows of the rarer label are in equally many pairs, give or take one a turn.
    """
    more = int(counts[1] >= counts[0])
    few = 1 - more
    times = max(1, math.ceil(min(pairs, counts[0] * counts[1]) / counts[more]))
    own = F.col("at") - F.when(F.col("label") == 1, counts[0]).otherwise(0)
    many = told.filter(F.col("label") == more).select(F.col("x").alias("a"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn"))
    many = many.select("a", F.pmod(F.col("own") + F.col("turn"), F.lit(counts[few])).alias("partner"))
    met = many.join(told.filter(F.col("label") == few).select(F.col("x").alias("b"), own.alias("partner")), "partner").select("a", "b")
    sign = 1 if more else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.clip((matrix(batch.column(i)) - mean) / scale, -8, 8) for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"d": list(sign * (a - b))}, pa.schema([("d", pa.list_(pa.float64()))]))

    return materialize(met.mapInArrow(run, "d array<double>"))


def fit_stored(pairs: DataFrame, n: int, k: int) -> np.ndarray:
    """Weights from all of ``pairs(d)``; tasks return sums, of which there are k + k * k."""

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for batch in batches:
                if len(batch):
                    total += pair_sums(matrix(batch.column(0)), w)
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype="int32"), "value": total})

        found = pairs.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
        return np.array([r["value"] for r in sorted(found)])

    return newton(sums, n, k)


def digits(values: np.ndarray, n: int = 9) -> tuple[float, ...]:
    """Rounded to ``n`` digits, so that the order in which tasks' sums come together does not show."""
    return tuple(float(f"{v:.{n}g}") for v in values)


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", pairs: int = PAIRS) -> Ranking | None:
    """Fit on all labelled rows that are not held out; None without both labels."""
    return fit(measured(documents, key=key, text=text), labels, key=key, label=label, pairs=pairs)


def fit(rows: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", pairs: int = PAIRS) -> Ranking | None:
    """:func:`train` on :func:`measured` rows.  Means, weights, cut and slope come from all labelled rows; the driver gets sums only.

    Rows are numbered in order of a hash of the key, so the same tables give the same model, whatever their order.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    marked = marked.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    told = in_order(rows.join(marked, "doc_id").select("label", F.xxhash64("doc_id").alias("h"), "doc_id", "x"), "label", "h", "doc_id", "x")
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    each = [F.col("x")[i] for i in range(len(NAMES))]
    shape = told.agg(F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.stddev_pop, each)).alias("scale")).first()
    mean, scale = np.array(digits(shape["mean"], 12)), np.array(digits(shape["scale"], 12))
    scale = np.where(scale > 1e-9, scale, 1.0)
    met = paired(told, counts, mean, scale, pairs)
    ranking = Ranking(tuple(map(float, mean)), tuple(map(float, scale)), digits(fit_stored(met, met.count(), len(NAMES))), 0.0, 1.0)
    discard(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranking.strength(matrix(batch.column(2))))], ["label", "h", "strength"])

    # with h, as equal texts have equal strengths, but no task is to sort them all
    strengths = materialize(told.select("label", "h", "x").mapInArrow(run, "label int, h long, strength double"))

    def between(places: list[int], *order: str) -> float:
        """Mean strength of the rows at two places in an order."""
        found = in_order(strengths, *order, "h").filter(F.col("at").isin(places)).select("strength").collect()
        return sum(r["strength"] for r in found) / len(found)

    # the share of label 0 is the quantile
    cut = between([counts[0] - 1, counts[0]], "strength")
    # slope: the score's logit follows the strength, in units of the distance between the two labels
    bad, good = (between([start + (n - 1) // 2, start + n // 2], "label", "strength") for start, n in ((0, counts[0]), (counts[0], counts[1])))
    return replace(ranking, cut=cut, slope=min(50.0, 8 / max(1e-9, good - bad)))


def score(documents: DataFrame, model: Ranking | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by its whole text; without a model every score is 0.5.

    Labels, language, source and key are no inputs of the score.  Null and empty texts are scored as texts without words.
    """
    return score_measured(measured(documents, key=key, text=text), model)


def score_measured(rows: DataFrame, model: Ranking | None) -> DataFrame:
    """:func:`score` of :func:`measured` rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            found = model.score(matrix(batch.column(2))) if model and len(batch) else np.full(len(batch), 0.5)
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= ACCEPT).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Ranking | None, *, text: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, that are predicted to be of label 1."""
    if model is None:
        return documents
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(np.array([text_features(t) for t in texts]).reshape(len(texts), -1)) >= ACCEPT) if len(texts) else pd.Series([], dtype=bool)

    return documents.filter(good(F.coalesce(F.col(text).cast("string"), F.lit(""))))
