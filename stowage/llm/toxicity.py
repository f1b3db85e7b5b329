"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - threshold_k): the weights are shared by all thresholds, which are ordered.  A text's
severity is its expected grade, the sum of these probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Labelled rows that the model is fitted on, for each label at most; taken in order of a hash of the key.
MAX_LABELLED = 4000
#: Features kept, the least evidence for one (log-likelihood ratio), and the least labelled texts that hold it.
MAX_FEATURES, MIN_EVIDENCE, MIN_TEXTS = 1000, 25.0, 3
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Marks of a labelled toxic text above which its grade is 2 and 3.
GRADE_MARKS = (2, 5)
#: Probability of a grade from which a text is taken to have it.
REJECT = 0.3
TOKEN = re.compile(r"[^\W_]+")
#: Features of single tokens that a worker remembers.
MAX_TOKENS = 200_000


def token_features(token: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + token] + [token[:n] for n in BEGINNINGS if len(token) >= n]


def text_counts(text: str | None) -> Counter:
    return Counter(TOKEN.findall((text or "").lower()))


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, and thresholds in ascending order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, counts: Counter, known: dict[str, float] | None = None) -> float:
        """w . x, where a feature's x is log(1 + its occurrences)."""
        found: Counter = Counter()
        for token, n in counts.items():
            for f in self.of(token, known):
                found[f] += n
        return sum(self.weights[f] * math.log1p(n) for f, n in found.items())

    def of(self, token: str, known: dict | None) -> tuple[str, ...]:
        """The model's features that a token has."""
        if known is None:
            return tuple(f for f in token_features(token) if f in self.weights)
        got = known.get(token)
        if got is None:
            if len(known) >= MAX_TOKENS:
                known.clear()
            got = known[token] = tuple(f for f in token_features(token) if f in self.weights)
        return got

    def above(self, score: float) -> list[float]:
        """P(grade > k) for k = 0, 1, ..."""
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, score - t)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, grades: np.ndarray, levels: int, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of least mean negative log-likelihood plus ridge, by Adam on the exact gradient.

    The thresholds are a first one and the logarithms of the steps to the next, so they stay in order.
    """
    n, d = x.shape
    row, column = np.nonzero(x)  # few features occur in a text
    value = x[row, column].astype(float)
    parameters = np.zeros(d + levels - 1)
    parameters[d] = 1.0
    weight = np.ones(n) / n if weight is None else weight / weight.sum()
    m = np.zeros_like(parameters)
    v = np.zeros_like(parameters)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.r_[parameters[d], np.exp(parameters[d + 1 :])])
        score = np.bincount(row, value * parameters[column], n)
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -50, 50)))  # P(grade > k)
        edges = np.column_stack([np.ones(n), up, np.zeros(n)])
        p = np.maximum(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1], 1e-12)
        slope = np.column_stack([np.zeros(n), up * (1 - up), np.zeros(n)])
        lower, upper = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = weight * (upper - lower) / p
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, grades, weight * lower / p)
        np.add.at(by_cut, grades + 1, -weight * upper / p)
        by_cut = by_cut[1:levels]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.r_[np.bincount(column, value * by_score[row], d) + ridge * parameters[:d], tail[0], tail[1:] * np.exp(parameters[d + 1 :])]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        parameters -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return parameters[:d], np.cumsum(np.r_[parameters[d], np.exp(parameters[d + 1 :])])


def marked_rows(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1; a document with both counts as 1."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    return rows.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, limit: int) -> DataFrame:
    """(doc_id, text, label): up to ``limit`` labelled documents that are not held out for each of the labels 0 and 1, by a hash of their keys.

    Of a key's different texts the first in order is taken, so that the same tables give the same model.
    """
    marked = marked_rows(labels, label, key).filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.filter("label = 1").orderBy(*order).limit(limit).unionByName(marked.filter("label = 0").orderBy(*order).limit(limit))
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # 2 * limit keys at most
    return materialize(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> Ordinal:
    """Learn features, grades and model from a bounded sample of the labelled documents that are not held out.

    Features are the words and word beginnings that say most for label 1.  A toxic text is of grade 1, 2 or 3 by how often it has
    one of them, a text of label 0 of grade 0.  Without both labels, or without any telling feature, every severity is 0.
    """
    spark = documents.sparkSession
    sample = labelled_sample(documents, labels, label, key, text, limit)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of: tuple[Counter, Counter] = (Counter(), Counter())
            for told, y in zip(pdf["text"], pdf["label"]):
                of[y].update({f for token in text_counts(told) for f in token_features(token)})
            names = list({*of[0], *of[1]})
            yield pd.DataFrame({"feature": names, "clean": [of[0][f] for f in names], "toxic": [of[1][f] for f in names]})

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Ordinal({}, (50.0,))
    spread = sample.repartition(spark.sparkContext.defaultParallelism)
    found = spread.select("text", "label").mapInPandas(tally, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))

    def part(k, n, p):
        return F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)

    a, b, total = F.col("a"), F.col("b"), F.lit(float(n0 + n1))
    share = (a + b) / total
    ratio = 2 * (part(a, F.lit(n0), share) + part(b, F.lit(n1), share) + part(n0 - a, F.lit(n0), 1 - share) + part(n1 - b, F.lit(n1), 1 - share))
    telling = found.filter((b >= MIN_TEXTS) & (b / n1 > a / n0)).withColumn("evidence", ratio).filter(F.col("evidence") >= min(MIN_EVIDENCE, 2.0 * n1))
    # a feature that many clean texts have as well says little of one text
    telling = telling.filter(b / n1 > 8 * a / n0)
    top = [r["feature"] for r in telling.orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect()]
    if not top:
        return Ordinal({}, (50.0,))
    index = {f: i for i, f in enumerate(top)}

    def vector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, times, marks = [], [], []
            for told in pdf["text"]:
                counts: Counter = Counter()
                n = 0
                for token, times_ in text_counts(told).items():
                    has = [index[f] for f in token_features(token) if f in index]
                    n += times_ * bool(has)
                    for i in has:
                        counts[i] += times_
                at.append(list(counts))
                times.append(list(counts.values()))
                marks.append(n)
            yield pd.DataFrame({"label": pdf["label"], "at": at, "times": times, "marks": marks})

    rows = sample.select("label", "text", "doc_id").mapInPandas(vector, "label int, at array<int>, times array<int>, marks int").toPandas()
    x = np.zeros((len(rows), len(top)), np.float32)
    for i, (at, times) in enumerate(zip(rows["at"], rows["times"])):
        x[i, np.asarray(at, dtype=int)] = np.log1p(np.asarray(times, dtype=float))
    y = rows["label"].to_numpy()
    raw = np.where(y == 1, 1 + sum((rows["marks"].to_numpy() > m).astype(int) for m in GRADE_MARKS), 0)
    present = np.unique(raw)
    grades = np.searchsorted(present, raw)
    # the sample holds the labels in other shares than all labelled documents that are not held out
    share = {r["label"]: r["count"] for r in marked_rows(labels, label, key).filter(~held_out(F.col("doc_id"))).groupBy("label").count().collect()}
    weights, cuts = fit_ordinal(x, grades, len(present), np.where(y == 1, share[1] / n1, share[0] / n0))
    return Ordinal(dict(zip(top, weights.tolist())), tuple(cuts.tolist()))


def grade(documents: DataFrame, model: Ordinal, *, key: str = "doc_id", text: str = "text", least: float = REJECT) -> DataFrame:
    """(doc_id, severity, grade, toxic, held_out) of every row by its whole text.

    held_out: the model has not learned from the row, so its label (if it has one) tells how well the model does; severity: the expected grade; grade: the number of thresholds passed with probability ``least`` or more; toxic: 1 from grade 1 on, else 0.
    Null and empty texts have the severity of a text without features, a text of any length is read whole; rows without a key and repeated rows are each graded.
    An empty table gives an empty result; further columns are ignored.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shipped.value, {}
        for pdf in batches:
            up = [model.above(model.score(text_counts(t), known)) for t in pdf["text"]]
            passed = [sum(p >= least for p in u) for u in up]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "severity": [sum(u) for u in up], "grade": passed, "toxic": [int(g > 0) for g in passed], "held_out": pdf["held_out"]})

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(key)).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, severity double, grade int, toxic int, held_out boolean")


def keep_clean(documents: DataFrame, model: Ordinal, *, text: str = "text", least: float = REJECT) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are not toxic."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        model, known = shipped.value, {}
        return pd.Series([model.above(model.score(text_counts(t), known))[0] >= least for t in texts])

    return documents.filter(~toxic(F.coalesce(F.col(text), F.lit(""))))
