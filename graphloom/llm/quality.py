"""Quality by ordinal regression on graded ratings (a cumulative link model).

One weight vector over hashed tokens, token endings and repetitions is shared by all grades; ordered thresholds cut
its score into grades: P(grade <= k) = sigmoid(threshold_k - score). Documents are selected by a tail probability. The thresholds are a first value plus positive
steps, so they keep their order in training. Training (Adam, whole batches) runs on the driver over at most
``train_docs`` documents of each grade, chosen by hash; that bound is the only sampling. Ratings with more than
``most_grades`` values are cut into as many bands of about equal size, each graded by its mean. All documents are scored whole in one map.

Nulls and odd rows: a null text, or one without a token, is never selected: its tail probability is 0 and its
expected grade the lowest. Null and NaN ratings do not train; a document rated twice has the larger rating. Null or repeated
doc_ids and repeated rows are scored row by row. A tail probability that ties with the threshold selects. A very long text is scored whole, alone
in its slice. With fewer than two grades there is nothing to tell apart: the tail probability is 1 for every text with a token.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashed_text import Texts, mapped, sample_ids, style_features
from graphloom.llm.toxicity import sigmoid

BITS = 16


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last, a row per text."""
        return sigmoid(score[:, None] - self.thresholds)

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """Expected grade, the probabilities of more than the lowest grade and of the highest."""
        owner, ids, values = style_features(Texts.of(texts), BITS)
        above = self.above(np.bincount(owner, weights=self.weights[ids] * values, minlength=len(texts)))
        empty = np.bincount(owner, minlength=len(texts)) == 0
        above[empty] = 0
        expected = self.grades[0] + above @ np.diff(self.grades)
        if not above.shape[1]:
            above = np.where(empty, 0.0, 1.0)[:, None]
        return [expected, above[:, 0], above[:, -1]]


def fit(owner: np.ndarray, ids: np.ndarray, values: np.ndarray, grade: np.ndarray, grades: list[float], steps: int = 200, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Maximum likelihood of the cumulative link model; ``grade`` numbers the grades from 0."""
    n, k = len(grade), len(grades)
    if k < 2 or not n:
        return Model(grades or [0], np.zeros(1 << BITS), np.zeros(max(0, k - 1)))
    counts = np.bincount(grade, minlength=k)
    row_weight = (n / (k * np.maximum(counts, 1)))[grade]
    used, col = np.unique(ids, return_inverse=True)
    theta = np.zeros(len(used) + k - 1)
    theta[len(used)] = -0.5 * (k - 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, free = theta[: len(used)], theta[len(used) :]
        cuts = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        score = np.bincount(owner, weights=w[col] * values, minlength=n)
        below = np.column_stack([np.zeros(n), sigmoid(cuts - score[:, None]), np.ones(n)])
        slope = below * (1 - below)
        at = np.arange(n)
        mass = np.maximum(below[at, grade + 1] - below[at, grade], 1e-9)
        hi, lo = slope[at, grade + 1] / mass * row_weight, slope[at, grade] / mass * row_weight
        by_score = hi - lo
        by_cut = np.zeros(k + 1)
        np.add.at(by_cut, grade + 1, -hi)
        np.add.at(by_cut, grade, lo)
        by_cut = by_cut[1:-1]
        tails = np.cumsum(by_cut[::-1])[::-1]
        by_free = np.concatenate(([tails[0]], tails[1:] * np.exp(free[1:])))
        grad = np.concatenate([np.bincount(col, weights=by_score[owner] * values, minlength=len(used)) / n + l2 * w, by_free / n])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(1 << BITS)
    weights[used] = theta[: len(used)]
    free = theta[len(used) :]
    return Model(grades, weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", train_docs: int = 2000, most_grades: int = 20) -> Model:
    value = F.col(grade_col).cast("double")
    rated = ratings.where(F.col(id_col).isNotNull() & value.isNotNull() & ~F.isnan(value)).groupBy(F.col(id_col).alias("__id")).agg(F.max(value).alias("__grade"))
    grades = sorted(r[0] for r in rated.select("__grade").distinct().limit(most_grades + 1).collect())
    if len(grades) > most_grades:
        cuts = sorted(set(rated.agg(F.percentile_approx("__grade", [k / most_grades for k in range(1, most_grades)], 10_000)).first()[0]))
        band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("__grade")))
        banded = rated.withColumn("__band", band)
        means = {r["__band"]: r.m for r in banded.groupBy("__band").agg(F.avg("__grade").alias("m")).collect()}
        grades = sorted(means.values())
        rated = banded.select("__id", F.element_at(F.create_map(*[F.lit(x) for pair in means.items() for x in pair]), F.col("__band")).alias("__grade"))
    if not grades:
        return Model([0.0], np.zeros(1 << BITS), np.zeros(0))
    picked = F.broadcast(sample_ids(rated, "__id", F.col("__grade"), grades, train_docs, 5))
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(picked, "__id").select("__grade", "__text")
    schema = pa.schema([("grade", pa.float64()), ("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])

    def features(texts: list[str | None]) -> list[list]:
        owner, ids, values = style_features(Texts.of(texts), BITS)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return [np.split(ids.astype(np.int32), cuts), np.split(values.astype(np.float32), cuts)]

    table = mapped(narrow, schema, "grade double, ids array<int>, vals array<float>", features).toArrow()
    if not len(table):
        return Model(grades[:1], np.zeros(1 << BITS), np.zeros(0))
    ids, vals = (table.column(c).combine_chunks() for c in ("ids", "vals"))
    owner = np.repeat(np.arange(len(table)), np.diff(ids.offsets.to_numpy()))
    grade = np.searchsorted(grades, table.column("grade").to_numpy())
    return fit(owner, ids.values.to_numpy(), vals.values.to_numpy().astype(float), grade, grades)


def graded(labels: DataFrame) -> DataFrame:
    """The 0/1 flags as one rating: 0 of low quality, 1 good but toxic, 2 good."""
    return labels.withColumn("quality", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, F.col("quality")).otherwise(2 * F.col("quality")))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_tail, p_top, selected) of every document: the probabilities of more than the lowest grade, by which
    documents are selected, and of the highest."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["expected_grade", "p_tail", "p_top"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names)])
    scored = mapped(narrow, schema, "doc_id long, " + ", ".join(f"{n} double" for n in names), model.score)
    return scored.withColumn("selected", F.col("p_tail") >= least)


def rate(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Train on the labels as three grades, rate all documents."""
    return predict(docs, train(docs, graded(ratings)))
