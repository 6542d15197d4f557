"""Toxicity by a classifier chain.

The categories stand in a fixed order, and the last one decides. Each has a linear (logistic) model over the distinct words and word prefixes
of a text, hashed to 2**20 buckets, plus the probabilities of the categories before it. When a later model is
trained, those probabilities are out-of-fold: they come from models that did not see the row. Training (FTRL-proximal,
whose L1 term leaves neutral words at exactly zero) runs on the driver over at most ``train_docs`` documents with and
as many without the last category, chosen by hash; that bound is the only sampling. All documents are then scored whole in one map.

Nulls and odd rows: a null text, or one without a word, has probability 0 in all categories. Labels that are null do
not train; a document labelled twice has the larger label. Null or repeated doc_ids and repeated rows are scored row by row. With no
labels of both values for a category, its probability is the share of ones seen (0 without labels). A probability that
ties with the threshold counts as toxic. A very long text is scored whole, alone in its slice. Extra columns are
ignored (``predict``) or kept (``keep_clean``). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashed_text import Texts, mapped, sample_ids, slices, word_features

BITS = 20


@dataclass
class Rows:
    """Sparse binary rows: the buckets of row k are ids[at[k]:at[k + 1]]."""

    at: np.ndarray
    ids: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def row(self, k: int) -> np.ndarray:
        return self.ids[self.at[k] : self.at[k + 1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self)), np.diff(self.at))
        return np.bincount(owner, weights=w[self.ids], minlength=len(self))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return sigmoid(rows.dot(self.weights) + before @ self.dense + self.bias)


def fit(rows: Rows, before: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 0.2, l1: float = 4.0, l2: float = 0.5) -> Linear:
    """FTRL-proximal logistic regression over sparse rows and the dense columns ``before``."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(1 << BITS), np.zeros(before.shape[1]), -35.0 if share == 0 else 35.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    dense, bias = np.zeros(before.shape[1]), float(np.log(share / (1 - share)))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(y)):
            ids, x = rows.row(k), before[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(ni)) / rate + l2))
            g = float(sigmoid(w.sum() + x @ dense + bias)) - y[k]
            z[ids] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rate * w
            n[ids] += g * g
            dense -= 0.05 * (g * x + 0.01 * dense)
            bias -= 0.01 * g
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate + l2))
    return Linear(weights, dense, bias)


@dataclass
class Chain:
    models: list[Linear]

    def probabilities(self, rows: Rows) -> np.ndarray:
        """Rows by categories; each category sees those before it."""
        found = np.zeros((len(rows), 0))
        for m in self.models:
            found = np.column_stack([found, m.predict(rows, found)])
        return found

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        rows = _rows(*word_features(Texts.of(texts), BITS), len(texts))
        found = self.probabilities(rows)
        found[np.diff(rows.at) == 0] = 0
        return list(found.T)


def _rows(owner: np.ndarray, ids: np.ndarray, n: int) -> Rows:
    return Rows(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), ids)


def _subset(rows: Rows, which: np.ndarray) -> Rows:
    parts = [rows.row(k) for k in which]
    return Rows(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), np.concatenate(parts) if parts else rows.ids[:0])


def fit_chain(rows: Rows, y: np.ndarray, folds: int = 3) -> Chain:
    """One model per column of y, later ones on out-of-fold probabilities of earlier ones."""
    fold = np.random.default_rng(11).permutation(len(rows)) % folds
    before, models = np.zeros((len(rows), 0)), []
    for c in range(y.shape[1]):
        models.append(fit(rows, before, y[:, c]))
        if c + 1 == y.shape[1]:
            break
        unseen = np.zeros(len(rows))
        for k in range(folds):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            unseen[outside] = fit(_subset(rows, inside), before[inside], y[inside, c]).predict(_subset(rows, outside), before[outside])
        before = np.column_stack([before, unseen])
    return Chain(models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", train_docs: int = 2500) -> Chain:
    """A chain over the 0/1 columns ``categories`` of labels, in that order."""
    rated = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(c).cast("int").alias(f"__{k}") for k, c in enumerate(categories)])
    names = [f"__{k}" for k in range(len(categories))]
    rated = rated.dropna(subset=names)
    picked = F.broadcast(sample_ids(rated.withColumnRenamed(id_col, "__id"), "__id", F.col(names[-1]), [0, 1], train_docs, 6))
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(picked, "__id").select(*names, "__text")
    schema = pa.schema([*((n, pa.int32()) for n in names), ("ids", pa.list_(pa.int32()))])

    def features(texts: list[str | None]) -> list[list]:
        owner, ids = word_features(Texts.of(texts), BITS)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return [np.split(ids.astype(np.int32), cuts)]

    table = mapped(narrow, schema, ", ".join(f"{n} int" for n in names) + ", ids array<int>", features).toArrow()
    lists = table.column("ids").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    ids = lists.values.to_numpy() if len(lists) else np.zeros(0, np.int32)
    y = np.column_stack([table.column(n).to_numpy() for n in names]).astype(float)
    order = np.lexsort((np.add.reduceat(ids.astype(np.int64), np.minimum(at[:-1], max(0, len(ids) - 1))) if len(ids) else np.zeros(len(y)), np.diff(at)))
    return fit_chain(_subset(Rows(at, ids), order), y[order])


def predict(docs: DataFrame, chain: Chain, categories: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.2) -> DataFrame:
    """(doc_id, p_<category>..., is_toxic) of every document; is_toxic is that of the last category, which sees the others."""
    names = [f"p_{c}" for c in categories]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names)])
    scored = mapped(narrow, schema, "doc_id long, " + ", ".join(f"{n} double" for n in names), chain.score)
    return scored.withColumn("is_toxic", F.col(names[-1]) >= threshold)


#: ``labels`` has one toxicity flag and one of quality: text of low quality comes first, as toxic text is often such.
CATEGORIES = ["low_quality", "toxic"]


def categorised(labels: DataFrame) -> DataFrame:
    """Labels with a column for each category; where quality is unknown, it counts as good."""
    return labels.withColumn("low_quality", F.when(F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0).cast("int")))


def flag(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels, score all documents."""
    return predict(docs, train(docs, categorised(labels), CATEGORIES), CATEGORIES)


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.2) -> DataFrame:
    """The documents, all columns, that are not toxic."""
    chain = train(docs, categorised(labels), CATEGORIES)
    k = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(k).to_pylist()
            toxic = np.concatenate([chain.score(texts[part])[-1] for part in slices(texts)]) if texts else np.zeros(0)
            yield b.filter(pa.array(toxic < threshold))

    return docs.mapInArrow(run, docs.schema)
