"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes at most about ``train_docs`` labelled documents of each language (chosen by hash of their id; the bound is the
only sampling here, so a rare language keeps all of its documents), counts their n-grams in a few tasks, adds the counts of a
language up in one, and smooths them there into log-probabilities. Priors come from all labelled documents. The driver gets one column of
the matrix, buckets by languages, for each language. The matrix goes to the executors with the function; scoring reads each whole
text once, gathers a row per n-gram and adds them up between the texts' offsets, a bounded slice of texts at a time.

Nulls and odd rows: a null text, or one without a letter, is ``und`` with score 0. A null lang or doc_id never
trains; a null doc_id counts as held out. Repeated rows are scored each. A very long text is scored whole, alone in its slice.
Without any labelled document every text is ``und``. Ties between languages go to the first in order. Extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashed_text import Texts, mapped, ngrams, slices

UNKNOWN = "und"
SIZES = (1, 2, 3)
BITS = 16


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    #: For each n-gram size, a row per bucket and one of zeros for n-grams outside a text.
    logs: list[np.ndarray]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and its posterior probability."""
        t = Texts.of(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for n, log in zip(SIZES, self.logs, strict=True):
            total += np.add.reduceat(log[ngrams(t, n, BITS)], t.starts, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        return [self.langs[k] for k in best], 1 / odds.sum(axis=1)


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 5_000, tasks: int = 12, alpha: float = 0.5) -> Model:
    """Naive Bayes from the documents that aren't held out."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    docs_of = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(docs_of)
    if not langs:
        return Model([UNKNOWN], np.zeros(1), [np.zeros(((1 << BITS) + 1, 1), np.float32) for _ in SIZES])
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(1_000_000 * min(1.0, train_docs / docs_of[lang])))]), F.col("lang"))
    picked = labelled.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            own_langs = np.array(b.column(0).to_pylist(), object)
            texts = np.array(b.column(1).to_pylist(), object)
            for lang in set(own_langs):
                own = texts[own_langs == lang].tolist()
                sums = seen.setdefault(lang, np.zeros((len(SIZES), 1 << BITS), np.int64))
                for part in slices(own):
                    t = Texts.of(own[part])
                    for row, n in zip(sums, SIZES, strict=True):
                        row += np.bincount(ngrams(t, n, BITS), minlength=(1 << BITS) + 1)[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], ["lang", "counts"])

    def smooth(own: pa.Table) -> pa.Table:
        sums = np.zeros((len(SIZES), 1 << BITS))
        for c in own.column("counts"):
            sums += np.frombuffer(c.as_py(), np.int64).reshape(len(SIZES), -1)
        logs = np.log(sums + alpha) - np.log(sums.sum(axis=1, keepdims=True) + alpha * sums.shape[1])
        return pa.table({"lang": [own.column("lang")[0].as_py()], "logs": pa.array([logs.astype(np.float32).tobytes()], pa.binary())})

    counted = picked.select("lang", "text").repartition(tasks).mapInArrow(count, "lang string, counts binary")
    held = {r.lang: r.logs for r in counted.groupBy("lang").applyInArrow(smooth, "lang string, logs binary").toLocalIterator()}
    # a language whose documents all fall outside a sample knows no n-gram
    flat = np.full((len(SIZES), 1 << BITS), -np.log(1 << BITS), np.float32).tobytes()
    matrix = [np.zeros(((1 << BITS) + 1, len(langs)), np.float32) for _ in SIZES]
    for k, lang in enumerate(langs):
        for rows, own in zip(matrix, np.frombuffer(held.get(lang, flat), np.float32).reshape(len(SIZES), -1), strict=True):
            rows[:-1, k] = own
    prior = np.array([docs_of[lang] for lang in langs], float)
    return Model(langs, np.log(prior / prior.sum()), matrix)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), lettered.alias("lettered"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lettered", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    scored = mapped(narrow, schema, "doc_id long, held_out boolean, lettered boolean, lang_pred string, score double", model.score)
    return scored.select(
        "doc_id", "held_out", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered") & (F.col("lang_pred") != UNKNOWN), F.col("score")).otherwise(0.0).alias("score")
    )


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents, predict all."""
    return predict(docs, train(docs))
