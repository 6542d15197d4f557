"""The corpus pipeline: documents to cleaned, deduplicated, tokenised training data.

Every stage takes all that its predecessor kept and gives the columns of documents, extra ones with whatever names among them; the
last gives token ids. Stages that filter decide row by row (toxicity, decontamination) or by groups of alike rows (near-dedup, where
of repeated rows one stays), so repeated rows, ties and null or repeated doc_ids have the results that the stages below state. A null text is no
reason to drop a row: it is clean, counts as a text without words, and is encoded to no ids. Texts are taken whole, however long. Empty
tables, of documents, labels or benchmark items, give an empty or an unfiltered result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, pieces, secrets, simhash, toxicity
from graphloom.scratch import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go. It learns from the labels, which name some documents; null and missing labels
    do not train, and without any toxic label every document stays. Null texts and texts without a word stay; rows are judged one by one."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates one document stays: that of the smallest doc_id, a null doc_id last; of rows with one
    doc_id and fingerprint, the first as JSON. Texts without words, null ones among them, are alike."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, its question and its answer, go. Null and empty items and texts contain nothing;
    repeated items are one; rows are judged one by one."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets leave the texts, and n_chars follows; every document stays. Rows without a secret, null texts and null
    lengths among them, stay as they are."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless and ids of every document; a null or empty text has no ids, repeated rows are encoded
    each, alike."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", dedup),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: The classifier, the fingerprints and the encoder have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
