"""A training-corpus pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from namewarden.llm import bpe, language, mixing, secrets, simhash
from namewarden.llm.common import ensure_checkpoints, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; the others keep all columns as they are.

    A null or empty text, or one without letters, is dropped, as is one that fits
    no language; a null label or source is no evidence. Rows that repeat an id are
    judged one by one, rows alike in id, text, label and source together. A table
    without a language of ten labelled rows keeps nothing, an empty one has none.
    """
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each near-duplicate class, with all columns as they are.

    Texts without words, null ones among them, are one class. Of rows that repeat
    the least id the one of the least hash of all columns stays, of equal rows
    one; null ids come last. Long texts are compared whole. An empty table stays
    empty.
    """
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, secrets in its text replaced by a mark and n_chars counted anew.

    A null text stays null with its n_chars as it was, an empty one empty; texts
    of any length are scanned whole. Repeats stay, other columns are as they are.
    """
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents, so that sources have their targets' words; columns stay.

    A document is there at most three times; one without words, so a null or
    empty text, isn't taken; a null source is a source of its own, null ids are
    ordered among themselves by a hash of their texts. Rows alike in id and text
    are taken alike. An empty table gives no rows.
    """
    return mixing.take(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, n_bytes, whole) of every document: its token ids, and whether they decode to its bytes.

    The text, n_chars and any other columns are left out, as the ids stand for
    the text. Null and empty texts have no ids and are whole; repeats stay.
    """
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The tokenizer and the fingerprint search aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; stages' tables lie in the checkpoint folder."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
