"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from namewarden.llm import bpe, clustering, decontamination, fingerprints, katz, language, mixing, permutation_index, resampling, secrets, simhash, tokens, toxicity
from namewarden.llm.common import cut, read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.half_edited(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose labels fit the text model and whose sources are their hosts, and pages, which declare a language and have an address."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumnRenamed("source", "host")
    pages = language.pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return language.identify(docs.unionByName(pages, allowMissingColumns=True), ("doc_id", "page_id"), host_col="host", declared_col="declared")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return permutation_index.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of order 2; order 3 goes over the check tool's disk and time, see the README's figures."""
    return katz.score(read(spark, sf_dir, "documents", "doc_id", "text"), order=2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = cut(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.decontaminate(docs, items).drop("spans")


def op13_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_permutation_index": op5_permutation_index,
    "op6_katz_backoff": op6_katz_backoff,
    "op9_token_counts": op9_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_decontamination": op12_decontamination,
    "op13_annulus_clustering": op13_annulus_clustering,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
    "op13_annulus_clustering": clustering.ORACLE,
}
