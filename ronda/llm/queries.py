"""Registered queries of the operators: the digests that the contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda.llm import bpe, fingerprints, hard_negatives, licenses, multi_index, packing, pii, pii_examples, quality, spelling, toxicity, url_filters, warc
from ronda.llm.jaccard_join import near_duplicate_groups
from ronda.llm.store import prepare_workers
from ronda.session import prepare

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.written("sketch").alias("fingerprint"),
        fingerprints.written("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, net).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_windows", "worst_word"
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filtered(url_filters.dated_captures(pages), url_filters.derived_entries(pages))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), every=100)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.license_scan(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"), edit_every=199)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.personal_data(docs, pii.fit(pii_examples.labelled(spark))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.prepared(table(spark, sf_dir, "embeddings")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_warc": op2_warc,
        "op3_fingerprints": op3_fingerprints,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_url_filters": op6_url_filters,
        "op7_quality": op7_quality,
        "op8_multi_index": op8_multi_index,
        "op9_licenses": op9_licenses,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_spelling": op11_spelling,
        "op12_pii": op12_pii,
        "op13_hard_negatives": op13_hard_negatives,
    }
