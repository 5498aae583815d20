"""The operators of this package bound to the given tables.

Each query applies its operator with production parameters to the whole table
and derives the reported columns from what the operator returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import (
    exact_dedup,
    html_suffix,
    lexical_search,
    line_dedup,
    minhash,
    mixing,
    nn_descent,
    piece_codec,
    quality,
    token_alignment,
    token_scan,
    url_filter,
    warc,
)
from freightlens.llm.oracle import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "by_alias"
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mix.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("n_copies")).alias("taken"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)
    return near.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nn_descent.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return near.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark, f"pages-{uuid.uuid4().hex}")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    read = warc.resolved(warc.read_archives(spark, path))
    return read.select(
        F.col("id").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op6_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_scan.document_tokens(
        table(spark, sf_dir, "documents"), BYTE_RANKS, f"documents-{uuid.uuid4().hex}"
    )
    return counted.select(F.col("id").alias("doc_id"), "n_tokens", "shard", "file", "ordinal", "start")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines_failed",
        "lost_chars",
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_suffix.main_texts(table(spark, sf_dir, "pages"))
    return texts.select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_documents(
        table(spark, sf_dir, "documents"), PIECE_MODEL, with_ids=False
    )
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align_documents(
        table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL
    )
    return aligned.withColumnRenamed("id", "doc_id")


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = exact_dedup.exact_copies(table(spark, sf_dir, "documents"))
    return copies.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10
    )


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_minhash": op3_minhash,
    "op4_nn_descent": op4_nn_descent,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_token_scan": op6_token_scan,
    "op7_line_quality": op7_line_quality,
    "op8_html_text": op8_html_text,
    "op9_piece_codec": op9_piece_codec,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_chunk_recipes": op12_chunk_recipes,
    "op13_ranked_search": op13_ranked_search,
}
