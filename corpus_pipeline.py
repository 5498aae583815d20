"""From raw documents to token ids: five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept. Between stages the rows are written as Parquet to the shared
folder and read again, so no stage recomputes another and a lost executor
costs files, not lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import line_dedup, minhash, mixing, piece_codec, quality
from freightlens.llm.queries import PIECE_MODEL, table
from freightlens.plans.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and rejected documents go."""
    return quality.clean_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents left empty by it."""
    return line_dedup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return minhash.deduplicated(docs, n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digests of ids and decoded text."""
    coded = piece_codec.encode_documents(docs, PIECE_MODEL)
    return coded.select(
        F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]

# Seeded sampling by Spark's hash and SentencePiece ids are beyond SQL; the
# pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
