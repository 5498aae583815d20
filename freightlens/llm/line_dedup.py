"""Line deduplication across documents.

Lines are exploded and normalised, and a 128-bit hash of each takes its
place; per hash the documents holding it are counted (as least and greatest
id, which tells one document from several and combines map-side). Hashes held
by too many documents are written as a table and joined back to the exploded
hashes, which gives each document the set of hashes it must drop. Documents
are then cut line by line, in order. Only hashes are shuffled until the last
join, which moves each text once.

Defined results: a null or empty text is one empty line; empty keys and keys
shorter than ``min_chars`` never drop; rows that share a document id count as
one document, and are cut alike; rows whose id is null neither drop lines nor
make others drop them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.llm.textops import SPACES
from freightlens.plans.session import materialise

MIN_CHARS = 10
_LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def line_key(line: str) -> str:
    """The line without outer white space, A-Z in lower case."""
    return line.strip(SPACES).translate(_LOWER)


def _hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode())


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(id, h)``: the distinct hashes of each row's keys of at least
    ``min_chars`` code points."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {line_key(x) for x in text.split("\n")}
                found = [_hash(k) for k in keys if len(k) >= min_chars]
                ids += [doc] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["id", "h"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.where("id is not null and text is not null").mapInArrow(
        explode, "id long, h binary"
    )


def drops_by_document(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int
) -> DataFrame:
    """``(id, drops)``: for each document that loses lines, their hashes."""
    spark = docs.sparkSession
    lines = materialise(spark, line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    held = lines.groupBy("h").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    # Written before the join, so that both its sides are plain shuffles and a
    # hash that very many documents hold can be split over several tasks.
    repeated = materialise(
        spark, held.where("first_id < last_id").select("h", "first_id"), "repeated-lines"
    )
    drops = lines.join(repeated, "h").where("id <> first_id").groupBy("id")
    return materialise(spark, drops.agg(F.collect_set("h").alias("drops")), "line-drops")


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, n_lines, n_dropped, kept_text, rest)``.

    A key held by two or more documents loses all its lines except in the
    document with the least id. ``n_lines`` counts lines before dropping;
    ``rest`` is a struct of the ``carry`` columns (by default just the id).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, dropped, texts = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("drops")):
                rows = (text.as_py() or "").split("\n")
                kept = rows
                if drop.is_valid:
                    gone = set(drop.as_py())
                    kept = []
                    for row in rows:
                        key = line_key(row)
                        if len(key) < min_chars or _hash(key) not in gone:
                            kept.append(row)
                totals.append(len(rows))
                dropped.append(len(rows) - len(kept))
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(totals, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(texts, pa.string()),
                    batch.column("rest"),
                ],
                ["id", "n_lines", "n_dropped", "kept_text", "rest"],
            )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in (carry or [id_col])]).alias("rest"),
    )
    drops = drops_by_document(docs, id_col, text_col, min_chars)
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("rest", rows.schema["rest"].dataType),
        ]
    )
    return rows.join(drops, "id", "left").mapInArrow(cut, schema)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut, in the columns of ``docs``. A row that loses
    lines and has no word left goes; a column ``n_chars`` gets the new length."""
    carry = [c for c in docs.columns if c != text_col] or [id_col]
    cut = drop_repeated_lines(docs, id_col, text_col, carry=carry)
    left = F.btrim(F.col("kept_text"), F.lit(SPACES)) != ""
    values = {c: F.col(f"rest.`{c}`") for c in carry}
    values[text_col] = F.col("kept_text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.length("kept_text").cast(kind)
    rows = cut.where((F.col("n_dropped") == 0) | left)
    return rows.select(*[values[c].alias(c) for c in docs.columns])
