"""Token counts of documents in flat token files without an index.

A token file is nothing but little-endian 16-bit ids, each document closed by
the end-of-document id. Files are scanned in blocks; numpy finds the separators
of a block at once. A block knows neither its place in the file, nor the
document it starts in, nor how many came before, so each block yields a summary
and a prefix scan over the blocks of a file stitches them: running sums give a
block's place and the ordinal of its first document, a running maximum the
place of the separator before it.

Files come from Spark's text writer: a row's bytes are its ids and the line
separator is the end-of-document id, so no other sink is needed. The task that
writes a token file writes its manifest too, which row stands where, in the same
attempt: both become visible together, and no second reading of the input has to
meet the rows in the same order. So any input will do, re-dealt, sampled or
joined, and a task that is run again brings its own manifest. A task begins a
new file after ``FILE_BYTES``, so a file is larger only by its last document.
A file is read split by split, and no row or task holds more of it than a block
and a document.

Defined results: a null or empty text is a document of no tokens; a null id and
repeated rows are documents like others; ids after the last separator of a file
are a last document that is not closed; an odd byte at the end is an error; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightlens.plans.session import checkpoint_dir, materialise

# Fixed values of the public vocabulary.
END_OF_DOCUMENT = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 20  # ids
SEPARATOR_BYTES = END_OF_DOCUMENT.to_bytes(2, "little")
SEPARATOR = SEPARATOR_BYTES.decode("latin-1")
FILE_BYTES = 1 << 28
MANIFEST, TOKENS = 0, 1  # kinds of file
_BLOCK = pa.schema(
    {
        "file": pa.string(),
        "size": pa.int64(),
        "at": pa.int64(),
        "block": pa.int64(),
        "n_bytes": pa.int64(),
        "ends": pa.list_(pa.int32()),
        "n_ends": pa.list_(pa.int64()),
        "last": pa.list_(pa.int64()),
    }
)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks_path: str, id_col: str, text_col: str) -> None:
    """Write the documents' tokens as flat files under ``path/kind=1`` and, with
    the same names under ``path/kind=0``, the lines ``ordinal,id`` of each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        file, ordinal, size = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kinds, files, ordinals, values = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.array(enc.encode_ordinary(text.as_py() or ""), "<u2").tobytes()
                    if size >= FILE_BYTES:
                        file, ordinal, size = file + 1, 0, 0
                    kinds += [MANIFEST, TOKENS]
                    files += [file, file]
                    ordinals += [ordinal, ordinal]
                    values += [f"{ordinal},{'' if key is None else key}".encode(), ids]
                    ordinal, size = ordinal + 1, size + len(ids) + 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kinds, pa.int32()),
                        pa.array(files, pa.int32()),
                        pa.array(ordinals, pa.int64()),
                        pa.array(values, pa.binary()),
                    ],
                    ["kind", "file", "ordinal", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(encode, "kind int, file int, ordinal long, ids binary")
    # Within a task only: the order of rows in a file is that of the manifest.
    coded = coded.sortWithinPartitions("kind", "file", "ordinal")
    writer = coded.select("kind", "file", F.col("ids").cast("string").alias("value")).write
    writer = writer.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", 0).partitionBy("kind", "file").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(part, file, ordinal, id)``: which row stands where in the token files."""
    reader = spark.read.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1")
    lines = reader.text(f"{path}/kind={MANIFEST}")
    fields = F.split("value", ",")
    return lines.select(
        part_of("_metadata.file_name").alias("part"),
        F.col("file").cast("int"),
        fields[0].cast("long").alias("ordinal"),
        F.nullif(fields[1], F.lit("")).cast("long").alias("id"),
    )


def part_of(name: str) -> Column:
    return F.regexp_extract(name, r"part-(\d+)-[^/]*$", 1).cast("int")


def _separators(data: bytes) -> np.ndarray:
    """The places of the separator's bytes, at even and at odd ones: which of
    these ids begin at is known when the blocks are stitched."""
    found = [np.frombuffer(data, "<u2", (len(data) - odd) // 2, odd) == END_OF_DOCUMENT for odd in (0, 1)]
    return np.sort(np.concatenate([2 * np.flatnonzero(x) + odd for odd, x in enumerate(found)]))


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size, at, block, n_bytes, ends, n_ends, last)``: the blocks of
    each split ``at`` of a file of ``size`` bytes. ``ends`` are the places in
    the block of the separator's bytes; their number and the last of them are
    given for even and for odd places."""

    def summary(key: tuple, block: int, lines: list[bytes]) -> pa.RecordBatch:
        data = b"".join([x for line in lines for x in (line, SEPARATOR_BYTES)])
        ends = _separators(data)
        sides = [ends[ends % 2 == odd] for odd in (0, 1)]
        values = [*key, block, len(data), ends, [len(x) for x in sides], [x[-1] if len(x) else None for x in sides]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _BLOCK.types)], _BLOCK.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, lines, size = None, 0, [], 0
        for batch in batches:
            for *own, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own != key or size >= 2 * BLOCK:
                    if lines:
                        yield summary(key, block, lines)
                    key, block, lines, size = own, block + 1 if own == key else 0, [], 0
                lines.append(line)
                size += len(line) + 2
        if lines:
            yield summary(key, block, lines)

    # A file's bytes come as lines, as a row must not hold a file; a line is a
    # document, or a part of one that holds the separator's bytes off by one.
    reader = spark.read.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1")
    lines = reader.option("pathGlobFilter", "part-*").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("line"),
    ).mapInArrow(
        scan,
        "file string, size long, at long, block long, n_bytes long, "
        "ends array<int>, n_ends array<long>, last array<long>",
    )


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ordinal, start, n_tokens, closed)`` per document of the files."""
    blocks = materialise(spark, scan_blocks(spark, path), "token-blocks")
    key = ["file", "at", "block"]
    before = Window.partitionBy("file").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    # The reader leaves out the last line's end, so a file without a separator
    # there seems longer by one, and the byte order mark of UTF-8, which two
    # ids can look like.
    seems = F.sum("n_bytes").over(Window.partitionBy("file")) - F.col("size")
    lead = (
        F.when(F.col("size") % 2 == 1, F.raise_error(F.concat("file", F.lit(" has an odd number of bytes"))).cast("long"))
        .when(seems.isin(0, 2), F.lit(0))
        .when(seems.isin(-3, -1), F.lit(3))
        .otherwise(F.raise_error(F.concat("file", F.lit(" was not read whole"))).cast("long"))
    )
    side = F.pmod("first", F.lit(2)).cast("int")
    # Summaries only are stitched; the places stay where they were found.
    firsts = (
        blocks.select(*key, "size", "n_bytes", "n_ends", "last")
        .withColumn("first", lead + F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum(F.get("n_ends", side)).over(before), F.lit(0)))
        .withColumn("carried", F.max(F.get("last", side) + F.col("first")).over(before))
        .select(*key, "first", "ordinal", F.coalesce("carried", F.lit(-2)).alias("carried"))
    )
    aligned = F.filter("ends", lambda x: (x + F.col("first")) % 2 == 0)
    ends = blocks.select(*key, "size", "ends").join(firsts, key).select(
        "file", "size", "first", "ordinal", "carried", aligned.alias("ends")
    )
    ends = ends.select("*", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carried")).otherwise(F.get("ends", F.col("k") - 1) + F.col("first")) + 2
    end = F.col("end") + F.col("first")
    return ends.select(
        "file",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.shiftright(start, 1).alias("start"),
        F.shiftright(end - start, 1).alias("n_tokens"),
        (end < F.col("size")).alias("closed"),
    )


def document_tokens(
    docs: DataFrame, ranks_path: str, name: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, shard, file, ordinal, start, n_tokens)`` of every row of ``docs``,
    by writing its tokens as flat files and scanning those."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/token-files/{name}"
    write_token_files(docs, path, ranks_path, id_col, text_col)
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if written.select("path").isEmpty():  # names only, no content
        return spark.createDataFrame(
            [], "id long, shard int, file int, ordinal long, start long, n_tokens long"
        )
    counts = count_tokens(spark, f"{path}/kind={TOKENS}")
    counts = counts.withColumn("part", part_of("file")).withColumn(
        "file", F.regexp_extract("file", r"/file=(\d+)/[^/]*$", 1).cast("int")
    )
    # One row a document on both sides: never broadcast.
    found = read_manifest(spark, path).join(counts.hint("merge"), ["part", "file", "ordinal"], "left")
    checked = F.when(F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("a document is missing from the token files")).cast("long")
    )
    return found.select(
        "id", F.col("part").alias("shard"), "file", "ordinal", "start", checked.alias("n_tokens")
    )
