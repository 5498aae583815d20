"""Exact document deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last bytes says so, so
equal stretches of text are cut alike wherever they stand. A chunk's 128-bit
hash becomes its identifier once it is verified: the distinct chunks are
brought together by hash, and no hash may stand for two chunks. Should one do
so, all identifiers are taken from the next seed of the hash and verified
again. A document is then the ordered list of its chunks' identifiers, its
recipe: 16 bytes for about a kilobyte of text. Equal texts are equal recipes,
so documents are grouped, and told their group, by recipe alone; a text moves
once, as chunks that each task has already made distinct, however often and
however long it is.

A group may hold a third of all rows: its size and greatest id combine
map-side, and the join that tells the rows is over written tables, so that a
hot recipe can be split over tasks.

Defined results: null and empty texts are equal, with an empty recipe; rows
that share id and text are marked alike and each counts in ``group_size``;
null ids never are the greatest, and a group of null ids only keeps them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.plans.session import materialise

WINDOW = 32  # bytes the rolling hash looks back
CUT_BITS = 10  # a place in 2^10 is a cut
LEAST, MOST = 256, 8192  # bytes of a chunk; LEAST is over WINDOW
SLICE = 1 << 20  # bytes hashed at a time
SEEDS = 8

#: A random number for each byte, from its hash.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint32)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Identify = Callable[[bytes, int], bytes]


def identify(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed=seed)


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z in lower case."""
    return (text or "").encode().translate(_LOWER)


def _cut_places(data: bytes) -> np.ndarray:
    """The offsets after which the rolling hash of the last ``WINDOW`` bytes
    asks for a cut. The hash sums each byte's number shifted by its age, built
    by doubling the length summed."""
    found = []
    for at in range(0, len(data), SLICE):
        start = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + SLICE) - start, start)]
        n = 1
        while n < WINDOW:
            older = h[:-n] << np.uint32(n)
            h = h.copy()
            h[n:] += older
            n *= 2
        places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + start
        found.append(places[places >= at] + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes, places: list[int] | None = None) -> list[int]:
    """Where the chunks of one text end; they hold ``LEAST`` to ``MOST`` bytes,
    the last one may be shorter. Depends on the text alone."""
    ends, last, size = [], 0, len(data)
    for place in [*(_cut_places(data).tolist() if places is None else places), size]:
        if place - last < LEAST and place < size:
            continue
        while place - last > MOST:
            last += MOST
            ends.append(last)
        if place > last:
            ends.append(place)
            last = place
    return ends


def _slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Normalised texts, some at a time: about ``SLICE`` bytes or one text."""
    held, size = [], 0
    for text in texts:
        data = normalised(text)
        if held and size + len(data) > SLICE:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def _chunked(held: list[bytes]) -> list[list[int]]:
    """The chunk ends of each text of a slice, relative to the text. The places
    are searched in all at once: chunks are longer than the hash looks back, so
    what stands before a text has no part in its cuts."""
    joined = b"".join(held)
    places = _cut_places(joined)
    starts = np.cumsum([0, *map(len, held)])
    own = np.searchsorted(places, starts, side="right")
    return [
        chunk_ends(data, (places[own[k] : own[k + 1]] - starts[k]).tolist())
        for k, data in enumerate(held)
    ]


def chunk_table(
    docs: DataFrame, text_col: str = "text", seed: int = 0, identifier: Identify = identify
) -> DataFrame:
    """``(h, chunk)``: every chunk of every text with its identifier."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in _slices(batch.column(0).to_pylist()):
                chunks = []
                for data, ends in zip(held, _chunked(held)):
                    chunks += [data[a:b] for a, b in zip([0, *ends], ends)]
                own = {c: identifier(c, seed) for c in chunks}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.values(), pa.binary()), pa.array(own.keys(), pa.binary())],
                    ["h", "chunk"],
                )

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(explode, "h binary, chunk binary")


def verified_seed(docs: DataFrame, text_col: str = "text", identifier: Identify = identify) -> int:
    """The first seed under which every identifier stands for one chunk."""
    for seed in range(SEEDS):
        chunks = chunk_table(docs, text_col, seed, identifier).distinct()
        shared = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if shared.isEmpty():
            return seed
    raise RuntimeError("chunks of equal hash under every seed")


def recipes(
    docs: DataFrame, id_col: str, text_col: str, seed: int, identifier: Identify = identify
) -> DataFrame:
    """``(id, recipe, n_chunks, text_sha256)`` of every row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for held in _slices(batch.column(1).to_pylist()):
                lists, counts, marks = [], [], []
                for data, ends in zip(held, _chunked(held)):
                    own = [identifier(data[a:b], seed) for a, b in zip([0, *ends], ends)]
                    lists.append(b"".join(own))
                    counts.append(len(own))
                    marks.append(hashlib.sha256(data).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(held)),
                        pa.array(lists, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array(marks, pa.string()),
                    ],
                    ["id", "recipe", "n_chunks", "text_sha256"],
                )
                at += len(held)

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    )
    return rows.mapInArrow(write, "id long, recipe binary, n_chunks long, text_sha256 string")


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifier: Identify = identify,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, keep_id, group_size, kept, n_chunks,
    text_sha256)``. Of equal texts the row with the greatest id is kept."""
    spark = docs.sparkSession
    seed = verified_seed(docs, text_col, identifier)
    own = recipes(docs, id_col, text_col, seed, identifier)
    own = materialise(spark, own, "recipes")
    groups = own.groupBy("recipe").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that the join shuffles both sides itself and a recipe that
    # very many rows hold can be split.
    groups = materialise(spark, groups, "recipe-groups")
    return own.join(groups, "recipe").select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "n_chunks",
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, in its columns; needs ids that are
    unique and not null."""
    gone = exact_copies(docs, id_col, text_col).where("not kept").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
