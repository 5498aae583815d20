"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

The documents are cut into segments of a bounded number of postings. A segment
is an inverted index: for each term asked for, the documents holding it and the
impact of the term there, greatest impact first. Segments are written as a
table, one row each; that takes no shuffle, so a term that every document holds
is no hot key.

Each query item is resolved on each segment without random access. Its terms'
lists are read downwards, always those whose next impact is greatest. What has
been read of a document is the lower end of its score; what its unread lists
may still bring, at most their next impacts, is added for the upper end. A
document whose upper end is below the k-th lower end is out. Reading goes on
until all others have both ends equal: then members, ties and scores are
final. The best of all segments are ranked per item; a task passes on k of
them at most for each item.

Items are taken in blocks of a bounded number of different terms (a parameter),
each of which is a pass over the documents, so what is sent to the tasks does
not grow with the items. Statistics are over all documents.

Defined results: null or empty texts have no term, and count neither as
documents nor as items; rows without an id are left out of the documents; rows
that repeat an id are documents of their own, ranked one after the other; item
rows that repeat id and text are one item, rows that only repeat the id are
items of their own; no documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.plans.session import materialise

BLOCK_TERMS = 200_000  # different terms of a block of items
SEGMENT = 1 << 20  # postings of a segment
STEP = 4  # a round reads down to this part of the greatest next impact

#: What separates terms becomes a blank, A-Z lower case; the bytes of other
#: characters than ASCII stay.
_FOLD = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of characters beyond
    ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# -- corpus statistics ---------------------------------------------------------
def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, documents per known term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, length = vocabulary.keys(), 0, 0
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(1):
                own = terms(text.as_py())
                if own:
                    n += 1
                    length += len(own)
                    found.update(known & set(own))
        keys = [-1, -2, *(vocabulary[t] for t in found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([n, length, *found.values()], pa.int64())],
            ["term", "n"],
        )

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, totals = np.zeros(len(vocabulary), np.int64), {-1: 0, -2: 0}
    for term, n in rows.collect():  # a row for each term of the block and two more
        if term < 0:
            totals[term] = n
        else:
            df[term] = n
    return totals[-1], totals[-2], df


# -- the index -----------------------------------------------------------------
_SEGMENT = T.StructType(
    [
        T.StructField("terms", T.ArrayType(T.IntegerType())),  # ascending
        T.StructField("ends", T.ArrayType(T.IntegerType())),  # of the terms' lists
        T.StructField("at", T.ArrayType(T.IntegerType())),  # into doc_ids
        T.StructField("impacts", T.ArrayType(T.LongType())),  # descending in a list
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
    ]
)


def segments(
    docs: DataFrame, vocabulary: dict[bytes, int], n_docs: int, length: int, df: np.ndarray
) -> DataFrame:
    """The impact-sorted lists of the known terms, a row for each segment."""
    weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)

    def sealed(ids: list[int], sizes: list[int], term: list[int], tf: list[int], held: list[int]):
        t, n = np.array(term, np.int64), np.array(tf, np.int64)
        at = np.repeat(np.arange(len(ids)), held)
        m = 25 + 75 * np.array(sizes, np.int64) * n_docs // length
        impacts = weights[t] * (1_000_000_000 * n // (1000 * n + 8 * m[at]))
        order = np.lexsort((at, -impacts, t))
        listed, ends = np.unique(t[order], return_counts=True)
        values = [listed, np.cumsum(ends), at[order], impacts[order], np.array(ids, np.int64)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v.astype(k.to_pandas_dtype())], pa.list_(k)) for v, k in zip(values, kinds)],
            _SEGMENT.names,
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        part: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(text.as_py())
                counted = Counter(own)
                found = known & counted.keys()
                if not found:
                    continue
                ids, sizes, term, tf, held = part
                ids.append(doc)
                sizes.append(len(own))
                term += [vocabulary[t] for t in found]
                tf += [counted[t] for t in found]
                held.append(len(found))
                if len(term) >= SEGMENT:
                    yield sealed(*part)
                    part = ([], [], [], [], [])
        if part[0]:
            yield sealed(*part)

    return docs.mapInArrow(build, _SEGMENT)


# -- reading -------------------------------------------------------------------
def resolve(
    lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, step: int = STEP
) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, scores)``: all that can be among the best ``k``, with their
    final scores. ``lists``: the documents of a term, their impacts negated and
    ascending, and how often the item has the term."""
    lower = np.zeros(n_docs, np.int64)
    known = np.zeros(n_docs, np.int64)  # next impacts of the lists that have brought the document
    at = [0] * len(lists)
    ahead = [-int(negated[0]) * times for _, negated, times in lists]
    while True:
        down_to = max(ahead, default=0) // step
        for i, (docs, negated, times) in enumerate(lists):
            if ahead[i] <= down_to:
                continue
            end = int(np.searchsorted(negated, -(down_to // times), side="left"))
            after = -int(negated[end]) * times if end < len(negated) else 0
            known[docs[: at[i]]] += after - ahead[i]
            read = docs[at[i] : end]
            lower[read] -= negated[at[i] : end] * times
            known[read] += after
            at[i], ahead[i] = end, after
        upper = lower + sum(ahead) - known
        least = max(1, int(np.partition(lower, -k)[-k])) if n_docs >= k else 1
        left = np.flatnonzero(upper >= least)
        if np.array_equal(upper[left], lower[left]):
            return left, lower[left]


def _best(indexed: DataFrame, items: list[dict[int, int]], k: int) -> DataFrame:
    """``(item, doc_id, score)``: of each segment the best ``k`` of each item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                listed, ends, at, impacts, ids = (c[row].values.to_numpy() for c in batch.columns)
                negated = -impacts
                starts = dict(zip(listed.tolist(), zip([0, *ends[:-1].tolist()], ends.tolist())))
                out: tuple[list, list, list] = ([], [], [])
                for number, item in enumerate(items):
                    lists = [
                        (at[a:b], negated[a:b], times)
                        for (a, b), times in ((starts.get(t, (0, 0)), n) for t, n in item.items())
                        if b > a
                    ]
                    if not lists:
                        continue
                    docs, scores = resolve(lists, len(ids), k)
                    order = np.lexsort((ids[docs], -scores))[:k]
                    out[0].extend([number] * len(order))
                    out[1].extend(ids[docs[order]].tolist())
                    out[2].extend(scores[order].tolist())
                kinds = (pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o, kind) for o, kind in zip(out, kinds)], ["item", "doc_id", "score"]
                )

    return indexed.mapInArrow(read, "item int, doc_id long, score long")


# -- blocks of items -------------------------------------------------------------
def _blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple]]:
    """The items, block after block; a block has ``most_terms`` different terms
    at most or is one item."""
    sizes = items.select(F.xxhash64("id", "text").alias("h"), F.octet_length("text").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, math.ceil(total / (8 * most_terms)))
    key = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))
    for block in range(n_blocks):
        held, size = [], 0
        for row in items.where(key == block).toLocalIterator():
            n = len(set(terms(row["text"])))
            if held and size + n > most_terms:
                yield held
                held, size = [], 0
            held.append((row["id"], terms(row["text"])))
            size += n
        if held:
            yield held


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents
    with a score above 0; of equal scores the smaller id comes first."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    ).where("id is not null and text is not null")
    asked = items.select(
        F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")
    ).where("text is not null")
    kind = asked.schema["id"].dataType
    found = spark.createDataFrame([], T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    ))
    for held in _blocks(asked.distinct(), block_terms):
        vocabulary: dict[bytes, int] = {}
        wanted = [
            dict(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in own)) for _, own in held
        ]
        n_docs, length, df = _counts(rows, vocabulary)
        if not n_docs:
            continue
        indexed = materialise(spark, segments(rows, vocabulary, n_docs, length, df), "segments")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = _best(indexed, wanted, k).withColumn("rank", F.row_number().over(order))
        best = best.where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(n, item) for n, (item, _) in enumerate(held)],
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]),
        )
        found = found.unionByName(
            best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        )
    return found
