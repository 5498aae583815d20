"""Records of quoted text files, read by many tasks.

A line break inside a quoted field is data, so a line of the file may begin
inside a field, and what it means depends on every quote before it. Files are
read as lines anyway, each block of a file by its own task. A prefix scan over
the blocks then tells where records begin:

1. For each line two patterns tell whether it ends inside quotes, if it began
   outside and if it began inside. A line so maps two states to two states;
   the maps of a block's lines, one after the other, give the block's map.
2. The maps of a file's blocks (one small row a block) are scanned in order,
   which gives the state every block begins in.
3. Each block is cut into records from its true state. A record that runs over
   the end of a block is put together from its pieces, at most two a block; for
   these only the blocks that begin or end inside quotes are cut once more.

Most lines need no pattern: one without a quote, or one that ends in a closing
quote, tells its states by its last characters. Lines that are whole records
are passed on as they are, without a step per line.

Quotes are escaped by doubling. A line ends with ``\\n``; a ``\\r`` before it
belongs to the line end outside quotes and to the field inside; alone it ends
no line. The encoding must keep the ASCII bytes, as Latin-1 and UTF-8 do.
A block without a record's end that lies in a field (a quote never closed, as a
rule) is not carried: its record is ``broken``, as is one that the file's end
leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightlens.plans.session import materialise

# Patterns for Java, which do not go back over what they have matched.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'  # what may stand between two quotes
_FIELD = f'(?:[^",][^,]*+|"{_QUOTED}"[^,]*+)?'
_OPENS = f'(?:{_FIELD},)*+"{_QUOTED}\\z'
STAYS_OUT = f"\\A{_OPENS}"
STAYS_IN = f'\\A{_QUOTED}(?:\\z|"[^,]*+,{_OPENS})'

#: Most blocks whose states are sent to every task, 40 bytes each.
BROADCAST_BLOCKS = 1 << 20


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(file, block, pos, line)``: the lines of all files in their order
    within a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
    )


def _ends_closed(line: Column) -> Column:
    """Whether the line ends in a quote after another character than a quote or
    a comma. No field is open behind it: the quote opens none, as these open at
    a field's begin, and is not doubled."""

    def closed(end: str) -> Column:
        opens = F.endswith(line, F.lit(f',"{end}')) | F.endswith(line, F.lit(f'""{end}'))
        return F.endswith(line, F.lit(f'"{end}')) & ~opens & (line != f'"{end}')

    return closed("") | closed("\r")


def _with_maps(lines: DataFrame) -> DataFrame:
    """With ``from_out`` and ``from_in``: whether each line ends inside quotes."""
    line = F.col("line")
    plain, closed = ~F.contains(line, F.lit('"')), _ends_closed(line)
    return lines.withColumns(
        {
            "from_out": F.when(plain | closed, F.lit(False)).otherwise(F.rlike(line, F.lit(STAYS_OUT))),
            "from_in": F.when(plain, F.lit(True)).when(closed, F.lit(False)).otherwise(F.rlike(line, F.lit(STAYS_IN))),
        }
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that belong to one block of one file."""
    block = batch.column("block").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield (batch.column("file")[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _after(state: bool, from_out: np.ndarray, from_in: np.ndarray) -> np.ndarray:
    """The state after each line. A line sets the state, keeps it or turns it;
    the last setting line and the turns since decide."""
    sets, turns = from_out == from_in, np.cumsum(from_out & ~from_in)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    value = np.where(last >= 0, from_out[last], state)
    since = turns - np.where(last >= 0, turns[last], 0)
    return value ^ (since % 2 == 1)


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, block, ends_out, ends_in)``: the state after each block for
    both states before it."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for key, run in _runs(batch):
            maps = [run.column(c).to_numpy(False) for c in ("from_out", "from_in")]
            found[key] = tuple(bool(_after(s, *maps)[-1]) for s in found.get(key, (False, True)))
    if found:
        columns = [*zip(*found), *zip(*found.values())]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "ends_out", "ends_in"]
        )


def _block_states(lines: DataFrame) -> DataFrame:
    """``(file, block, inside, ends_inside)``: the blocks that begin or end
    inside quotes."""
    maps = _with_maps(lines).select("file", "block", "from_out", "from_in").mapInArrow(
        _block_maps, "file string, block long, ends_out boolean, ends_in boolean"
    )
    # No line of a file is in two blocks, but several tasks may share a block's
    # number in an empty run; there is one row a block.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("ends_out") == F.col("ends_in"), F.col("ends_out") & ~F.col("ends_in")
    maps = maps.withColumn("_turns", F.sum(turns.cast("int")).over(order))
    last = F.last(F.when(sets, F.struct("ends_out", "_turns")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("_turns").over(before), F.lit(0)) - F.coalesce(last["_turns"], F.lit(0))
    inside = F.coalesce(last["ends_out"].cast("int"), F.lit(0)) + turned
    states = maps.withColumn("inside", F.pmod(inside, F.lit(2)) == 1)
    ends_inside = F.when(F.col("inside"), F.col("ends_in")).otherwise(F.col("ends_out"))
    states = states.select("file", "block", "inside", ends_inside.alias("ends_inside"))
    return states.where("inside or ends_inside")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, block, pos, text, goes_on, is_open, first)``: records, and the
    pieces of those that cross a block's end: ``goes_on`` continues the record
    of the block before, ``is_open`` goes on in the next. A piece that is both
    has no text."""
    key, state = None, False
    held: list = []  # of a record of several lines: file, block, pos, lines, goes_on, first
    rows: list[tuple] = []

    def close(is_open: bool) -> None:
        if held:
            file, block, pos, parts, goes_on, first = held
            text = None if goes_on and is_open else "\n".join(parts)
            rows.append((file, block, pos, text, goes_on, is_open, first))
            held.clear()

    def table() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        columns = list(zip(*rows)) or [()] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["file", "block", "pos", "text", "goes_on", "is_open", "first"],
        )

    def whole(run: pa.RecordBatch, alone: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        no = pa.array(np.zeros(len(alone), bool))
        columns = [*(run.column(c) for c in ("file", "block", "pos", "line")), no, no, pa.array(first)]
        names = ["file", "block", "pos", "text", "goes_on", "is_open", "first"]
        found = pa.RecordBatch.from_arrays(columns, names)
        return found if alone.all() else found.filter(pa.array(alone))

    for batch in batches:
        if not batch.num_rows:
            continue
        for own, run in _runs(batch):
            begins = own != key
            if begins:
                close(state)
                key, state = own, bool(run.column("inside")[0].as_py())
            after = _after(state, *(run.column(c).to_numpy(False) for c in ("from_out", "from_in")))
            before = np.r_[state, after[:-1]]
            alone = ~before & ~after
            first = np.zeros(run.num_rows, bool)
            first[0] = begins and own[1] == 0
            if alone.any():
                yield whole(run, alone, first)
            others = np.flatnonzero(~alone)
            rest = run.take(pa.array(others))
            lines, at = rest.column("line").to_pylist(), rest.column("pos").to_pylist()
            for k, line, pos in zip(others.tolist(), lines, at):
                if not before[k]:
                    held[:] = [*own, pos, [line], False, bool(first[k])]
                elif held:
                    # Of a piece that only goes on, the text is not needed
                    # unless it ends here; it is kept while the block lasts.
                    held[3].append(line)
                else:
                    held[:] = [*own, pos, [line], True, False]
                if not after[k]:
                    close(False)
            state = bool(after[-1])
        if rows:
            yield table()
    close(state)
    if rows:
        yield table()


def _put_together(pieces: DataFrame) -> DataFrame:
    """Whole records from the pieces that cross the ends of blocks."""
    order = Window.partitionBy("file").orderBy("block", "pos")
    numbered = pieces.withColumn("_n", F.sum((~F.col("goes_on")).cast("int")).over(order))
    piece = F.struct("block", "pos", "text", "is_open", "first")
    found = numbered.groupBy("file", "_n").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    lost = F.exists("p", lambda x: x["text"].isNull()) | F.element_at("p", -1)["is_open"]
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    first = F.element_at("p", 1)
    return found.select("file", first["block"].alias("block"), first["pos"].alias("pos"), text.alias("text"),
                        first["first"].alias("first"), lost.alias("broken"))


def read_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(file, block, pos, text, first, broken)``: every record of the files
    that is not an empty line; ``(file, block, pos)`` orders the records of a
    file, ``first`` marks a file's first one. Line breaks inside quotes are kept
    as they are."""
    lines = _lines(spark, path, encoding)
    states = materialise(spark, _block_states(lines), "block-states")
    crossed = states.count()
    key = ["file", "block"]

    def cut(how: str) -> DataFrame:
        if not crossed:
            told = lines.withColumn("inside", F.lit(False))
        elif crossed <= BROADCAST_BLOCKS:
            told = lines.join(F.broadcast(states), key, how)
        else:
            told = lines.join(states, key, how).repartition(*key).sortWithinPartitions(*key, "pos")
        told = _with_maps(told.withColumn("inside", F.coalesce("inside", F.lit(False))))
        told = told.select(*key, "pos", "line", "from_out", "from_in", "inside")
        return told.mapInArrow(
            _cut, "file string, block long, pos long, text string, goes_on boolean, is_open boolean, first boolean"
        )

    whole = cut("left").where("not goes_on and not is_open")
    records = whole.select(*key, "pos", "text", "first", F.lit(False).alias("broken"))
    if crossed:
        # A crossing piece begins or ends its block, which then begins or ends inside.
        crossing = cut("inner").where("goes_on or is_open")
        records = records.unionByName(_put_together(crossing))
    trimmed = F.regexp_replace("text", "\r\\z", "")
    return records.withColumn("text", trimmed).where(F.col("broken") | (F.col("text") != ""))


def fields_of(text: Column, names: list[str], broken: str) -> Column:
    """The fields of a record as a struct of strings; ``broken`` holds the
    record where it has more or fewer fields than ``names``."""
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, broken])
    options = {
        "quote": '"',
        "escape": '"',
        "multiLine": "true",  # line ends inside quotes stay as they are
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": broken,
        "maxCharsPerColumn": "-1",
    }
    return F.from_csv(text, quoted, options)
