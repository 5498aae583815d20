"""File readers with fixed schemas; the raw export is read by header name.

A missing path is an error: Spark raises ``PATH_NOT_FOUND`` from the reader,
which is the behaviour wanted, so no existence check is added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.constants import RAW_ENCODING
from freightlens.sources.records import fields_of, read_records
from freightlens.sources.schemas import (
    INVENTORY_SCHEMA,
    RAW_ORDER_LINE_SCHEMA,
    ROUTE_LOOKUP_SCHEMA,
)

# Column holding the position of a line in the input files, used as the
# "first occurrence" order when de-duplicating file input.
FILE_ORDER_KEY = "file_order_key"


# Why a line was not read; NULL on good lines.
REJECT_REASON = "reject_reason"
_BROKEN_LINE = "_broken_line"
REJECTED_LINE = "rejected_line"


def _as_number(text: Column, dtype: T.DataType) -> Column:
    """Text as ``dtype``; NULL where it is no such number or would lose digits."""
    value = text.try_cast(dtype)
    if not isinstance(dtype, T.DecimalType):
        return value
    exact = text.try_cast("decimal(38,18)")
    return F.when(value == exact, value)


def _header(spark: SparkSession, path: str, encoding: str, multi_line: bool = True) -> list[str]:
    """The column names of the first file; only its first record is parsed."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    reader = reader.option("encoding", encoding).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path).columns


def raw_order_lines_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_ORDER_LINE_SCHEMA,
    encoding: str = RAW_ENCODING,
    key: str = "Order Id",
) -> DataFrame:
    """Every record of the raw export: Latin-1 text, header line, quoted fields,
    which may hold line breaks; a large file is read by many tasks all the same
    (see ``sources.records``).

    Columns are found by their header names, in any order; a column of
    ``schema`` that the header lacks is an error naming it, and files whose
    headers differ are an error. All other columns are kept as text. Numbers
    are read as text and cast, so no digit is rounded away.

    Adds ``file_order_key`` = (file path, byte offset of the split, position in
    the split), the order of the records in the files, and ``reject_reason``:
    NULL on good lines, else ``broken line`` (more or fewer fields than the
    header, or a quote that is not closed) or the names of the columns that do
    not hold their type. A line without a key is rejected as well.
    """
    header = _header(spark, path, encoding)
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"the raw export has no column {', '.join(missing)}")
    records = read_records(spark, path, encoding)
    # As a generator, so that a record is parsed once and not for each column.
    fields = F.inline(F.array(fields_of(F.col("text"), header, _BROKEN_LINE)))
    lines = records.select(F.struct(*records.columns).alias("_record"), fields)
    own = {c: F.col(f"_record.{c}") for c in records.columns}
    names = F.array(*[F.lit(c) for c in header])
    found = F.array(*[F.trim(F.col(f"`{c}`")) for c in header])
    differs = F.raise_error(F.concat(F.lit("another header in "), own["file"])).cast("boolean")
    lines = lines.where(~own["first"] | F.when(found == names, F.lit(False)).otherwise(differs))
    lines = lines.select(
        *[F.col(f"`{c}`") for c in header],
        F.when(own["broken"], own["text"]).otherwise(F.col(_BROKEN_LINE)).alias(_BROKEN_LINE),
        F.struct(own["file"], own["block"], own["pos"]).alias(FILE_ORDER_KEY),
    )
    types = {f.name: f.dataType for f in schema.fields}

    def typed(c: str) -> Column:
        raw = F.col(f"`{c}`")
        wanted = types.get(c, T.StringType())
        return raw if isinstance(wanted, T.StringType) else _as_number(raw, wanted)

    unread = [
        F.when(F.col(f"`{c}`").isNotNull() & typed(c).isNull(), F.lit(c))
        for c, t in types.items()
        if not isinstance(t, T.StringType)
    ]
    unread.append(F.when(F.col(f"`{key}`").isNull(), F.lit(key)))
    reason = F.when(F.col(_BROKEN_LINE).isNotNull(), F.lit("broken line")).otherwise(
        F.nullif(F.concat_ws(", ", *unread), F.lit(""))
    )
    return lines.select(
        *[typed(c).alias(c) for c in header],
        FILE_ORDER_KEY,
        reason.alias(REJECT_REASON),
        F.coalesce(
            F.col(_BROKEN_LINE), F.when(reason.isNotNull(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in header])))
        ).alias(REJECTED_LINE),
    )


def read_raw_order_lines_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The good lines of the raw export (see ``raw_order_lines_checked``)."""
    lines = raw_order_lines_checked(spark, path, **options)
    return lines.where(F.col(REJECT_REASON).isNull()).drop(REJECT_REASON, REJECTED_LINE)


def read_raw_rejects_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The other lines: position, reason, and the line itself (as JSON where it
    could be split into fields)."""
    lines = raw_order_lines_checked(spark, path, **options)
    return lines.where(F.col(REJECT_REASON).isNotNull()).select(
        FILE_ORDER_KEY, REJECT_REASON, REJECTED_LINE
    )


def _read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, found by their header names in any order. A
    column the header lacks is an error naming it; other columns are left out."""
    header = _header(spark, path, "UTF-8", multi_line=False)
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    types = {f.name: f.dataType for f in schema.fields}
    own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return (
        spark.read.schema(own)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
        .select([f"`{f.name}`" for f in schema.fields])
    )


def read_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inventory snapshot (one row per product); ``True``/``False`` text is boolean."""
    return _read_quoted_csv(spark, path, INVENTORY_SCHEMA)


def read_route_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """Route-segment lookup; every field is quoted in the file."""
    return _read_quoted_csv(spark, path, ROUTE_LOOKUP_SCHEMA)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
