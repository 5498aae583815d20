"""Writers for the cleaned shipments, the inventory and the route lookup.

Parquet is the default sink. The CSV writer matches the original export: a
header, every field quoted, UTF-8, and no trimming (Spark's CSV writer trims
leading and trailing blanks unless told not to, and blanks such as a trailing
one in a category name are data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv_quoted(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    compression: str = "none",
    max_lines: int = 0,
) -> None:
    """A compressed file is read by one task, so give ``max_lines`` a file with
    ``compression``; 0 sets no bound."""
    (
        df.write.mode(mode)
        .option("compression", compression)
        .option("maxRecordsPerFile", max_lines)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
