"""Landing scans: header-driven files as text rows that know where they came from.

A scan is parsed once and staged as Parquet in the shared work folder.  Everything later
(inference, casts, duplicate checks, row numbers) reads the staged columns, so text is not
parsed twice and the positions it is numbered by cannot change between two jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F

from sluicegate.functions.casts import null_if_empty
from sluicegate.functions.names import is_named, quoted, unique_names
from sluicegate.session import written

FILE, BLOCK, POSITION, ROW_NUMBER = "_file", "_block", "_position", "row_number"
BOOKKEEPING = (FILE, ROW_NUMBER)
FIRST_DATA_ROW = 2  # the header is row 1


class EmptyInput(ValueError):
    """The scan found no files, no rows, or only blank rows."""


def as_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column as text, except the bookkeeping ones; blanks become NULL."""
    return df.select(*[
        F.col(quoted(c)) if c in keep else null_if_empty(F.col(quoted(c)).cast("string")).alias(c)
        for c in df.columns
    ])


@dataclass(frozen=True)
class Landing:
    """Files below ``paths`` whose name matches ``glob``; each reader lists them by itself."""

    spark: SparkSession
    paths: str | Sequence[str]
    glob: str = "*"

    def load(self, reader: DataFrameReader) -> DataFrame:
        paths = self.paths if isinstance(self.paths, str) else list(self.paths)
        return reader.option("pathGlobFilter", self.glob).load(paths)

    def files(self) -> DataFrame:
        """One row per file; the content is read only if it is used."""
        return self.load(self.spark.read.format("binaryFile")).select(F.col("_metadata.file_path").alias(FILE), "*")


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> Landing:
    return Landing(spark, paths, glob)


def scan(landing: Landing, fmt: str = "csv", **options) -> DataFrame:
    """Read header-driven files with no inference; all cells stay text.

    CSV files of one call must share a header; one that differs is refused by the reader
    (``enforceSchema=false``) instead of being shifted silently.  ``records`` reads files of
    different headers.
    """
    reader = landing.spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.options(inferSchema=False, escape='"')
        first = landing.load(reader).first()
        if first is None:
            raise EmptyInput("the files are empty")
        header = column_names([cell or "" for cell in first])
        clash = len({h.lower() for h in first if h}) < len([h for h in first if h])
        schema = ", ".join(f"{quoted(h)} string" for h in header)
        # Repeated headers are told apart by their place, which the reader cannot compare.
        return landing.load(reader.options(header=True, enforceSchema=clash).schema(schema))
    if fmt == "json":
        reader = reader.option("primitivesAsString", True)
    return landing.load(reader)


def column_names(header: Sequence[str]) -> list[str]:
    """Header cells as column names: blank ones ``_cN``, repeated ones with a suffix."""
    named = iter(unique_names([h for h in header if is_named(h)]))
    return [next(named) if is_named(h) else f"_c{i}" for i, h in enumerate(header)]


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns whose header is blank or was generated by a reader."""
    kept = [c for c in df.columns if is_named(c)]
    return df.select(*[F.col(quoted(c)) for c in kept])


def with_origin(df: DataFrame) -> DataFrame:
    """Attach file, block and position before anything can reorder the rows."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POSITION),
    )


def stage(df: DataFrame, path: str, without: DataFrame | None = None) -> DataFrame:
    """Write the scan once, text columns plus origin, and read it back.

    Files of ``without`` are left out by a join, so no list of paths passes the driver.
    """
    origin = (FILE, BLOCK, POSITION)
    rows = as_text(with_origin(drop_unnamed(df)), keep=origin)
    if without is not None:
        rows = rows.join(without.select(FILE), FILE, "left_anti").select(*[F.col(quoted(c)) for c in rows.columns])
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def number_rows(staged: DataFrame, first: int = FIRST_DATA_ROW) -> DataFrame:
    """Row numbers as in the source file; ``first`` is that of the first staged row.

    One count per input block, prefix sums over the blocks of a file, then block offset
    plus place in the block: no window ever sees more than one row per block.  The offsets are
    written, so that their size is known: they are sent to the rows, which are not shuffled.
    """
    blocks = staged.groupBy(FILE, BLOCK).agg(
        F.min(POSITION).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(blocks.select(
        FILE, BLOCK, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")), "offsets")
    number = (F.col("_offset") + F.col(POSITION) - F.col("_first") + first).alias(ROW_NUMBER)
    data = [F.col(quoted(c)) for c in staged.columns if c not in (BLOCK, POSITION)]
    return staged.join(offsets, [FILE, BLOCK]).select(*data, number)


def parquet_row_numbers(df: DataFrame) -> DataFrame:
    """Row numbers of a Parquet scan come straight from the reader: no shuffle at all."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        (F.col("_metadata.row_index") + FIRST_DATA_ROW).alias(ROW_NUMBER),
    )


def _any_filled(columns: Sequence[str]) -> Column:
    return F.coalesce(*[null_if_empty(F.col(quoted(c)).cast("string")) for c in columns]).isNotNull()


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every cell of ``columns`` is NULL or empty."""
    columns = columns or [c for c in df.columns if c not in BOOKKEEPING]
    return df.filter(_any_filled(columns))


def filled_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Filled cells per column, all columns in one aggregate (one row reaches the driver)."""
    row = df.agg(*[
        F.count(null_if_empty(F.col(quoted(c)).cast("string"))).alias(f"n{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def drop_blank_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop columns without a single filled cell."""
    columns = columns or [c for c in df.columns if c not in BOOKKEEPING]
    counts = filled_counts(df, columns)
    return df.select(*[F.col(quoted(c)) for c in df.columns if counts.get(c, 1) > 0])


def require_rows(df: DataFrame, message: str) -> None:
    """Raise unless there is a row; looks at one row only."""
    if df.isEmpty():
        raise EmptyInput(message)


def preview(df: DataFrame, order: Sequence[str], count: int = 5) -> DataFrame:
    """The first rows of a batch by position; a top-n, not a sort."""
    return df.orderBy(*order).limit(count)


def fingerprint_text(c: Column) -> Column:
    return F.sha2(c, 256)
