"""CSV files whose headers differ, in one load.

All files of a load are parsed once, by position, and staged with their cells as an array.  The
first record of each file is its header; from it a row per file says where the file has the columns
that are asked for.  Data rows meet that row by a join on the file, so any number of column orders
is one plan, and a file that lacks a required column is a problem of that file alone.  The header
records are written, so that their size is known: rows of a file would meet in one task otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from sluicegate.contracts import Contract
from sluicegate.functions.casts import null_if_empty, trimmed
from sluicegate.functions.names import header_key, is_named
from sluicegate.session import written
from sluicegate.sources import landing
from sluicegate.sources.landing import BLOCK, FILE, POSITION, ROW_NUMBER, Landing

CELLS, POSITIONS = "_cells", "_positions"
NO_ROWS = "the file has no rows"  # blank lines only


def stage_records(files: Landing, width: int, path: str, without: DataFrame | None = None, **options) -> DataFrame:
    """Records of all files with their row numbers: _file, _cells, row_number (the header is 1).

    ``width`` is the number of cells that are read of a record; missing ones are NULL.  Files of
    ``without`` are left out by a join.
    """
    columns = [f"c{i}" for i in range(max(1, width))]
    reader = files.spark.read.format("csv").options(escape='"', header=False, inferSchema=False).options(**options)
    scanned = files.load(reader.schema(", ".join(f"{c} string" for c in columns)))
    rows = landing.with_origin(scanned).select(
        FILE, BLOCK, POSITION, F.array(*[null_if_empty(F.col(c)) for c in columns]).alias(CELLS))
    if without is not None:
        rows = rows.join(without.select(FILE), FILE, "left_anti").select(*rows.columns)
    rows.write.mode("overwrite").parquet(path)
    return landing.number_rows(files.spark.read.schema(rows.schema).parquet(path), 1)


def headers(records: DataFrame) -> DataFrame:
    """The header of each file: _file, _cells."""
    return records.filter(F.col(ROW_NUMBER) == 1).select(FILE, CELLS)


def _keys(cells: str) -> Column:
    return F.transform(cells, lambda c: F.lower(trimmed(F.coalesce(c, F.lit("")))))


def contract_positions(heads: DataFrame, contract: Contract) -> tuple[list[str], DataFrame, DataFrame]:
    """Headers of the contract, their places (from 1, 0: none) in each file, and problems of files.

    Headers match after trim and lower-casing; the first of equal ones counts.
    """
    wanted = list(dict.fromkeys(header_key(f.header) for f in contract.fields))
    required = [header_key(h) for h in contract.required_headers]
    keyed = heads.withColumn("_keys", _keys(CELLS))
    places = F.array(*[F.array_position("_keys", F.lit(k)).cast("int") for k in wanted]) if wanted else F.array().cast("array<int>")
    missing = F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), F.col("_keys"))
    problems = keyed.filter(F.size(missing) > 0).select(
        FILE, F.concat(F.lit("missing required columns: "), F.array_join(missing, ", ")).alias("problem"))
    return wanted, keyed.select(FILE, places.alias(POSITIONS)), problems


@F.pandas_udf(ArrayType(StringType()))
def _names(cells: pd.Series) -> pd.Series:
    """Column names of header records: repeated ones get a suffix; one record per file."""
    return cells.map(lambda row: landing.column_names([c or "" for c in row]))


def free_positions(heads: DataFrame) -> tuple[list[str], DataFrame]:
    """All named columns that any file has, by their first place, and their places in each file.

    The names come to the driver: as many as the load has different columns.
    """
    named = heads.select(FILE, _names(CELLS).alias("_named"))
    found = named.select(F.posexplode("_named").alias("place", "name")).groupBy("name").agg(F.min("place").alias("place"))
    wanted = [r["name"] for r in found.orderBy("place", "name").collect() if is_named(r["name"])]
    places = F.array(*[F.array_position("_named", F.lit(n)).cast("int") for n in wanted]) if wanted else F.array().cast("array<int>")
    return wanted, named.select(FILE, places.alias(POSITIONS))


def records_table(records: DataFrame, places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Data rows of the files of ``places`` as a text table: _file, row_number, ``columns``."""
    found = records.filter(F.col(ROW_NUMBER) > 1).join(places, FILE)
    return found.select(FILE, ROW_NUMBER, *[
        F.get(CELLS, F.get(POSITIONS, F.lit(i)) - 1).alias(name) for i, name in enumerate(columns)])


def read_records(records: DataFrame, files: DataFrame, contract: Contract | None) -> tuple[DataFrame, DataFrame]:
    """The table of a load and the problems of its files (``files``: _file of all that were read)."""
    heads = written(headers(records), "heads")
    empty = files.join(heads, FILE, "left_anti").select(FILE, F.lit(NO_ROWS).alias("problem"))
    if contract is None:
        columns, places = free_positions(heads)
        return records_table(records, places, columns), empty
    columns, places, problems = contract_positions(heads, contract)
    sound = places.join(problems.select(FILE), FILE, "left_anti")
    return records_table(records, sound, columns), problems.unionByName(empty)
