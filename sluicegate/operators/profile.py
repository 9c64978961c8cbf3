"""Schema inference over text columns: every column in one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sluicegate.contracts import Contract, Field
from sluicegate.functions import casts, names
from sluicegate.sources.landing import BOOKKEEPING, ROW_NUMBER

# The types a user may choose, and the text length where NVARCHAR(MAX) starts.
FREE_TYPES = ("INT", "FLOAT", "DATE", "NVARCHAR(255)", "NVARCHAR(MAX)", "BIT")
LONG_TEXT = 300
INT_LIMIT = 2**31


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """What inference has to know of each column: a line per column, and per value of ``by``.

    Counts of filled cells, days, numbers and whole numbers, the largest number and the longest
    text, and, where ``df`` has row numbers, the first row that breaks each candidate type.
    States of parts of the data can be merged, so added files need no second look at old ones.
    """
    columns = columns or [c for c in df.columns if c not in (*BOOKKEEPING, *by)]
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(names.quoted(c)).cast("string").alias("cell"))
        for i, c in enumerate(columns)])
    row = F.col(ROW_NUMBER).cast("long") if ROW_NUMBER in df.columns else F.lit(None).cast("long")
    keys = [F.col(names.quoted(c)) for c in by]
    # One small set of expressions for all columns; each task sends one row per column.
    long = df.select(*keys, row.alias("row"), F.explode(cells).alias("e")).select(*by, "row", "e.position", "e.cell")
    clean = long.select(*by, "row", "position", F.length(casts.null_if_empty(F.col("cell"))).alias("size"),
                        casts.trimmed(F.col("cell")).alias("text"))
    dated = clean.select(*by, "row", "position", "size", "text", casts.parse_iso(F.col("text")).alias("day"))
    # A day is no number, so only the other cells are tried.
    parsed = dated.select(
        *by, "row", "position", "size", "day", F.when(F.col("day").isNull(), casts.parse_number(F.col("text"))).alias("number"))
    number, filled = F.col("number"), F.col("size").isNotNull()
    whole = F.coalesce(F.floor(number) == number, F.lit(False))
    totals = parsed.groupBy(*by, "position").agg(
        F.count("size").alias("filled"), F.count("day").alias("days"), F.count(number).alias("numbers"),
        F.count_if(whole).alias("whole"), F.max(F.abs(number)).alias("largest"), F.max("size").alias("longest"),
        F.min(F.when(filled & F.col("day").isNull(), F.col("row"))).alias("first_no_day"),
        F.min(F.when(filled & number.isNull(), F.col("row"))).alias("first_no_number"),
        F.min(F.when(filled & ~whole, F.col("row"))).alias("first_not_whole"))
    # An empty table still has its columns.
    listed = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column_name string")
    return listed.join(totals, "position", "left").select("column_name", "position", *by, *_COUNTS, *_EXTREMES, *_BREAKS)


_COUNTS = ("filled", "days", "numbers", "whole")
_EXTREMES = ("largest", "longest")
_BREAKS = ("first_no_day", "first_no_number", "first_not_whole")


def merge_states(states: DataFrame) -> DataFrame:
    """One line per column name; parts may lack columns or have them at other places."""
    return states.groupBy("column_name").agg(
        F.min("position").alias("position"), *[F.sum(c).alias(c) for c in _COUNTS], *[F.max(c).alias(c) for c in _EXTREMES],
        *[F.min(c).alias(c) for c in _BREAKS])


def inferred(states: DataFrame) -> DataFrame:
    """Types from states with one line per column: position, column_name, inferred_type, non_empty, max_len.

    Over all filled cells: all dates -> DATE; all numbers -> INT if all whole (BIGINT when
    one does not fit 32 bits), else FLOAT; otherwise text sized by its longest value.  An
    empty column is NVARCHAR(255).
    """
    whole = F.when(F.col("largest") >= INT_LIMIT, F.lit("BIGINT")).otherwise(F.lit("INT"))
    n = F.coalesce("filled", F.lit(0)).cast("long")
    kind = (
        F.when(n == 0, F.lit("NVARCHAR(255)"))
        .when(F.col("days") == n, F.lit("DATE"))
        .when((F.col("numbers") == n) & (F.col("whole") == n), whole)
        .when(F.col("numbers") == n, F.lit("FLOAT"))
        .when(F.col("longest") > LONG_TEXT, F.lit("NVARCHAR(MAX)"))
        .otherwise(F.lit("NVARCHAR(255)"))
    )
    return states.select(
        "position", "column_name", kind.alias("inferred_type"), n.alias("non_empty"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("max_len"))


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One line per column: position, column_name, inferred_type, non_empty, max_len (see ``inferred``)."""
    return inferred(profile_state(df, columns))


def inferred_contract(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> Contract:
    """Contract of a free file: blank columns left out, safe and unique names.

    Reads the one-row profile to the driver: its size is the number of columns.
    """
    profile = infer_schema(df, columns).orderBy("position").collect()
    filled = [r for r in profile if r["non_empty"] > 0]
    safe = names.unique_names(
        [names.sanitize_name(r["column_name"]) for r in filled], [r["position"] for r in filled])
    fields = tuple(Field(r["column_name"], n, r["inferred_type"]) for r, n in zip(filled, safe))
    return Contract(id=f"free:{table}", title=table, table=names.sanitize_name(table), fields=fields, flow="free")
