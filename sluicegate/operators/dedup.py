"""Duplicates inside a batch and against a target.

A key may cover a large share of a batch, so nothing here gathers the rows of one key:

* ``first_copies`` filters ``row_number() = 1``; Spark then cuts every key to one row per
  task before the shuffle (WindowGroupLimit).
* ``flag_copies`` ranks in two steps.  Copies are first ranked per key and input
  partition, then only the winners of those are ranked per key.
* A target is looked up by the hash of its rows first: only hashes are compared with the whole
  target, full columns only where a hash occurs on both sides.
* ``null_safe_join`` compares with ``<=>``, which Spark plans as an equi-join with a
  shuffle directly under both sides, so adaptive execution can split a hot key.  The
  lookup side is reduced to distinct keys before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluicegate import messages
from sluicegate.functions.names import quoted
from sluicegate.functions.text import row_preview

IS_FIRST, LATER_COPIES = "is_first", "later_copies"
ROW_HASH = "_row_hash"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def first_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the least by ``order``; NULL keys are equal to each other."""
    ranked = df.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*_cols(keys)).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def flag_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``is_first`` and ``later_copies`` (on the first row of a key, else 0).

    A row that loses inside its own input partition is a later copy for certain and stays
    in its small group; the second ranking sees at most one row per key and partition.
    """
    salted = df.withColumn("_group", F.spark_partition_id())
    near = Window.partitionBy(*_cols(keys), "_group")
    local = salted.withColumn("_near", F.row_number().over(near.orderBy(*order))).withColumn(
        "_size", F.count(F.lit(1)).over(near))
    heads = F.when(F.col("_near") == 1, F.lit(-1)).otherwise(F.col("_group"))
    far = Window.partitionBy(*_cols(keys), "_head")
    ranked = (
        local.withColumn("_head", heads)
        .withColumn("_far", F.row_number().over(far.orderBy(*order)))
        .withColumn("_total", F.sum("_size").over(far))
    )
    first = (F.col("_near") == 1) & (F.col("_far") == 1)
    return (
        ranked.withColumn(IS_FIRST, first)
        .withColumn(LATER_COPIES, F.when(first, F.col("_total") - 1).otherwise(F.lit(0)).cast("long"))
        .drop("_group", "_near", "_size", "_head", "_far", "_total")
    )


def in_clash(first: str = IS_FIRST, later: str = LATER_COPIES) -> Column:
    """True for every row whose key occurs more than once."""
    return ~F.col(first) | (F.col(later) > 0)


def copy_errors(flagged: DataFrame) -> DataFrame:
    """Rows of clashing keys with their number of duplicate errors.

    k copies give 2(k-1) errors: k-1 on the first row, one on each other.
    """
    errors = F.when(F.col(IS_FIRST), F.col(LATER_COPIES)).otherwise(F.lit(1)).cast("long")
    return flagged.filter(in_clash()).withColumn("occurrences", errors)


def reject_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Business-key duplicates: every copy of a complete key, with its error count.

    Rows with a blank key part are exempt.
    """
    complete = reduce(lambda a, b: a & b, [
        F.coalesce(F.length(c.cast("string")) > 0, F.lit(False)) for c in _cols(keys)])
    return copy_errors(flag_copies(df.filter(complete), keys, order))


def null_safe_join(left: DataFrame, lookup: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on all columns of ``on`` with NULL = NULL; the lookup's key columns are dropped."""
    renamed = lookup.select(
        *[F.col(quoted(c)).alias(f"_r_{c}") if c in on else F.col(quoted(c)) for c in lookup.columns])
    same = reduce(lambda a, b: a & b, [
        F.col(quoted(c)).eqNullSafe(F.col(quoted(f"_r_{c}"))) for c in on])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{c}" for c in on])


def row_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """Hash of the compared columns; rows that are equal, NULL = NULL, have equal hashes."""
    kinds = dict(df.dtypes)
    # Adding 0.0 makes negative zero positive, as comparison does.
    return F.xxhash64(*[
        F.col(quoted(c)) + F.lit(0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(quoted(c))
        for c in sorted(on)])


def _distinct_keys(target: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.select(*_cols(on)).distinct()


def matching_keys(target: DataFrame, on: Sequence[str], probes: DataFrame) -> DataFrame:
    """Distinct target rows whose hash is among the hashes of ``probes`` (column ``_row_hash``).

    The first join moves hashes only; the rows themselves are read where one was found.
    """
    stored = target if ROW_HASH in target.columns else target.withColumn(ROW_HASH, row_hash(target, on))
    shared = stored.select(ROW_HASH).join(probes.select(ROW_HASH).distinct(), ROW_HASH, "left_semi").distinct()
    return _distinct_keys(stored.join(shared, ROW_HASH, "left_semi"), on)


def not_in_target(df: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without an equal row in the target."""
    return null_safe_join(df, _distinct_keys(target, on), on, "left_anti")


def in_target(df: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    return null_safe_join(df, _distinct_keys(target, on), on, "left_semi")


def mark_in_target(df: DataFrame, target: DataFrame, on: Sequence[str], flag: str,
                   when: Column | None = None, probes: DataFrame | None = None) -> DataFrame:
    """Add ``flag``: an equal row is in the target, and ``when`` holds.

    Rows outside ``when`` need no answer.  They get a probe number that the target does not
    have and are spread by it, so copies of one row do not meet in one task.  The number is
    that of their partition: unlike a row counter it is the same when a task runs again.

    ``probes`` are written rows with the hashes of ``df``; the types of the compared columns
    must then be those of the target.
    """
    lookup = _distinct_keys(target, on) if probes is None else matching_keys(target, on, probes)
    lookup = lookup.withColumn(flag, F.lit(True))
    if when is None:
        marked = null_safe_join(df, lookup, on, "left")
    else:
        probe = F.when(when, F.lit(0)).otherwise(1 + F.spark_partition_id())
        marked = null_safe_join(
            df.withColumn("_probe", probe),
            lookup.withColumn("_probe", F.lit(0)), [*on, "_probe"], "left").drop("_probe")
    return marked.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def mark_existing_keys(rows: DataFrame, clean: Column, target: DataFrame, keys: Sequence[str],
                       flag: str = "key_exists") -> DataFrame:
    """Look up the keys of clean rows in the target; flag every row that has a found key.

    Key parts are compared as columns and by plain equality, so NULL never matches.
    """
    candidates = rows.filter(clean).select(*_cols(keys)).na.drop().distinct()
    wanted = _distinct_keys(target, keys).na.drop()
    found = candidates.join(wanted, list(keys), "left_semi").withColumn(flag, F.lit(True))
    marked = null_safe_join(rows, found, keys, "left")
    return marked.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def new_files(files: DataFrame, ledger: DataFrame, file_hash: str = "file_hash") -> DataFrame:
    """Files whose content is not in the ledger yet."""
    return not_in_target(files, ledger, [file_hash])


def seen_files(files: DataFrame, ledger: DataFrame, batch: str, created: str,
               file_hash: str = "file_hash") -> DataFrame:
    """Files already loaded, each with its newest batch (``batch``, ``created``)."""
    newest = ledger.groupBy(file_hash).agg(
        F.max(F.struct(F.col(created), F.col(batch))).alias("_newest"))
    newest = newest.select(file_hash, F.col(f"_newest.{batch}").alias(batch), F.col(f"_newest.{created}").alias(created))
    return null_safe_join(files, newest, [file_hash], "inner")


def skipped_rows(rows: DataFrame, in_file: Column, in_store: Column,
                 labelled: Sequence[tuple[str, Column]], *keys: str) -> DataFrame:
    """Skip report: keys, reason and a short text of the row.

    A copy inside the file is reported as such even if the target has the row as well.
    """
    reason = F.when(in_file, F.lit(messages.DUPLICATE_IN_FILE)).when(in_store, F.lit(messages.ROW_EXISTS))
    return rows.filter(in_file | in_store).select(
        *keys, reason.alias("reason"), row_preview(labelled).alias("preview"))
