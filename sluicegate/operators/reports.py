"""Read side: history, catalog, labels, counts, top-n and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

HISTORY_LIMIT = 20
LOG_LIMIT = 100
PAGE_SIZE = 50


def positive_or(limit, default: int) -> int:
    """A usable top-n size: anything but a positive whole number gives the default."""
    good = isinstance(limit, int) and not isinstance(limit, bool) and limit > 0
    return limit if good else default


def latest(df: DataFrame, when: str, tie: str, limit: int) -> DataFrame:
    """Newest rows first.  Planned as a top-n per task, then one merge of n rows."""
    return df.orderBy(F.col(when).desc(), F.col(tie).desc()).limit(limit)


def recent_batches(batches: DataFrame, created: str, batch: str, limit=HISTORY_LIMIT) -> DataFrame:
    return latest(batches, created, batch, positive_or(limit, HISTORY_LIMIT))


def recent_events(log: DataFrame, when: str, tie: str, limit: int = LOG_LIMIT) -> DataFrame:
    return latest(log, when, tie, limit)


def batch_history(batches: DataFrame, errors: DataFrame, batch: str, created: str,
                  limit=HISTORY_LIMIT) -> DataFrame:
    """The newest batches with their errors, one line per error.

    A batch without errors has one line with NULL error columns.  Errors stay rows instead
    of lists: one batch may hold a large share of the whole error table.  The ``limit``
    batches are broadcast (``limit`` rows), so the error table is only scanned; sort the
    result by ``created`` descending, batch, row number to read it in order.
    """
    size = positive_or(limit, HISTORY_LIMIT)
    top = latest(batches, created, batch, size)
    details = [c for c in errors.columns if c != batch]
    hits = errors.join(F.broadcast(top), batch)
    quiet = top.join(F.broadcast(hits.select(batch).distinct()), batch, "left_anti")
    types = dict(errors.dtypes)
    silent = [F.lit(None).cast(types[c]).alias(c) for c in details]
    return hits.select(*top.columns, *details).unionByName(quiet.select(*top.columns, *silent))


def batch_errors(errors: DataFrame, batch: str, value, *order: str) -> DataFrame:
    return errors.filter(F.col(batch) == value).orderBy(*order)


def batch_summary(rows: DataFrame, errors: DataFrame, batch: str, row: str) -> DataFrame:
    """Per batch: total rows, valid rows and distinct rows having errors.

    Errors come down to one line per row before they meet the rows' counts.
    """
    totals = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("total_rows"))
    faulty = errors.select(batch, row).distinct().groupBy(batch).agg(
        F.count(F.lit(1)).alias("error_rows"))
    joined = totals.join(faulty, batch, "left")
    bad = F.coalesce("error_rows", F.lit(0)).cast("long")
    return joined.select(
        batch, "total_rows", (F.col("total_rows") - bad).alias("valid_rows"), bad.alias("error_rows"))


def single_row(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several frames side by side, as scalar subqueries of one row."""
    first = next(iter(counts.values()))
    spark = first.sparkSession
    return spark.range(1).select(*[
        df.agg(F.count(F.lit(1))).scalar().alias(name) for name, df in counts.items()])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(name, partition_rows)`` per table; Parquet answers from its footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("partition_rows")).select(F.lit(name).alias("name"), "partition_rows")
        out = one if out is None else out.unionByName(one)
    return out


def table_catalog(catalog: DataFrame, counts: DataFrame, created: str = "created") -> DataFrame:
    """Catalog entries with their row counts summed over partitions, newest first."""
    totals = counts.groupBy("name").agg(F.sum("partition_rows").alias("row_count"))
    return catalog.join(totals, "name").select("name", created, "row_count").orderBy(
        F.col(created).desc(), "name")


def label_overlay(defaults: DataFrame, labels: DataFrame, key: str,
                  texts: Mapping[str, str]) -> DataFrame:
    """Saved labels over defaults: ``texts`` maps a default column to its label column."""
    named = labels.select(F.col(key), *[F.col(v).alias(f"_l_{v}") for v in texts.values()])
    shown = [
        F.coalesce(F.nullif(F.trim(f"_l_{label}"), F.lit("")), F.col(default)).alias(default)
        for default, label in texts.items()
    ]
    rest = [c for c in defaults.columns if c not in texts]
    return defaults.join(named, key, "left").select(*rest, *shown)


def page_info(df: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / page_size).cast("long").alias("total_pages"))


def page_rows(df: DataFrame, key: Sequence[str], page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page in key order; page numbers below 1 mean page 1."""
    start = (max(1, page) - 1) * page_size
    return df.orderBy(*key).offset(start).limit(page_size)


def page_after(df: DataFrame, key: str, last_seen, page_size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows a known key: the cost does not grow with the page number."""
    return df.filter(F.col(key) > last_seen).orderBy(key).limit(page_size)


def count_by(df: DataFrame, column: str, name: str = "row_count") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
