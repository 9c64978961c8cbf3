"""Pages by number of a sorted table, without sorting the table for each page.

The table is written once in ranges of its sort key.  Tasks get wide ranges, with boundaries that
Spark samples; a task sorts its rows and cuts them into the ranges of the index, so the number of
tasks, and what they report to the driver, does not depend on how narrow these are.  The rows of
each range are counted exactly.  The running sums of these counts say which range holds the first
row of a page, so a page reads one range, or two where it ends in the next.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluicegate.functions.names import quoted

RANGE = "_range"
#: Rows that a task sorts at least, before it cuts them into ranges.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class PageIndex:
    """``path`` has a folder per range; ``starts`` are the rows before each range, and the total."""

    spark: SparkSession
    path: str
    schema: T.StructType
    columns: tuple[str, ...]
    order: tuple[Column, ...]
    ranges: tuple[int, ...]
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int = 50) -> DataFrame:
        """Page ``number`` (from 1) in the order of the index; pages after the last are empty."""
        first = (max(1, number) - 1) * size
        low = min(max(0, bisect_right(self.starts, first) - 1), max(0, len(self.ranges) - 1))
        high = low
        while high + 1 < len(self.ranges) and self.starts[high + 1] < first + size:
            high += 1
        near = list(self.ranges[low:high + 1])
        folders = [f"{self.path}/{RANGE}={r}" for r in near] or [self.path]
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders).filter(F.col(RANGE).isin(near))
        skip = max(0, first - self.starts[low]) if self.ranges else 0
        return rows.orderBy(*self.order).offset(skip).limit(size).select(*[F.col(quoted(c)) for c in self.columns])


def build_page_index(df: DataFrame, order: Sequence[str | Column], path: str, rows_per_range: int = 1_000_000,
                     rows: int | None = None) -> PageIndex:
    """Write ``df`` in ranges of about ``rows_per_range`` rows; ``order`` must tell all rows apart.

    ``rows`` saves a count where the size is known.  One number per range reaches the driver.
    """
    order = tuple(F.col(quoted(c)) if isinstance(c, str) else c for c in order)
    rows = df.count() if rows is None else rows
    ranges = max(1, -(-rows // rows_per_range))
    tasks = min(ranges, max(1, -(-rows // TASK_ROWS)))
    place = F.spark_partition_id() if tasks == ranges else F.floor(F.monotonically_increasing_id() / F.lit(rows_per_range))
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(RANGE, place)
    dealt.write.mode("overwrite").partitionBy(RANGE).parquet(path)
    spark = df.sparkSession
    written = spark.read.schema(dealt.schema).parquet(path)
    counts = written.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()
    starts = [0]
    for r in counts:
        starts.append(starts[-1] + r["n"])
    return PageIndex(spark, path, dealt.schema, tuple(df.columns), order, tuple(r[RANGE] for r in counts), tuple(starts))
