"""Incremental intake: every new file of a landing folder is imported once.

The file source remembers which paths it has handed out; whether their content was loaded
before is decided by the ledger, so the query needs no unbounded stream state and no
watermark.  Each micro-batch uses a load id made from the query's own name and number.  A
repeated micro-batch therefore finds its load committed and does nothing, or writes the
same folder again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluicegate.contracts import Contract
from sluicegate.plans.imports import import_files
from sluicegate.plans.store import Store
from sluicegate.sources.landing import list_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_landing(store: Store, path: str, contract: Contract, by: str, checkpoint: str,
                  name: str, fmt: str = "csv", glob: str = "*.csv", files_per_batch: int = 1000,
                  rules: Sequence[Column] = (), **options) -> StreamingQuery:
    """Import what is in the folder now, in micro-batches, and stop when done."""
    def load(arrived: DataFrame, number: int) -> None:
        # At most ``files_per_batch`` paths; the files themselves are read by the import.
        paths = [r["path"] for r in arrived.collect()]
        if paths:
            import_files(store, list_files(store.spark, paths), contract, by, fmt=fmt,
                         load_id=f"s-{name}-{number}", rules=rules, **options)

    arriving = (
        store.spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select("path")
    )
    return (
        arriving.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving rows to a Parquet table; each input file is taken exactly once."""
    return (
        source.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
