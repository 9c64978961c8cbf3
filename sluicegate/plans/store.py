"""Tables, ledgers and logs as Parquet folders.

Layout below the root::

    tables/<name>/load_id=<load>/          rows of one load, written by one job
    commits/<name>/                        log of versions: the load that took each
    ledger/batches/<write>/                one row per file of a load: status after a step
    ledger/steps/                          log of these writes, in order
    ledger/errors/load_id=<load>/          row errors
    ledger/skipped/load_id=<load>/         skipped rows with reason
    log/write_id=<write>/                  event log

A load becomes visible when it has taken a version of its table, or its last ledger step says
IMPORTED.  Until then its rows lie in a folder that no reader joins to, so a failed or repeated
job leaves nothing half done.  A version is a file that is created only if absent: of several
writers one gets it, and the others compare their rows with that load before they try the next.

Both logs are folded after every ``fold_every`` entries (``numbered_log``): the ledger into all its
rows, a log of versions into its list.  A reader opens the last fold and what came after it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluicegate import messages
from sluicegate.operators.changes import current_status
from sluicegate.plans.numbered_log import NumberedLog

LOAD = "load_id"
NEVER = "l-created"  # carries the schema of a table that has no rows yet
#: Ledger rows that a task sorts, and of a file.  They take few bytes in a file and hundreds in memory,
#: so their number is limited, not the size of files.
SORTED_ROWS, FILE_ROWS = 500_000, 50_000

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType()}


def _schema_of(text: str) -> T.StructType:
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BATCHES = _schema_of(
    "batch_id string, flow string, file_hash string, file_name string, table_name string, "
    "uploaded_by string, uploaded_by_name string, total_rows long, valid_rows long, "
    "error_rows long, inserted_rows long, skipped_rows long, status string, notes string, "
    "event_time timestamp")
STEPS = T.StructType([*BATCHES.fields, *_schema_of(f"{LOAD} string, step int").fields])
ERRORS = _schema_of("batch_id string, row_number long, field_name string, error_message string")
SKIPPED = _schema_of("batch_id string, row_number long, reason string, preview string")
LOG = _schema_of("username string, display_name string, logged_at timestamp")
# ``_row_hash`` lets a later load look its rows up without reading all columns of the table.
AUDIT = _schema_of("_batch_id string, _row_number long, _imported_at timestamp, _imported_by string, _row_hash long")


def _unbroken(start: int, numbers: list[int]) -> int:
    """The last number before the first gap after ``start``."""
    present = set(numbers)
    while start + 1 in present:
        start += 1
    return start


class Store:
    def __init__(self, spark: SparkSession, root: str, fold_every: int = 200):
        self.spark, self.fold_every = spark, fold_every
        self.root = root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    # -- tables ---------------------------------------------------------------------

    def recorded(self, name: str) -> T.StructType | None:
        """The schema that the table was created with; None when there is no such table."""
        return self._schema("tables", name, f"{LOAD}={NEVER}")

    def ensure(self, name: str, schema: T.StructType) -> bool:
        """Create the table unless it exists; True when it existed.

        An existing table must have all these columns, with these types; it may have more.
        """
        wanted = T.StructType([*schema.fields, *AUDIT.fields])
        have = self.recorded(name)
        if have is None:
            self._create(wanted, "tables", name, f"{LOAD}={NEVER}")
            return False
        kinds = {f.name: f.dataType for f in have}
        if any(kinds.get(f.name) != f.dataType for f in wanted):
            raise ValueError(f"columns do not match the existing table {name}")
        return True

    def write_rows(self, df: DataFrame, name: str, load_id: str) -> None:
        """All rows of one load, in one job, into the load's own folder."""
        df.write.mode("overwrite").parquet(self.path("tables", name, f"{LOAD}={load_id}"))

    def _stored(self, name: str) -> DataFrame:
        """Rows of all loads under the table's schema: columns that a load lacks are NULL."""
        schema = T.StructType([*self.recorded(name).fields, T.StructField(LOAD, T.StringType())])
        return self.spark.read.schema(schema).parquet(self.path("tables", name))

    def table(self, name: str) -> DataFrame:
        """Rows of committed loads only.  The ledger side prunes the load folders.

        The names of loads are sent to the rows: a shuffle would bring the rows of a load to one task.
        """
        return self._stored(name).join(F.broadcast(self.committed_loads(name)), LOAD, "left_semi")

    # -- versions -------------------------------------------------------------------

    def _commits(self, name: str) -> NumberedLog:
        return NumberedLog(self.spark, self.path("commits", name))

    def versions(self, name: str) -> DataFrame:
        """version, load_id of each commit of the table."""
        log = self._commits(name)
        upto, base = log.base()
        taken = log.after(upto).select(F.col("number").alias("version"), F.col("text").alias(LOAD))
        if base is None:
            return taken
        return self.spark.read.schema(taken.schema).parquet(base).unionByName(taken)

    def version(self, name: str) -> int:
        return self.versions(name).agg(F.max("version")).first()[0] or 0

    def commit(self, name: str, version: int, load_id: str) -> bool:
        """Take a version of the table for a load; False when another load has it."""
        log = self._commits(name)
        if not log.take(version, load_id):
            return False
        upto = log.base()[0]
        if version - upto >= self.fold_every:
            taken = self.versions(name)
            whole = _unbroken(upto, [r["version"] for r in taken.filter(F.col("version") > upto).collect()])
            if whole > upto:
                log.fold(taken.filter(F.col("version") <= whole).coalesce(1), whole)
        return True

    def rows_since(self, name: str, version: int, patience: float = 60.0) -> tuple[DataFrame, int]:
        """Rows of the loads that took a version after ``version``, one at least, and the last of these.

        A version is taken a moment before its load is named in it, and until then it is not
        listed; that moment is waited for.
        """
        until = time.monotonic() + patience
        while True:
            later = self.versions(name).filter(F.col("version") > version)
            n, last = later.agg(F.count(F.lit(1)), F.max("version")).first()
            if n and n == last - version:
                loads = later.filter(F.col("version") <= last).select(LOAD)
                return self._stored(name).join(F.broadcast(loads), LOAD, "left_semi"), last
            if time.monotonic() > until:
                raise TimeoutError(f"a version of {name} was taken but does not name its load")
            time.sleep(0.2)

    # -- ledgers --------------------------------------------------------------------

    @property
    def _steps(self) -> NumberedLog:
        return NumberedLog(self.spark, self.path("ledger", "steps"))

    def ledger(self) -> DataFrame:
        """All status events; step order is event order."""
        log = self._steps
        upto, base = log.base()
        return self._events(base, log.after(upto).collect())

    def _events(self, base: str | None, tail: list) -> DataFrame:
        """The rows of a fold and of the writes after it.  A step that was written again counts as
        it was written last.  The tail has about ``fold_every`` entries."""
        folders = {(load_id, step): folder for _, folder, load_id, step in sorted(
            (r["number"], *json.loads(r["text"])) for r in tail)}
        later = self._read_steps([self.path("ledger", "batches", f) for f in folders.values()])
        if base is None:
            return later
        earlier = self._read_steps([base])
        if folders:
            again = self.spark.createDataFrame(list(folders), f"{LOAD} string, step int")
            earlier = earlier.join(F.broadcast(again), [LOAD, "step"], "left_anti").select(*STEPS.fieldNames())
        return earlier.unionByName(later)

    def _read_steps(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(STEPS).parquet(*paths) if paths else self.spark.createDataFrame([], STEPS)

    def record(self, batches: DataFrame, load_id: str, step: int) -> None:
        """Write one ledger step: one row per file of the load.  It counts once it is in the log."""
        stamped = batches.withColumns({
            "event_time": F.current_timestamp(), LOAD: F.lit(load_id), "step": F.lit(step)})
        folder = f"s-{uuid.uuid4().hex}"
        stamped.select(*STEPS.fieldNames()).write.option("maxRecordsPerFile", FILE_ROWS).parquet(
            self.path("ledger", "batches", folder))
        log = self._steps
        number = log.append(json.dumps([folder, load_id, step]))
        upto, base = log.base()
        if number - upto >= self.fold_every:
            tail = log.after(upto).collect()
            whole = _unbroken(upto, [r["number"] for r in tail])
            if whole > upto:
                log.fold(self._events(base, [r for r in tail if r["number"] <= whole]), whole, FILE_ROWS)

    def batches(self) -> DataFrame:
        """Every batch in its current state."""
        return self._latest(self.ledger())

    @staticmethod
    def _latest(events: DataFrame) -> DataFrame:
        """The newest event of each batch.  Whole events are sorted, so tasks get a number of rows
        that does not grow with the ledger; the events of a batch, two per load, meet in one task."""
        tasks = 1 + events.count() // SORTED_ROWS
        events = events.repartition(tasks, "batch_id")
        rest = F.struct(LOAD, *[c for c in BATCHES.fieldNames() if c != "batch_id"])
        newest = events.groupBy("batch_id").agg(
            F.max_by(rest, F.struct("event_time", "step")).alias("_row"),
            F.min("event_time").alias("created_at"))
        return newest.select("batch_id", "_row.*", "created_at")

    def committed_loads(self, name: str | None = None) -> DataFrame:
        """Loads whose last step was recorded, and those that took a version of the table ``name``."""
        done = self.ledger().filter(F.col("status") == messages.IMPORTED).select(LOAD)
        return (done if name is None else done.union(self.versions(name).select(LOAD))).distinct()

    def is_committed(self, load_id: str, name: str | None = None) -> bool:
        return not self.committed_loads(name).filter(F.col(LOAD) == load_id).isEmpty()

    def finish(self, load_id: str, name: str) -> None:
        """Record the last ledger step of a load that took a version, unless it is recorded."""
        steps = self.ledger().filter(F.col(LOAD) == load_id)
        if not steps.filter(F.col("status") == messages.IMPORTED).isEmpty():
            return
        stored = self._stored(name).filter(F.col(LOAD) == load_id).groupBy(F.col("_batch_id").alias("batch_id")).agg(
            F.count(F.lit(1)).alias("_stored"))
        first = steps.filter(F.col("step") == 1).join(stored, "batch_id", "left")
        done = F.when(F.col("status") == messages.VALIDATED, F.lit(messages.IMPORTED)).otherwise(F.col("status"))
        self.record(first.withColumns({"status": done, "inserted_rows": F.coalesce("_stored", F.lit(0))}), load_id, 2)

    def loaded_files(self, flow: str) -> DataFrame:
        """Hashes that count as seen: imported through this flow."""
        done = self.ledger().filter((F.col("status") == messages.IMPORTED) & (F.col("flow") == flow))
        return done.select("file_hash", "batch_id", "event_time")

    def statuses(self) -> DataFrame:
        return current_status(self.ledger(), "batch_id", "status", ["event_time", "step"])

    def write_errors(self, errors: DataFrame, load_id: str) -> None:
        errors.select(*ERRORS.fieldNames()).write.mode("overwrite").parquet(
            self.path("ledger", "errors", f"{LOAD}={load_id}"))

    def errors(self) -> DataFrame:
        self._create(ERRORS, "ledger", "errors", f"{LOAD}={NEVER}")
        return self.spark.read.parquet(self.path("ledger", "errors")).drop(LOAD)

    def write_skipped(self, skipped: DataFrame, load_id: str) -> None:
        skipped.select(*SKIPPED.fieldNames()).write.mode("overwrite").parquet(
            self.path("ledger", "skipped", f"{LOAD}={load_id}"))

    def skipped(self) -> DataFrame:
        self._create(SKIPPED, "ledger", "skipped", f"{LOAD}={NEVER}")
        return self.spark.read.parquet(self.path("ledger", "skipped")).drop(LOAD)

    # -- event log ------------------------------------------------------------------

    def log_events(self, events: DataFrame, write_id: str | None = None) -> None:
        """Append (username, display_name); the time is set here.

        A write that is repeated with its ``write_id`` replaces what it wrote before.
        """
        folder = f"write_id={write_id or uuid.uuid4().hex}"
        events.select("username", "display_name", F.current_timestamp().alias("logged_at")).write.mode(
            "overwrite").parquet(self.path("log", folder))

    def log(self) -> DataFrame:
        self._create(LOG, "log", "write_id=created")
        return self.spark.read.schema(T.StructType([*LOG.fields, T.StructField("write_id", T.StringType())])).parquet(
            self.path("log")).drop("write_id")

    # -- helpers --------------------------------------------------------------------

    def _create(self, schema: T.StructType, *parts: str) -> None:
        empty = self.spark.createDataFrame([], schema)
        empty.coalesce(1).write.mode("ignore").parquet(self.path(*parts))

    def _schema(self, *parts: str) -> T.StructType | None:
        try:
            return self.spark.read.parquet(self.path(*parts)).schema
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
