"""Import jobs: a landing folder becomes committed rows of one table.

One call loads any number of files in a fixed number of Spark jobs.  Each file is its own
batch in the ledger; all rows of the call share one load folder and become visible
together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluicegate import messages
from sluicegate.contracts import Contract, project, with_overrides, with_table_types
from sluicegate.functions.names import header_key, quoted, sanitize_name
from sluicegate.operators import dedup, profile, validate
from sluicegate.plans.hash_index import HashIndex
from sluicegate.plans.outcomes import ACCEPTED, DUP_IN_BATCH, DUP_IN_TARGET, INVALID, OUTCOME
from sluicegate.plans.store import AUDIT, LOAD, Store
from sluicegate.sources import landing, records, workbooks
from sluicegate.sources.fingerprint import fingerprint_files
from sluicegate.sources.landing import FILE, ROW_NUMBER, Landing
from sluicegate.session import work_folder, written

ALREADY_LOADED = "this file was loaded before"
NO_VALID_ROWS = "Импорт не выполнен: нет валидных строк"
IMPORT_KIND = "Тип импорта: {title}"
#: Copies of a row that may meet in one task, and how many times the rows of a load a target may have
#: to be compared with it as a whole.
HOT_COPIES, MUCH_LARGER = 10_000, 4
HASH_BINS = 1 << 16


def new_load_id() -> str:
    return f"l-{uuid.uuid4().hex}"


def plan_files(store: Store, files: Landing, flow: str, separator: str | None = None) -> DataFrame:
    """Decide per file: ``problem`` NULL means it will be read.

    A file is left out when it was imported through this flow before, or has the same content
    as another file of this load.  The plan is written: the files are hashed once.
    """
    prints = fingerprint_files(files, separator)
    known = dedup.mark_in_target(prints, store.loaded_files(flow), ["file_hash"], "_seen")
    ranked = dedup.flag_copies(known, ["file_hash"], ["path"])
    problem = F.when(F.col("_seen") | ~F.col(dedup.IS_FIRST), F.lit(ALREADY_LOADED))
    return written(ranked.select(
        FILE, "path", "file_name", "file_hash", "width", problem.alias("problem"),
        F.concat(F.lit(f"{flow}-"), F.substring("file_hash", 1, 16)).alias("batch_id")), "plan")


def read_landing(store: Store, files: Landing, plan: DataFrame, fmt: str, contract: Contract | None,
                 **options) -> tuple[DataFrame, DataFrame]:
    """Text rows with file and row number, staged once, and the files that failed.

    The folder is read as a whole; files that the plan leaves out are taken away by a join.
    Workbooks and CSV files are matched by the header of each file.
    """
    spark = store.spark
    folder = work_folder(spark, "landing")
    without = plan.filter(F.col("problem").isNotNull())
    if fmt == "xlsx":
        scanned = workbooks.scan_workbooks(files, contract is not None, without, **options)
        scanned.write.mode("overwrite").parquet(folder)
        rows = spark.read.parquet(folder)
        problems = workbooks.sheet_problems(rows)
        if contract is not None:
            problems = problems.unionByName(workbooks.missing_headers(rows, contract.required_headers))
            headers = list(dict.fromkeys(header_key(f.header) for f in contract.fields))
        else:
            headers = workbooks.sheet_headers(rows)
        return workbooks.sheet_table(workbooks.readable(rows, problems), headers), problems
    if fmt == "csv":
        read = plan.filter(F.col("problem").isNull())
        width, left_out = plan.agg(F.max(F.when(F.col("problem").isNull(), F.col("width"))), F.count("problem")).first()
        return records.read_records(
            records.stage_records(files, width, folder, without if left_out else None, **options), read.select(FILE), contract)
    staged = landing.stage(landing.scan(files, fmt, **options), folder, without)
    none = spark.createDataFrame([], f"{FILE} string, problem string")
    return landing.number_rows(staged), none


def classify(rows: DataFrame, contract: Contract, target: DataFrame, rules: Sequence[Column] = (),
             index: HashIndex | None = None) -> DataFrame:
    """Typed rows with ``errors`` and ``outcome``, as if files were loaded one by one.

    A copy of a row of the same file is dup_in_batch.  A copy of a row of an earlier file
    or of the target is dup_in_target.  Keys are all data and constant columns.  A target that is much
    larger than the load is cut to the rows whose hash the load has, through the ``index`` if there
    is one: only files that hold one of these hashes are read.
    """
    keys = contract.column_names
    whole = {*keys} == {*target.columns} - {LOAD, *AUDIT.fieldNames()}
    if not whole:
        target = target.drop(dedup.ROW_HASH)  # stored hashes are of all columns, these are some of them
    validated = validate.validate(project(rows, contract, keep=[FILE, ROW_NUMBER]), rules)
    checked = validated.withColumn("_valid", validate.is_valid())
    bins = _hash_bins(checked, keys)
    size = target.count()
    if size and size > MUCH_LARGER * (bins.agg(F.sum("n")).first()[0] or 0):
        checked = written(checked, "checked")
        probes = checked.filter("_valid").select(dedup.row_hash(checked, keys).alias(dedup.ROW_HASH))
        stored = dedup.matching_keys(index.rows(probes) if whole and index is not None else target, keys, probes)
    else:
        stored = target.select(*[F.col(quoted(k)) for k in keys])
    hot = _hot_hashes(checked, keys, bins)
    if hot is None:
        return _judge(checked, stored, keys).drop("_valid")

    def parted(df: DataFrame, how: str) -> DataFrame:
        hashed = df.withColumn(dedup.ROW_HASH, dedup.row_hash(df, keys))
        return hashed.join(F.broadcast(hot), dedup.ROW_HASH, how).select(*[F.col(quoted(c)) for c in df.columns])

    seldom = _judge(parted(checked, "left_anti"), stored, keys)
    return seldom.unionByName(_judge_hot(parted(checked, "left_semi"), parted(stored, "left_semi"), keys)).drop("_valid")


def _binned(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes of the valid rows and their bins."""
    hashes = checked.filter("_valid").select(dedup.row_hash(checked, keys).alias(dedup.ROW_HASH))
    return hashes.withColumn("_bin", F.pmod(F.col(dedup.ROW_HASH), F.lit(HASH_BINS)))


def _hash_bins(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_bin, n: how many valid rows have a hash of this bin."""
    return written(_binned(checked, keys).groupBy("_bin").agg(F.count(F.lit(1)).alias("n")), "bins")


def _hot_hashes(checked: DataFrame, keys: Sequence[str], bins: DataFrame) -> DataFrame | None:
    """Hashes that occur more than ``HOT_COPIES`` times, one in so many rows at most; None if there are none.

    The hashes themselves are counted in full bins only.
    """
    full = bins.filter(F.col("n") > HOT_COPIES).select("_bin")
    if full.isEmpty():
        return None
    counted = _binned(checked, keys).join(F.broadcast(full), "_bin", "left_semi").groupBy(dedup.ROW_HASH).agg(
        F.count(F.lit(1)).alias("n"))
    hot = written(counted.filter(F.col("n") > HOT_COPIES).select(dedup.ROW_HASH), "hot")
    return None if hot.isEmpty() else hot


def _outcome(head: Column, new: Column) -> Column:
    """``head``: first of its file; ``new``: first of the load and not in the target."""
    return (
        F.when(~F.col("_valid"), F.lit(INVALID))
        .when(~head, F.lit(DUP_IN_BATCH))
        .when(~new, F.lit(DUP_IN_TARGET))
        .otherwise(F.lit(ACCEPTED))
    )


def _judge(checked: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes by one shuffle and one sort: equal rows meet, those of the target first.

    A row is the first of its file if the row before it is of another file, and new if no row is
    before it.  Invalid rows need no answer and are spread by their partition.
    """
    here, place = checked.withColumn("_stored", F.lit(False)), F.lit(-1)
    here = here.withColumn("_place", F.when(F.col("_valid"), place).otherwise(F.spark_partition_id()))
    there = stored.withColumns({"_stored": F.lit(True), "_valid": F.lit(True), "_place": place})
    met = here.unionByName(there, allowMissingColumns=True)
    equal = Window.partitionBy(*[F.col(quoted(k)) for k in keys], "_place").orderBy(F.col("_stored").desc(), FILE, ROW_NUMBER)
    ranked = met.withColumns({"_follows": F.lag("_stored").over(equal), "_before": F.lag(FILE).over(equal)})
    new = F.col("_follows").isNull()
    head = new | ~F.col("_before").eqNullSafe(F.col(FILE))
    return ranked.filter(~F.col("_stored")).withColumn(OUTCOME, _outcome(head, new)).select(
        *[F.col(quoted(c)) for c in checked.columns], OUTCOME)


def _judge_hot(checked: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for keys with many copies, which must not meet in one task."""
    in_file = dedup.flag_copies(checked, [FILE, "_valid", *keys], [ROW_NUMBER])
    head = F.col("_valid") & F.col(dedup.IS_FIRST)
    # A key has one head per file at most, so heads may meet; the other rows are spread.
    meeting = in_file.withColumn("_head", head).withColumn(
        "_place", F.when(F.col("_head"), F.lit(-1)).otherwise(F.spark_partition_id()))
    across = Window.partitionBy(*[F.col(quoted(k)) for k in keys], "_place").orderBy(FILE, ROW_NUMBER)
    led = meeting.withColumn("_leader", F.col("_head") & (F.row_number().over(across) == 1))
    probed = dedup.mark_in_target(led, stored, keys, "_known", when=F.col("_leader"))
    return probed.withColumn(OUTCOME, _outcome(F.col("_head"), F.col("_leader") & ~F.col("_known"))).select(
        *[F.col(quoted(c)) for c in checked.columns], OUTCOME)


def summarize(classified: DataFrame, contract: Contract) -> DataFrame:
    """Counts per file.  In a contract load, copies inside a file are errors; in a free
    load they are skipped rows."""
    def count(*outcomes: str) -> Column:
        return F.count_if(F.col(OUTCOME).isin(*outcomes))

    copies_are_errors = contract.flow == "contract"
    faulty = (INVALID, DUP_IN_BATCH) if copies_are_errors else (INVALID,)
    skipped = (DUP_IN_TARGET,) if copies_are_errors else (DUP_IN_BATCH, DUP_IN_TARGET)
    return classified.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("total_rows"),
        count(*faulty).alias("error_rows"),
        count(*skipped).alias("skipped_rows"),
    )


def _ledger_rows(plan: DataFrame, problems: DataFrame, counts: DataFrame, contract: Contract,
                 by: str, by_name: str | None, done: str) -> DataFrame:
    """One ledger row per file of the load; ``done`` is the status of those not rejected.  Rows
    count as inserted when the load is committed (``Store.finish``)."""
    failed = problems.groupBy(FILE).agg(F.min("problem").alias("_failed"))
    joined = plan.join(failed, FILE, "left").join(counts, FILE, "left")
    reason = F.coalesce("problem", "_failed")
    zero = ["total_rows", "error_rows", "skipped_rows"]
    numbers = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in zero}
    valid = numbers["total_rows"] - numbers["error_rows"]
    rejected = reason.isNotNull() | (valid == 0)
    return joined.select(
        F.coalesce("batch_id", F.concat(F.lit(f"{contract.flow}-"), F.substring(F.sha2(FILE, 256), 1, 16))).alias("batch_id"),
        F.lit(contract.flow).alias("flow"), "file_hash", "file_name",
        F.lit(contract.table).alias("table_name"), F.lit(by).alias("uploaded_by"),
        F.lit(by_name).cast("string").alias("uploaded_by_name"),
        numbers["total_rows"].alias("total_rows"), valid.alias("valid_rows"),
        numbers["error_rows"].alias("error_rows"), F.lit(0).cast("long").alias("inserted_rows"),
        numbers["skipped_rows"].alias("skipped_rows"),
        F.when(rejected, F.lit(messages.REJECTED)).otherwise(F.lit(done)).alias("status"),
        F.coalesce(reason, F.when(valid == 0, F.lit(NO_VALID_ROWS)).otherwise(
            F.lit(IMPORT_KIND.format(title=contract.title)))).alias("notes"),
    ).filter(F.coalesce(F.col("notes") != ALREADY_LOADED, F.lit(True)))


def publish(store: Store, classified: DataFrame, contract: Contract, plan: DataFrame, problems: DataFrame,
            load_id: str, by: str, by_name: str | None = None, version: int | None = None) -> DataFrame:
    """Write rows, errors, skips and the ledger of one load; returns its ledger rows.

    ``version`` is the table's when the rows were compared with it.  The load is committed by
    taking the next version.  If other loads took it meanwhile, the accepted rows are compared with
    the rows of those loads only, and the load is written again for the version after them.
    """
    batch_of = plan.filter(F.col("problem").isNull()).select(FILE, "batch_id")
    rows = written(classified.join(batch_of, FILE), "classified")
    version = store.version(contract.table) if version is None else version
    while True:
        _write_load(store, rows, contract, plan, problems, load_id, by, by_name)
        if store.commit(contract.table, version + 1, load_id):
            break
        newer, version = store.rows_since(contract.table, version)
        rows = written(_recheck(rows, newer, contract), "rechecked")
    store.finish(load_id, contract.table)
    return load_batches(store, load_id)


def _recheck(rows: DataFrame, newer: DataFrame, contract: Contract) -> DataFrame:
    """Accepted rows that loads committed meanwhile hold as well become dup_in_target."""
    accepted = F.col(OUTCOME) == ACCEPTED
    known = dedup.mark_in_target(rows, newer, contract.column_names, "_taken", when=accepted)
    return known.withColumn(OUTCOME, F.when(F.col("_taken"), F.lit(DUP_IN_TARGET)).otherwise(F.col(OUTCOME))).drop("_taken")


def _write_load(store: Store, rows: DataFrame, contract: Contract, plan: DataFrame, problems: DataFrame,
                load_id: str, by: str, by_name: str | None) -> None:
    """Rows, errors, skips and the first ledger step; none of it is visible in the table yet."""
    counts = written(summarize(rows, contract), "counts")
    ledger = _ledger_rows(plan, problems, counts, contract, by, by_name, messages.VALIDATED)
    store.record(ledger, load_id, 1)

    reason = [(f.header, F.col(quoted(f.name))) for f in contract.fields]
    in_file, in_store = F.col(OUTCOME) == DUP_IN_BATCH, F.col(OUTCOME) == DUP_IN_TARGET
    faulty = rows
    if contract.flow == "contract":  # a copy in the file is one more error of its row
        faulty = rows.withColumn(validate.ERRORS, F.concat(validate.ERRORS, validate.error_if(
            in_file, messages.DUPLICATE_FIELD, messages.DUPLICATE_IN_FILE)))
    store.write_errors(validate.error_table(faulty, "batch_id", ROW_NUMBER), load_id)
    store.write_skipped(dedup.skipped_rows(rows, in_file, in_store, reason, "batch_id", ROW_NUMBER), load_id)

    accepted = rows.filter(F.col(OUTCOME) == ACCEPTED).select(
        *[F.col(quoted(c)) for c in contract.column_names],
        F.col("batch_id").alias("_batch_id"), F.col(ROW_NUMBER).alias("_row_number"),
        F.current_timestamp().alias("_imported_at"), F.lit(by).alias("_imported_by"),
        dedup.row_hash(rows, contract.column_names).alias(dedup.ROW_HASH))
    try:
        store.write_rows(accepted, contract.table, load_id)
        HashIndex(store, contract.table).add(load_id)
    except Exception as error:
        failed = ledger.withColumn("status", F.lit(messages.FAILED)).withColumn(
            "notes", F.lit(str(error)))
        store.record(failed, load_id, 2)
        raise


def load_batches(store: Store, load_id: str) -> DataFrame:
    return store.batches().filter(F.col(LOAD) == load_id)


def import_files(store: Store, files: Landing, contract: Contract, by: str, fmt: str = "csv",
                 by_name: str | None = None, load_id: str | None = None,
                 rules: Sequence[Column] = (), **options) -> DataFrame:
    """Contract import of the files of a landing folder; returns the ledger rows of the load.

    Give the same ``load_id`` to repeat a load that may have failed: a committed load is
    left as it is, an unfinished one is written again from the start.
    """
    load_id = load_id or new_load_id()
    if store.is_committed(load_id, contract.table):
        store.finish(load_id, contract.table)
        return load_batches(store, load_id)
    plan = plan_files(store, files, contract.flow, _separator(fmt, options))
    if _nothing_new(plan):
        none = store.spark.createDataFrame([], f"{FILE} string, problem string")
        counts = store.spark.createDataFrame(
            [], f"{FILE} string, total_rows long, error_rows long, skipped_rows long")
        store.record(_ledger_rows(plan, none, counts, contract, by, by_name, messages.REJECTED), load_id, 1)
        return load_batches(store, load_id)
    rows, problems = read_landing(store, files, plan, fmt, contract, **options)
    store.ensure(contract.table, contract.schema())
    filled = landing.drop_blank_rows(rows)
    version = store.version(contract.table)
    classified = classify(filled, contract, store.table(contract.table), rules, HashIndex(store, contract.table))
    return publish(store, classified, contract, plan, problems, load_id, by, by_name, version)


def _separator(fmt: str, options: Mapping) -> str | None:
    return str(options.get("sep", options.get("delimiter", ","))) if fmt == "csv" else None


def _nothing_new(plan: DataFrame) -> bool:
    return plan.filter(F.col("problem").isNull()).isEmpty()


def import_free(store: Store, files: Landing, table: str, by: str, fmt: str = "csv",
                overrides: Mapping[str, Mapping[str, str]] | None = None,
                load_id: str | None = None, by_name: str | None = None,
                on_contract: Callable[[Contract], None] | None = None, **options) -> DataFrame:
    """Import without a contract: the types come from the data, the user may override them.

    A table that exists may have more columns: those that the files lack become NULL, rows are
    compared on the columns of the files, and a column has its type in the table unless overridden.
    """
    load_id, name = load_id or new_load_id(), sanitize_name(table)
    if store.is_committed(load_id, name):
        store.finish(load_id, name)
        return load_batches(store, load_id)
    plan = plan_files(store, files, "free", _separator(fmt, options))
    if _nothing_new(plan):
        raise landing.EmptyInput("no new files to load")
    rows, problems = read_landing(store, files, plan, fmt, None, **options)
    landing.require_rows(rows, "the files have no rows")
    contract = with_table_types(profile.inferred_contract(rows, table), store.recorded(name))
    contract = with_overrides(contract, overrides or {}, [*profile.FREE_TYPES, "BIGINT"])
    if on_contract is not None:
        on_contract(contract)
    store.ensure(contract.table, contract.schema())
    headers = [f.header for f in contract.fields]
    filled = landing.drop_blank_rows(rows, headers)
    version = store.version(contract.table)
    classified = classify(filled, contract, store.table(contract.table), index=HashIndex(store, contract.table))
    return publish(store, classified, contract, plan, problems, load_id, by, by_name, version)
