"""Duplicate queries: inside a batch, against a target, files seen before, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate import messages
from sluicegate.functions import casts
from sluicegate.operators import dedup, reports
from sluicegate.plans.outcomes import OUTCOME, assign_outcomes
from sluicegate.queries.base import query, table

KEY = ["l_orderkey", "l_linenumber"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_shipdate"]
ORDER = [c for c in LINE if c not in KEY]
_PLACE = f"row_number() OVER (PARTITION BY {', '.join(KEY)} ORDER BY {', '.join(ORDER)})"
_COPIES = f"count(*) OVER (PARTITION BY {', '.join(KEY)})"
# Lines loaded earlier: those shipped before 1996.
LOADED = "l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE)


def _loaded(rows):
    return rows.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))


@query(f"SELECT {', '.join(LINE)}, {_PLACE} = 1 AS is_first FROM lineitem")
def dups_first_wins(spark, folder):
    return dedup.flag_copies(lines(spark, folder), KEY, ORDER).drop(dedup.LATER_COPIES)


@query(f"SELECT {', '.join(LINE)} FROM (SELECT *, {_PLACE} AS place FROM lineitem) WHERE place = 1")
def dups_kept_rows(spark, folder):
    return dedup.first_copies(lines(spark, folder), KEY, ORDER)


@query(f"""
    SELECT {', '.join(LINE)}, CASE WHEN place = 1 THEN copies - 1 ELSE 1 END AS duplicate_errors
    FROM (SELECT *, {_PLACE} AS place, {_COPIES} AS copies FROM lineitem) WHERE copies > 1""")
def dups_all_copies(spark, folder):
    rejected = dedup.reject_copies(lines(spark, folder), KEY, ORDER)
    return rejected.select(*LINE, F.col("occurrences").alias("duplicate_errors"))


_MATCH = ["l_orderkey", "l_linenumber", "flag"]


def _with_gaps(rows):
    """Lines with a NULL in the compared columns."""
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
                       F.nullif("l_returnflag", F.lit("R")).alias("flag"))


@query(f"""
    WITH gaps AS (SELECT *, nullif(l_returnflag, 'R') AS flag FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, flag FROM gaps AS a
    WHERE NOT EXISTS (
        SELECT 1 FROM gaps AS b WHERE b.{LOADED} AND a.l_orderkey = b.l_orderkey
          AND a.l_linenumber = b.l_linenumber AND a.flag IS NOT DISTINCT FROM b.flag)""")
def target_anti_join(spark, folder):
    """Lines without an equal row among those loaded earlier, NULL = NULL."""
    rows = _with_gaps(lines(spark, folder))
    return dedup.not_in_target(rows, _loaded(rows), _MATCH)


@query(f"""
    WITH found AS (
        SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 1 AND 45
        INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE {LOADED})
    SELECT {', '.join('a.' + c for c in LINE)}, b.l_orderkey IS NOT NULL AS key_exists
    FROM lineitem AS a LEFT JOIN found AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def existing_key_check(spark, folder):
    rows = lines(spark, folder)
    return dedup.mark_existing_keys(rows, F.col("l_quantity").between(1, 45), _loaded(rows), KEY)


def _documents_as_files(spark, folder):
    docs = table(spark, folder, "documents")
    files = docs.select("doc_id", "source", F.sha2("text", 256).alias("file_hash"))
    # The ledger: files of one language, each batch created at its document number.
    ledger = docs.filter("lang = 'en'").select(
        F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("batch_id"), F.col("n_chars").alias("created"))
    return files, ledger


_FILES = """
    WITH files AS (SELECT doc_id, source, sha256(text) AS file_hash FROM documents),
         ledger AS (SELECT sha256(text) AS file_hash, doc_id AS batch_id, n_chars AS created
                    FROM documents WHERE lang = 'en')"""


@query(f"{_FILES} SELECT * FROM files WHERE file_hash NOT IN (SELECT file_hash FROM ledger)")
def file_seen_filter(spark, folder):
    files, ledger = _documents_as_files(spark, folder)
    return dedup.new_files(files, ledger)


@query(f"""{_FILES}
    SELECT doc_id, source, file_hash, batch_id, created FROM files JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created DESC, batch_id DESC) AS place
                       FROM ledger) WHERE place = 1) USING (file_hash)""")
def file_seen_newest(spark, folder):
    files, ledger = _documents_as_files(spark, folder)
    return dedup.seen_files(files, ledger, "batch_id", "created")


@query(f"""
    WITH placed AS (SELECT *, {_PLACE} AS place FROM lineitem),
         loaded AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE {LOADED})
    SELECT a.l_orderkey, a.l_linenumber, a.l_partkey,
           CASE WHEN place > 1 THEN '{messages.DUPLICATE_IN_FILE}' ELSE '{messages.ROW_EXISTS}' END AS reason,
           concat('Part: ', l_partkey, ' | Flag: ', coalesce(nullif(l_returnflag, 'R'), '—'), ' | Supplier: ', l_suppkey) AS preview
    FROM placed AS a LEFT JOIN loaded AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
    WHERE place > 1 OR b.l_orderkey IS NOT NULL""")
def skipped_report(spark, folder):
    rows = lines(spark, folder)
    flagged = dedup.flag_copies(rows, KEY, ORDER)
    probed = dedup.mark_in_target(flagged, _loaded(rows), KEY, "known", when=F.col(dedup.IS_FIRST))
    labelled = [("Part", F.col("l_partkey")), ("Flag", F.nullif("l_returnflag", F.lit("R"))),
                ("Supplier", F.col("l_suppkey")), ("Price", F.col("l_extendedprice"))]
    return dedup.skipped_rows(probed, ~F.col(dedup.IS_FIRST), F.col("known"), labelled,
                              "l_orderkey", "l_linenumber", "l_partkey")


# The import of order lines: text cells, cast under a contract, checked, compared.
_CAST = {
    "order_key": (casts.free_long, "l_orderkey"),
    "line_number": (casts.free_long, "l_linenumber"),
    "part": (casts.free_long, "l_partkey"),
    "supplier": (casts.free_long, "l_suppkey"),
    "quantity": (casts.contract_float, "l_quantity"),
    "price": (casts.contract_decimal, "l_extendedprice"),
    "flag": (casts.Cast(lambda c: F.nullif(c, F.lit("R"))), "l_returnflag"),
    "ship_date": (casts.contract_date, "l_shipdate"),
}
IMPORT_KEY = ["order_key", "line_number"]
IMPORT_ORDER = ["part", "supplier", "quantity", "price", "flag", "ship_date"]


def import_rows(spark, folder):
    cells = {name: (cast, F.col(source).cast("string")) for name, (cast, source) in _CAST.items()}
    return casts.apply_casts(table(spark, folder, "lineitem"), cells)


def import_valid():
    filled = [F.col(c).isNotNull() for c in ("order_key", "line_number", "ship_date", "quantity")]
    return filled[0] & filled[1] & filled[2] & filled[3] & F.col("quantity").between(1, 45)


def previous_load(spark, folder):
    """Rows of an earlier load, stored typed: the first fifteenth of the order keys."""
    bound = table(spark, folder, "orders").agg(F.ceil(F.count(F.lit(1)) / 15)).scalar()
    stored = table(spark, folder, "lineitem").filter(F.col("l_orderkey") < bound)
    return stored.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"), F.col("l_shipdate").cast("date").alias("ship_date"))


@query("""
    WITH cast_rows AS (
        SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part, l_suppkey AS supplier,
               l_quantity AS quantity, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(10,2)) AS price,
               nullif(l_returnflag, 'R') AS flag, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem),
    checked AS (SELECT *, quantity BETWEEN 1 AND 45 AND order_key IS NOT NULL AND line_number IS NOT NULL
                          AND ship_date IS NOT NULL AS valid FROM cast_rows),
    placed AS (SELECT *, row_number() OVER (PARTITION BY valid, order_key, line_number
                   ORDER BY part, supplier, quantity, price, flag NULLS FIRST, ship_date) AS place FROM checked),
    loaded AS (SELECT DISTINCT * FROM cast_rows WHERE order_key < (SELECT count(*) / 15 FROM orders))
    SELECT CASE WHEN NOT valid THEN 'invalid' WHEN place > 1 THEN 'dup_in_batch'
                WHEN EXISTS (SELECT 1 FROM loaded AS b WHERE a.order_key = b.order_key
                    AND a.line_number = b.line_number AND a.part = b.part AND a.supplier = b.supplier
                    AND a.quantity = b.quantity AND a.price = b.price
                    AND a.flag IS NOT DISTINCT FROM b.flag AND a.ship_date = b.ship_date)
                THEN 'dup_in_target' ELSE 'accepted' END AS outcome, count(*) AS row_count
    FROM placed AS a GROUP BY outcome""")
def import_outcomes(spark, folder):
    """One outcome per incoming line, counted."""
    rows = import_rows(spark, folder)
    labelled = assign_outcomes(
        rows, import_valid(), IMPORT_KEY, IMPORT_ORDER, previous_load(spark, folder), list(_CAST))
    return reports.count_by(labelled, OUTCOME)
