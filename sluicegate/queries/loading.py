"""Whole loads: files made from order lines, imported under a contract into a ledgered store."""

from __future__ import annotations

import io
import zipfile
from concurrent.futures import ThreadPoolExecutor
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from sluicegate import messages
from sluicegate.contracts import Contract, Field, project
from sluicegate.operators import dedup, validate
from sluicegate.plans.hash_index import HashIndex
from sluicegate.plans.imports import import_files, import_free
from sluicegate.plans.store import LOAD, Store
from sluicegate.queries.base import query, table
from sluicegate.session import work_folder, written
from sluicegate.sources import landing, workbooks
from sluicegate.sources.landing import FILE, ROW_NUMBER, list_files
from sluicegate.streaming.landing_stream import start_landing

ORDER_LINES = Contract("order_lines", "Order lines", "order_lines", (
    Field("Order", "order_key", "NVARCHAR(20)", required=True),
    Field("Line", "line_number", "INT", required=True),
    Field("Flag", "flag", "NVARCHAR(1)"),
))
LAST_LINE = 6


@query(f"""
    WITH lines AS (
        SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, nullif(l_returnflag, 'R') AS f, l_shipdate AS d FROM lineitem),
    loads AS (
        SELECT 'l-1' AS load_id, k, n, f FROM lines WHERE d < TIMESTAMP '1996-01-01'
        UNION ALL SELECT 'l-2', k, n, f FROM lines WHERE d >= TIMESTAMP '1995-01-01'),
    heads AS (SELECT DISTINCT load_id, k, n, f FROM loads WHERE n <= {LAST_LINE}),
    judged AS (
        SELECT load_id, load_id = 'l-2' AND EXISTS (
            SELECT 1 FROM heads AS o WHERE o.load_id = 'l-1' AND o.k = h.k AND o.n = h.n AND o.f IS NOT DISTINCT FROM h.f) AS known
        FROM heads AS h),
    totals AS (SELECT load_id, count(*) AS total_rows FROM loads GROUP BY load_id),
    tallies AS (
        SELECT load_id, count(*) AS valid_rows, count(*) FILTER (NOT known) AS inserted_rows,
               count(*) FILTER (known) AS skipped_rows FROM judged GROUP BY load_id)
    SELECT load_id, 'order_lines' AS table_name, 'importer' AS uploaded_by, '{messages.IMPORTED}' AS status, TRUE AS hashed,
           total_rows, valid_rows, total_rows - valid_rows AS error_rows, inserted_rows, skipped_rows,
           inserted_rows AS stored_rows
    FROM totals JOIN tallies USING (load_id)""")
def import_pipeline(spark, folder):
    """Two loads that overlap, and the first one again: ledger and tallies of each load.

    Lines of a third load, whose files were all loaded before, are neither stored nor in the
    ledger.  Equal lines share a file, so copies inside a load are copies inside a file.
    """
    work = work_folder(spark, "import-pipeline")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order"), F.col("l_linenumber").alias("Line"),
        F.nullif("l_returnflag", F.lit("R")).alias("Flag"), "l_shipdate")

    def put(name: str, rows) -> None:
        rows.drop("l_shipdate").repartition("Order").write.option("header", True).csv(f"{work}/{name}")

    put("early", lines.filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'"))
    put("late", lines.filter("l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'"))
    store = Store(spark, f"{work}/store")
    rules = [validate.error_if(F.col("line_number") > LAST_LINE, "line_number", "no such line")]
    for load_id, part in (("l-1", "early"), ("l-2", "late"), ("l-3", "early")):
        import_files(store, list_files(spark, f"{work}/{part}", "*.csv"), ORDER_LINES, "importer",
                     load_id=load_id, rules=rules)
    stored = store.table(ORDER_LINES.table).groupBy(LOAD).agg(F.count(F.lit(1)).alias("stored_rows"))
    tallies = [F.sum(c).alias(c) for c in ("total_rows", "valid_rows", "error_rows", "inserted_rows", "skipped_rows")]
    loads = store.batches().groupBy(LOAD, "table_name", "uploaded_by").agg(
        F.min("status").alias("status"), F.every(F.length("file_hash") == 64).alias("hashed"), *tallies)
    return loads.join(stored, LOAD)


@query(f"""
    WITH lines AS (
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, l_returnflag AS f, l_orderkey % 4 AS part FROM lineitem)
    SELECT 'row' AS kind, k AS order_key, CAST(n AS INTEGER) AS line_number, CASE part WHEN 2 THEN NULL ELSE f END AS flag, 1 AS n
    FROM lines WHERE part IN (0, 1)
    UNION ALL SELECT DISTINCT 'row', k, CAST(n AS INTEGER), NULL, 1 FROM lines WHERE part = 2
    UNION ALL SELECT '{messages.IMPORTED}', NULL, NULL, NULL, 3
    UNION ALL SELECT '{messages.REJECTED}', NULL, NULL, 'missing required columns: order', 1""")
def mixed_header_import(spark, folder):
    """Four files of one load, each with its own header: two orders of columns, one without an
    optional column and with one more, and one that lacks a required column and is rejected."""
    work = work_folder(spark, "mixed-headers")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order"), F.col("l_linenumber").alias("Line"), F.col("l_returnflag").alias("Flag"))
    headers = (["Order", "Line", "Flag"], ["Flag", "Order", "Line"], ["LINE ", "Remark", " order"], ["Line", "Flag"])

    def put(part: int) -> None:
        header = headers[part]
        cells = [F.col("Flag").alias(h) if h == "Remark" else F.col(h.strip()).alias(h) for h in header]
        lines.filter(F.col("Order") % 4 == part).select(*cells).coalesce(1).write.option("header", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{work}/inbox/{part}")

    # Each file is written by one task: all of them at the same time.
    with ThreadPoolExecutor(len(headers)) as pool:
        list(pool.map(put, range(len(headers))))
    store = Store(spark, f"{work}/store")
    ledger = import_files(store, list_files(spark, f"{work}/inbox/*", "*.csv"), ORDER_LINES, "importer")
    files = ledger.groupBy(F.col("status").alias("kind"), F.when(F.col("status") == messages.REJECTED, F.col("notes")).alias("flag")).agg(
        F.count(F.lit(1)).cast("int").alias("n"))
    rows = store.table(ORDER_LINES.table).select(
        F.lit("row").alias("kind"), "order_key", "line_number", "flag", F.lit(1).alias("n"))
    return rows.unionByName(files.select("kind", F.lit(None).cast("string").alias("order_key"), F.lit(None).cast("int").alias(
        "line_number"), "flag", "n"))


@query("""
    WITH first AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f FROM lineitem WHERE l_orderkey % 3 = 0),
    second AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 < 2 AND l_linenumber < 7),
    fresh AS (SELECT * FROM second ANTI JOIN first USING (k, n)),
    third AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f FROM lineitem WHERE l_orderkey % 3 > 0)
    SELECT 'l-1' AS load_id, k AS "Order", n AS "Line", f AS "Flag" FROM first
    UNION ALL SELECT 'l-2', k, n, NULL FROM fresh
    UNION ALL SELECT 'l-3', k, n, f FROM third""")
def subset_append(spark, folder):
    """Three free loads into one table; the second has a column less, so it is compared on two."""
    work = work_folder(spark, "subset-append")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order"), F.col("l_linenumber").alias("Line"), F.col("l_returnflag").alias("Flag"))
    parts = (lines.filter("`Order` % 3 = 0"), lines.filter("`Order` % 3 < 2 AND Line < 7").select("Line", "Order"),
             lines.filter("`Order` % 3 > 0"))
    store = Store(spark, f"{work}/store")
    for i, part in enumerate(parts, 1):
        part.coalesce(1).write.option("header", True).csv(f"{work}/{i}")
        import_free(store, list_files(spark, f"{work}/{i}", "*.csv"), "lines", "importer", load_id=f"l-{i}")
    return store.table("lines").select(LOAD, *[F.col(c).cast("long").alias(c) for c in ("Order", "Line")], "Flag")


@query("""
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_linenumber AS INTEGER) AS line_number, l_returnflag AS flag
    FROM lineitem""")
def ledger_landing(spark, folder):
    """The landing stream with its ledger: files that are there, then the same content under other
    names and all lines once more in other files; every line is stored once."""
    work = work_folder(spark, "ledger-landing")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order"), F.col("l_linenumber").alias("Line"), F.col("l_returnflag").alias("Flag"))
    store = Store(spark, f"{work}/store")
    spread = lines.repartition(4, "Order").sortWithinPartitions("Order", "Line", "Flag")
    for mode, rows in (("overwrite", spread), ("append", spread), ("append", lines.coalesce(1))):
        rows.write.mode(mode).option("header", True).csv(f"{work}/inbox")
        start_landing(store, f"{work}/inbox", ORDER_LINES, "importer", f"{work}/state", "inbox").awaitTermination()
    return store.table(ORDER_LINES.table).select("order_key", "line_number", "flag")


@query(f"""
    WITH loads AS (
        SELECT concat('o-', o_orderkey) AS batch_id, o_orderkey % 5 AS part, o_orderstatus AS s FROM orders)
    SELECT batch_id, concat('l-', part) AS load_id,
           CASE WHEN part = 0 THEN '{messages.FAILED}' WHEN part = 4 THEN '{messages.VALIDATED}'
                WHEN s = 'F' THEN '{messages.REJECTED}' ELSE '{messages.IMPORTED}' END AS status,
           part IN (1, 2, 3) AS committed
    FROM loads""")
def folded_ledger(spark, folder):
    """Orders as batches of five loads: state of each, read from a ledger that was folded twice.

    Each load but one has two steps; the second step of the first load is written again after the
    fold that holds it.
    """
    store = Store(spark, work_folder(spark, "folded-ledger"), fold_every=4)
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("batch_id"),
        F.pmod(F.col("o_orderkey").cast("long"), F.lit(5)).alias("part"), F.col("o_orderstatus").alias("s"))
    fixed = {"flow": "contract", "file_hash": "none", "file_name": "orders", "table_name": "orders",
             "uploaded_by": "importer", "uploaded_by_name": None, "notes": None}
    filled = orders.withColumns({c: F.lit(v).cast("string") for c, v in fixed.items()}).withColumns(
        {c: F.lit(0).cast("long") for c in ("total_rows", "valid_rows", "error_rows", "inserted_rows", "skipped_rows")})

    def record(part: int, step: int, status) -> None:
        store.record(filled.filter(F.col("part") == part).withColumn("status", status), f"l-{part}", step)

    judged = F.when(F.col("s") == "F", F.lit(messages.REJECTED)).otherwise(F.lit(messages.IMPORTED))
    for part in range(5):
        record(part, 1, F.lit(messages.VALIDATED))
        if part < 4:
            record(part, 2, judged)
    record(0, 2, F.lit(messages.FAILED))
    committed = store.committed_loads().withColumn("committed", F.lit(True))
    return store.batches().select("batch_id", LOAD, "status").join(F.broadcast(committed), LOAD, "left").withColumn(
        "committed", F.coalesce("committed", F.lit(False)))


CUSTOMERS = Contract("customers", "Customers", "customers", (
    Field("Customer", "customer", "INT", required=True),
    Field("Name", "name", "NVARCHAR(255)", required=True),
    Field("Balance", "balance", "DECIMAL(10,2)"),
    Field("Segment", "segment", "NVARCHAR(50)"),
    Field("Comment", "comment", "NVARCHAR(50)"),
))
BOOK_ROWS = 500
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def _workbook(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A workbook of the rows of one block, in key order: header in row 1, a blank row after it."""
    def line(number: int, cells: list) -> str:
        inner = "".join(f'<c r="{chr(65 + i)}{number}" t="inlineStr"><is><t>{escape(str(c))}</t></is></c>'
                        for i, c in enumerate(cells) if c is not None)
        return f'<row r="{number}">{inner}</row>'

    lines = [line(1, [" customer", "Unknown", "NAME", "balance ", "Segment"])]
    for number, r in enumerate(rows.sort_values("c_custkey").itertuples(index=False), start=3):
        lines.append(line(number, [r.c_custkey, "x", r.c_name, r.balance, r.segment]))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>'
                                         '<sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}">'
                                                    '<Relationship Id="r1" Type="t" Target="worksheets/s.xml"/></Relationships>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return pd.DataFrame({FILE: [f"block-{key[0]}.xlsx"], "content": [content.getvalue()]})


@query(f"""
    SELECT concat('block-', c_custkey // {BOOK_ROWS}, '.xlsx') AS file,
           row_number() OVER (PARTITION BY c_custkey // {BOOK_ROWS} ORDER BY c_custkey) + 2 AS row_number,
           CAST(c_custkey AS INTEGER) AS customer, c_name AS name, CAST(c_acctbal AS DECIMAL(10,2)) AS balance,
           nullif(c_mktsegment, 'BUILDING') AS segment, CAST(NULL AS VARCHAR) AS comment
    FROM customer""")
def contract_workbooks(spark, folder):
    """Customers as workbooks of at most 500 rows, read back under a contract."""
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.format_string("%.2f", "c_acctbal").alias("balance"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.floor(F.col("c_custkey") / BOOK_ROWS).cast("long").alias("block"))
    books = rows.groupBy("block").applyInPandas(_workbook, f"{FILE} string, content binary")
    scanned = workbooks.scan_contents(books, by_key=True)
    cells = workbooks.sheet_table(scanned, [f.header.lower() for f in CUSTOMERS.fields])
    filled = landing.drop_blank_rows(cells)
    return project(filled, CUSTOMERS, keep=[FILE, ROW_NUMBER]).withColumnRenamed(FILE, "file")


@query("""
    WITH stored AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f FROM lineitem WHERE l_orderkey % 3 < 2),
    asked AS (
        SELECT l_orderkey AS k, l_linenumber AS n, nullif(l_returnflag, 'R') AS f FROM lineitem WHERE l_orderkey % 3 > 0)
    SELECT k AS order_key, n AS line_number, f AS flag, EXISTS (
        SELECT 1 FROM stored AS s WHERE s.k = a.k AND s.n = a.n AND s.f IS NOT DISTINCT FROM a.f) AS known
    FROM asked AS a""")
def indexed_lookup(spark, folder):
    """Lines looked up in a table of three loads through its index of hashes: two loads merged,
    the third committed after that."""
    store = Store(spark, work_folder(spark, "indexed-lookup"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_returnflag").alias("flag"))
    lines = lines.withColumn(dedup.ROW_HASH, dedup.row_hash(lines, lines.columns))
    keys = ["order_key", "line_number", "flag"]
    store.ensure("lines", lines.select(*keys).schema)
    index = HashIndex(store, "lines")
    loads = ("order_key % 3 = 0 AND line_number < 4", "order_key % 3 = 0 AND line_number >= 4", "order_key % 3 = 1")
    for version, part in enumerate(loads, 1):
        store.write_rows(lines.filter(part), "lines", f"l-{version}")
        index.add(f"l-{version}")
        store.commit("lines", version, f"l-{version}")
        if version == 2:
            index.merge()
    asked = lines.filter("order_key % 3 > 0").withColumn("flag", F.nullif("flag", F.lit("R"))).drop(dedup.ROW_HASH)
    probes = written(asked.withColumn(dedup.ROW_HASH, dedup.row_hash(asked, keys)), "probes")
    return dedup.mark_in_target(probes, index.rows(probes), keys, "known", probes=probes).drop(dedup.ROW_HASH)
