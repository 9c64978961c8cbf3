"""Scans, fingerprints, blank handling, projection, naming, append and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate import messages
from sluicegate.contracts import Constant, Contract, Field, project
from sluicegate.functions import text
from sluicegate.operators import dedup, profile
from sluicegate.plans.store import Store
from sluicegate.queries.base import SQL_NUMBER, SQL_SPACES, query, table
from sluicegate.session import work_folder, written
from sluicegate.sources import landing
from sluicegate.streaming.landing_stream import append_stream

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in ORDER_COLUMNS)} FROM orders")
def landing_scan(spark, folder):
    return landing.as_text(table(spark, folder, "orders"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_fingerprint(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", landing.fingerprint_text(F.col("text")).alias("file_hash"))


_BLANKED = """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
           CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority
    FROM orders"""


@query(f"SELECT * FROM ({_BLANKED}) WHERE coalesce(status, '') <> '' OR priority <> ''")
def drop_blank_rows(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"))
    return landing.drop_blank_rows(rows, ["status", "priority"])


@query("SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def drop_blank_columns(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_custkey", "o_custkey").alias("never_filled"), "o_orderstatus",
        F.lit("").alias("always_empty"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return landing.drop_blank_columns(rows)


LINES = Contract(
    id="order_lines", title="Order lines", table="order_lines",
    fields=(
        Field("L_OrderKey", "order_key", "INT", True),
        Field("l_linenumber", "line_number", "INT", True),
        Field("l_quantity", "quantity", "FLOAT"),
        Field("l_extendedprice", "price", "DECIMAL(12,4)"),
        Field("l_shipdate", "ship_date", "DATE"),
        Field("l_returnflag", "return_flag", "NVARCHAR(20)"),
        Field("l_comment", "comment", "NVARCHAR(255)"),
    ),
)


@query("""
    SELECT CAST(l_orderkey AS INTEGER) AS order_key, l_linenumber AS line_number,
           l_quantity AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
           CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS return_flag,
           CAST(NULL AS VARCHAR) AS comment
    FROM lineitem""")
def contract_projection(spark, folder):
    raw = landing.as_text(table(spark, folder, "lineitem"))
    return project(raw.toDF(*[f" {c.upper()} " for c in raw.columns]), LINES)


def _party(kind: str, prefix: str) -> Contract:
    return Contract(
        id=kind, title=kind, table="parties", constants=(Constant("party_type", "NVARCHAR(50)", kind),),
        fields=(Field(f"{prefix}_name", "name", "NVARCHAR(255)", True),
                Field(f"{prefix}_nationkey", "nation", "INT", True),
                Field(f"{prefix}_acctbal", "balance", "DECIMAL(10,2)")))


@query("""
    SELECT c_name AS name, c_nationkey AS nation, CAST(c_acctbal AS DECIMAL(10,2)) AS balance,
           'customer' AS party_type FROM customer
    UNION ALL
    SELECT s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(10,2)), 'supplier' FROM supplier""")
def auto_fields(spark, folder):
    customers = project(landing.as_text(table(spark, folder, "customer")), _party("customer", "c"))
    suppliers = project(landing.as_text(table(spark, folder, "supplier")), _party("supplier", "s"))
    return customers.unionByName(suppliers)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_number FROM orders")
def row_numbering(spark, folder):
    return landing.parquet_row_numbers(table(spark, folder, "orders")).select("o_orderkey", "row_number")


@query("""
    SELECT page_id, coalesce(nullif(substr(translate(trim(raw), '[]', '__'), 1, 128), ''), 'col') AS name
    FROM (SELECT page_id, ' [' || url || '] ' AS raw FROM pages)""")
def sanitize_identifier(spark, folder):
    raw = F.concat(F.lit(" ["), "url", F.lit("] "))
    return table(spark, folder, "pages").select("page_id", text.sanitize_identifier(raw).alias("name"))


@query(r"""
    SELECT page_id, coalesce(nullif(substr(regexp_replace(
               trim(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')),
               '\s+', '_', 'g'), 1, 128), ''), 'import') AS table_name
    FROM pages""")
def table_name_from_path(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.table_name_from_path(F.col("url")).alias("table_name"))


_LATIN, _LETTERS = "aenortTELqu", "аенортТЭЩью"
_CYRILLIC_TEXT = f"translate(replace(replace(text, 'sh', 'ш'), 'ch', 'ч'), '{_LATIN}', '{_LETTERS}')"


def _replace_all(expression: str, pairs) -> str:
    for old, new in pairs:
        expression = f"replace({expression}, '{old}', '{new}')"
    return expression


@query("SELECT doc_id, {} AS text FROM documents".format(
    _replace_all(_CYRILLIC_TEXT, text.CYRILLIC_TO_LATIN.items())))
def transliterate(spark, folder):
    cyrillic = F.expr(_CYRILLIC_TEXT)
    return table(spark, folder, "documents").select("doc_id", text.transliterate(cyrillic).alias("text"))


_ACCENTS = {"é": "e", "è": "e", "ê": "e", "ç": "c", "ö": "oe", "ä": "ae", "ü": "ue", "ß": "ss", "ñ": "n"}


@query(f"SELECT doc_id, {_replace_all('text', _ACCENTS.items())} AS text FROM documents")
def transliterate_accents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.transliterate(F.col("text"), _ACCENTS).alias("text"))


@query("SELECT doc_id, text FROM documents")
def repair_mojibake(spark, folder):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, folder, "documents").select("doc_id", text.repair_mojibake(broken).alias("text"))


@query("""
    SELECT doc_id, coalesce(substr(nullif(lang, 'en'), 1, 40), '—') AS lang,
           substr(text, 1, 40) AS text, substr(text, 1, 80) AS text_wide
    FROM documents ORDER BY doc_id LIMIT 5""")
def preview_sample(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", text.display_cell(F.nullif("lang", F.lit("en"))).alias("lang"),
        text.display_cell(F.col("text")).alias("text"),
        text.display_cell(F.col("text"), text.TABLE_WIDTH).alias("text_wide"))
    return landing.preview(docs, ["doc_id"])


def _infer_sql(name: str, columns: list[str]) -> str:
    """One SELECT per column over the table's text form."""
    day = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"
    parts = []
    for i, c in enumerate(columns):
        parts.append(f"""
            SELECT {i} AS position, '{c}' AS column_name, CASE
                WHEN count(v) = 0 THEN 'NVARCHAR(255)'
                WHEN count(v) FILTER (regexp_matches(v, '{day}') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) = count(v) THEN 'DATE'
                WHEN count(v) FILTER (regexp_matches(v, '{SQL_NUMBER}')) = count(v) THEN CASE
                    WHEN bool_and(floor(TRY_CAST(v AS DOUBLE)) = TRY_CAST(v AS DOUBLE)) THEN CASE
                        WHEN max(abs(TRY_CAST(v AS DOUBLE))) >= 2147483648 THEN 'BIGINT' ELSE 'INT' END
                    ELSE 'FLOAT' END
                WHEN max(length(v)) > 300 THEN 'NVARCHAR(MAX)' ELSE 'NVARCHAR(255)' END AS inferred_type,
                count(v) AS non_empty, CAST(coalesce(max(length(v)), 0) AS BIGINT) AS max_len
            FROM (SELECT nullif(trim(CAST({c} AS VARCHAR), {SQL_SPACES}), '') AS v FROM {name})""")
    return " UNION ALL ".join(parts)


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(_infer_sql("lineitem", _LINE_COLUMNS))
def infer_schema(spark, folder):
    return profile.infer_schema(landing.as_text(table(spark, folder, "lineitem")))


@query(_infer_sql("lineitem", _LINE_COLUMNS))
def merged_profile(spark, folder):
    """Lines in four parts, each profiled and written by itself; the states are merged."""
    lines = landing.as_text(table(spark, folder, "lineitem"))
    part = F.pmod(F.col("l_orderkey").cast("long"), F.lit(4)).alias("part")
    states = written(profile.profile_state(lines.select("*", part), by=["part"]), "states")
    return profile.inferred(profile.merge_states(states))


@query(_infer_sql("documents", ["doc_id", "lang", "source", "n_chars"]) + """
    UNION ALL SELECT 4, 'text', CASE WHEN max(length(text)) > 300 THEN 'NVARCHAR(MAX)' ELSE 'NVARCHAR(255)' END,
        count(nullif(text, '')), CAST(max(length(text)) AS BIGINT) FROM documents""")
def infer_schema_text(spark, folder):
    docs = landing.as_text(table(spark, folder, "documents"))
    return profile.infer_schema(docs, ["doc_id", "lang", "source", "n_chars", "text"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, 'importer' AS _imported_by
    FROM lineitem""")
def audited_append(spark, folder):
    """Write one load with audit columns, commit it, read it back through the ledger."""
    store = Store(spark, work_folder(spark, "append"))
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    store.ensure("lines", rows.schema)
    store.write_rows(
        rows.select("*", F.lit("b-1").alias("_batch_id"), F.lit(None).cast("long").alias("_row_number"),
                    F.current_timestamp().alias("_imported_at"), F.lit("importer").alias("_imported_by"),
                    dedup.row_hash(rows, rows.columns).alias(dedup.ROW_HASH)),
        "lines", "l-1")
    done = spark.range(1).select(
        F.lit("b-1").alias("batch_id"), F.lit("contract").alias("flow"), F.lit("none").alias("file_hash"),
        F.lit("lineitem").alias("file_name"), F.lit("lines").alias("table_name"),
        F.lit("importer").alias("uploaded_by"), F.lit(None).cast("string").alias("uploaded_by_name"),
        *[F.lit(0).cast("long").alias(c) for c in (
            "total_rows", "valid_rows", "error_rows", "inserted_rows", "skipped_rows")],
        F.lit(messages.IMPORTED).alias("status"), F.lit(None).cast("string").alias("notes"))
    store.record(done, "l-1", 2)
    return store.table("lines").select(*rows.columns, "_imported_by")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def committed_batches_only(spark, folder):
    """Lines of two loads, of orders with the final status and of the others; one is committed."""
    store = Store(spark, work_folder(spark, "committed"))
    final = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    store.ensure("lines", lines.schema)
    for load, statuses in (("l-final", "o_orderstatus = 'F'"), ("l-open", "o_orderstatus <> 'F'")):
        rows = lines.join(final.filter(statuses), "l_orderkey", "left_semi")
        store.write_rows(rows.withColumn("_batch_id", F.lit(load)), "lines", load)
    store.commit("lines", 1, "l-final")
    return store.table("lines").select(*lines.columns)


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def incremental_landing(spark, folder):
    """The events file through the file stream into a table, everything that is there now."""
    work = work_folder(spark, "stream")
    schema = table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    running = append_stream(
        arriving.select("event_id", "ts", "user_id", "event_type", "value"), f"{work}/table", f"{work}/state")
    running.awaitTermination()
    return spark.read.parquet(f"{work}/table")
