"""Lenient casts over text derived from whole tables, in every shape the casts know."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate import contracts
from sluicegate.contracts import Contract, Field
from sluicegate.functions import casts
from sluicegate.queries.base import SQL_NUMBER, SQL_SPACES, query, table

# The same expressions are valid in both engines.
MESSY_INT = """
    CASE l_linenumber
        WHEN 1 THEN concat('  ', l_orderkey, ' ')
        WHEN 2 THEN concat(l_orderkey, ',5')
        WHEN 3 THEN concat('-', l_orderkey, '.5')
        WHEN 4 THEN concat(l_orderkey, 'd')
        WHEN 5 THEN concat(l_orderkey, ' 000 000')
        WHEN 6 THEN ''
        WHEN 7 THEN concat('1,', l_orderkey, '.5')
        ELSE concat('x', l_orderkey) END"""
_CLEAN = f"regexp_replace(translate(v, {SQL_SPACES}, ''), ',', '.')"


def _sql_int(cleaned: str) -> str:
    number = f"CASE WHEN regexp_matches({cleaned}, '{SQL_NUMBER}') THEN CAST({cleaned} AS DOUBLE) END"
    return (f"CASE WHEN ({number}) BETWEEN -2147483648 AND 2147483647 "
            f"THEN CAST(floor(({number}) + 0.5) AS INTEGER) END")


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, v AS raw, {_sql_int(_CLEAN)} AS contract_int,
           {_sql_int(f"trim(v, {SQL_SPACES})")} AS free_int
    FROM (SELECT *, {MESSY_INT} AS v FROM lineitem)""")
def cast_int(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("raw", F.expr(MESSY_INT))
    return casts.apply_casts(
        lines, {"contract_int": (casts.contract_int, F.col("raw")), "free_int": (casts.free_int, F.col("raw"))},
        keep=["l_orderkey", "l_linenumber", "l_partkey", "raw"])


# A price in cents as text: grouped, with decimal comma, a percent sign or as it is.
MESSY_PRICE = """
    CASE l_returnflag
        WHEN 'A' THEN concat(cents DIV 100, ',', lpad(cast(cents % 100 AS string), 2, '0'))
        WHEN 'N' THEN concat(' ', cents DIV 100, '.', lpad(cast(cents % 100 AS string), 2, '0'), ' %')
        ELSE concat(cents DIV 1000, ' ', lpad(cast(cents % 1000 AS string), 3, '0'), ',455') END"""
_SQL_PRICE = MESSY_PRICE.replace("DIV", "//").replace("string", "VARCHAR")
_PRICE = f"regexp_replace(regexp_replace(translate(v, {SQL_SPACES}, ''), '%', ''), ',', '.')"


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, v AS raw, TRY_CAST({_PRICE} AS DECIMAL(10,2)) AS as_decimal,
           CAST({_PRICE} AS DOUBLE) AS as_float
    FROM (SELECT *, {_SQL_PRICE} AS v
          FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem))""")
def cast_decimal(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return casts.apply_casts(
        lines.withColumn("raw", F.expr(MESSY_PRICE)),
        {"as_decimal": (casts.contract_decimal, F.col("raw")), "as_float": (casts.contract_float, F.col("raw"))},
        keep=["l_orderkey", "l_linenumber", "l_partkey", "raw"])


MESSY_DATE = """
    CASE o_orderpriority
        WHEN '1-URGENT' THEN concat(day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate))
        WHEN '2-HIGH' THEN concat(' ', lpad(cast(day(o_orderdate) AS string), 2, '0'), '.',
                                  lpad(cast(month(o_orderdate) AS string), 2, '0'), '.', year(o_orderdate))
        WHEN '3-MEDIUM' THEN substr(cast(o_orderdate AS string), 1, 10)
        WHEN '4-NOT SPECIFIED' THEN concat(substr(cast(o_orderdate AS string), 1, 10), 'T01:30:00+05:00')
        ELSE concat('31.', month(o_orderdate), '.', year(o_orderdate)) END"""
_SQL_DATE = MESSY_DATE.replace("string", "VARCHAR")


@query(f"""
    SELECT o_orderkey, v AS raw, CASE
               WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(o_orderdate AS DATE)
               WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(o_orderdate - INTERVAL 1 DAY AS DATE)
               ELSE TRY_CAST(concat(year(o_orderdate), '-', month(o_orderdate), '-31') AS DATE) END AS contract_date,
           CASE WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_orderdate AS DATE)
                WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(o_orderdate - INTERVAL 1 DAY AS DATE)
           END AS free_date
    FROM (SELECT *, {_SQL_DATE} AS v FROM orders)""")
def cast_date(spark, folder):
    orders = table(spark, folder, "orders").withColumn("raw", F.expr(MESSY_DATE))
    return casts.apply_casts(
        orders, {"contract_date": (casts.contract_date, F.col("raw")), "free_date": (casts.free_date, F.col("raw"))},
        keep=["o_orderkey", "raw"])


@query(f"""
    SELECT doc_id, trim(v, {SQL_SPACES}) AS contract_text, v AS free_text, trim(v, {SQL_SPACES}) AS legacy_text
    FROM (SELECT doc_id, concat(chr(160), chr(9), text, chr(8195), ' ') AS v FROM documents)""")
def cast_text(spark, folder):
    raw = F.concat(F.lit("\u00a0\t"), "text", F.lit("\u2003 "))
    return table(spark, folder, "documents").select(
        "doc_id", casts.contract_text(raw).alias("contract_text"), casts.free_text(raw).alias("free_text"),
        casts.legacy_text(raw).alias("legacy_text"))


@query("""
    SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 END AS text_bit,
           CASE WHEN value IS NULL THEN NULL WHEN floor(value) <> 0 THEN 1 ELSE 0 END AS number_bit
    FROM events""")
def cast_bit(spark, folder):
    cell = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "0").otherwise(
        F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id", casts.free_bit(cell).alias("text_bit"), casts.number_bit(F.floor("value")).alias("number_bit"))


@query("""
    SELECT o_orderkey,
           CASE WHEN p <= 60 THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END + p AS price_date,
           CASE WHEN k <= 60 THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END + k AS key_date,
           strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS order_day
    FROM (SELECT *, CAST(floor(o_totalprice / 10) AS INTEGER) AS p, CAST(o_custkey AS INTEGER) AS k FROM orders)""")
def cast_date_serial(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", casts.serial_date(F.col("o_totalprice") / 10).alias("price_date"),
        casts.serial_date(F.col("o_custkey")).alias("key_date"), casts.iso_text(F.col("o_orderdate")).alias("order_day"))


@query(f"""
    SELECT 'order_number' AS column_name, count(*) FILTER (WHERE v <> '' AND ({_sql_int(_CLEAN)}) IS NULL) AS cast_failures
    FROM (SELECT *, {MESSY_INT} AS v FROM lineitem)
    UNION ALL SELECT 'flag_date', count(*) FROM lineitem
    UNION ALL SELECT 'ship_date', 0""")
def cast_failures(spark, folder):
    contract = Contract(
        id="messy", title="Messy", table="messy",
        fields=(Field("raw", "order_number", "INT"), Field("l_returnflag", "flag_date", "DATE"),
                Field("l_shipdate", "ship_date", "DATE")))
    lines = table(spark, folder, "lineitem").withColumn("raw", F.expr(MESSY_INT))
    return contracts.cast_failures(lines.select("raw", "l_returnflag", "l_shipdate"), contract)
