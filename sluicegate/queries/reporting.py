"""Read side queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.operators import reports
from sluicegate.plans import pages
from sluicegate.queries.base import query, table
from sluicegate.session import work_folder


@query("""
    SELECT b.o_orderkey, b.o_orderdate, b.o_orderstatus, b.o_totalprice, e.l_linenumber, e.l_partkey, e.l_returnflag
    FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) AS b
    LEFT JOIN lineitem AS e ON b.o_orderkey = e.l_orderkey""")
def batch_history(spark, folder):
    """Orders as batches, their lines as errors."""
    batches = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    errors = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    history = reports.batch_history(batches, errors, "o_orderkey", "o_orderdate")
    return history.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc(), "l_linenumber", "l_partkey")


@query("SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_batches_topn(spark, folder):
    return reports.recent_batches(table(spark, folder, "orders"), "o_orderdate", "o_orderkey", limit=0)


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events_topn(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return reports.recent_events(events, "ts", "event_id", 50)


# Names of the catalog, with the day each table was created.
CATALOG = {
    "customer": "2024-01-03", "orders": "2024-01-05", "lineitem": "2024-01-05",
    "events": "2024-02-01", "documents": "2024-03-01", "labels": "2024-03-02",
}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, DATE '{day}' AS created, count(*) AS row_count FROM {name}" for name, day in CATALOG.items()))
def table_catalog(spark, folder):
    catalog = spark.createDataFrame(list(CATALOG.items()), "name string, created string").withColumn(
        "created", F.col("created").cast("date"))
    counts = reports.table_counts({name: table(spark, folder, name) for name in CATALOG})
    return reports.table_catalog(catalog, counts)


@query("""
    SELECT n_nationkey, n_regionkey, coalesce(nullif(trim(CASE WHEN r_name = 'ASIA' THEN ' ' ELSE r_name END), ''), n_name) AS n_name
    FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'EUROPE') ON n_regionkey = r_regionkey""")
def label_overlay(spark, folder):
    """Region names as labels over nation names: one label blank, one missing."""
    labels = table(spark, folder, "region").filter("r_name <> 'EUROPE'").select(
        F.col("r_regionkey").alias("n_regionkey"),
        F.when(F.col("r_name") == "ASIA", " ").otherwise(F.col("r_name")).alias("display_name"))
    return reports.label_overlay(
        table(spark, folder, "nation"), labels, "n_regionkey", {"n_name": "display_name"})


@query("""
    SELECT (SELECT count(*) FROM orders) AS training_batches, (SELECT count(*) FROM documents) AS free_batches,
           (SELECT count(*) FROM events) AS total_logins, (SELECT count(*) FROM customer) AS user_tables""")
def dashboard_counts(spark, folder):
    return reports.single_row({
        "training_batches": table(spark, folder, "orders"), "free_batches": table(spark, folder, "documents"),
        "total_logins": table(spark, folder, "events"), "user_tables": table(spark, folder, "customer")})


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM customer")
def page_info(spark, folder):
    return reports.page_info(table(spark, folder, "customer"))


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def page_rows(spark, folder):
    return reports.page_rows(table(spark, folder, "customer"), ["c_custkey"], page=3)


@query("SELECT * FROM customer WHERE c_custkey > 99 ORDER BY c_custkey LIMIT 50")
def page_after_key(spark, folder):
    return reports.page_after(table(spark, folder, "customer"), "c_custkey", 99)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 50 OFFSET 2450""")
def indexed_page(spark, folder):
    """Page 50 of the lines by price, through the page index."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_shipdate")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    index = pages.build_page_index(lines, order, work_folder(spark, "pages"), rows_per_range=4000)
    return index.page(50).drop("l_suppkey", "l_shipdate")
