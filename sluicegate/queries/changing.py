"""Keyed changes and current state."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.operators import changes
from sluicegate.plans.keyed import KeyedTable
from sluicegate.plans.store import Store
from sluicegate.queries.base import query, table
from sluicegate.session import work_folder


@query("""
    WITH newest AS (
        SELECT o_custkey AS key, o_orderpriority AS segment, o_totalprice AS balance
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
              FROM orders) WHERE place = 1)
    SELECT * FROM newest
    UNION ALL
    SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT key FROM newest)""")
def keyed_upsert(spark, folder):
    """Customers take the priority and price of their newest order."""
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("segment"),
        F.col("o_totalprice").alias("balance"), "o_orderdate", "o_orderkey")
    newest = changes.latest_per_key(orders, ["key"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return changes.keyed_upsert(base, newest, ["key"])


@query("""
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def keyed_delete(spark, folder):
    removed = table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    base = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return changes.keyed_delete(base, removed, ["c_custkey"])


@query("""
    SELECT user_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
    WHERE place = 1""")
def batch_status_current(spark, folder):
    return changes.current_status(table(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""
    WITH roles AS (
        SELECT concat('user', user_id) AS username, CASE WHEN bool_or(event_type = 'purchase') THEN 'trainer'
                   ELSE 'viewer' END AS role FROM events GROUP BY user_id)
    SELECT username, role, CASE role WHEN 'trainer' THEN 'admin' END AS granted_by FROM roles""")
def role_upsert(spark, folder):
    """Every user starts as viewer; users with a purchase are granted a role."""
    events = table(spark, folder, "events")
    name = F.concat(F.lit("user"), "user_id")
    roles = events.select(name.alias("username")).distinct().select(
        "username", F.lit("viewer").alias("role"), F.lit(None).cast("string").alias("granted_by"),
        F.lit("2020-01-01").cast("timestamp").alias("granted_at"))
    granted = events.filter("event_type = 'purchase'").select(F.concat(F.lit(" USER"), "user_id").alias("username"))
    after = changes.grant_role(roles, granted, "trainer", "admin")
    return after.orderBy(F.col("granted_at").desc(), "username").drop("granted_at")


@query("""
    WITH priced AS (
        SELECT o_custkey AS k, max_by(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) AS segment, max(o_totalprice) AS balance
        FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    one AS (
        SELECT c_custkey AS k, coalesce(segment, c_mktsegment) AS segment, coalesce(balance, c_acctbal) AS balance
        FROM customer LEFT JOIN priced ON c_custkey = k),
    two AS (SELECT * FROM one WHERE k % 7 <> 0),
    three AS (SELECT * FROM two WHERE k % 5 <> 0 UNION ALL SELECT c_custkey, 'BACK', 0.5 FROM customer WHERE c_custkey % 5 = 0)
    SELECT k AS key, segment, balance FROM three""")
def merge_on_read(spark, folder):
    """Customers as a keyed table: prices of orders, a delete, a compaction, another upsert."""
    store = Store(spark, work_folder(spark, "keyed"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"))
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    newest = orders.groupBy(F.col("o_custkey").alias("key")).agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("segment"),
        F.max("o_totalprice").cast("double").alias("balance")).join(customers.select("key"), "key", "left_semi")
    keyed = KeyedTable(store, "customers", customers.schema, ["key"])
    keyed.upsert(customers)
    keyed.upsert(newest)
    keyed.compact()
    keyed.delete(customers.filter("key % 7 = 0"))
    keyed.upsert(customers.filter("key % 5 = 0").select("key", F.lit("BACK").alias("segment"), F.lit(0.5).alias("balance")))
    return keyed.rows()
