"""Every registered query against its SQL, and the known results of the fixtures."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect
from sluicegate.operators import dedup
from sluicegate.queries import QUERIES, SQL
from sluicegate.queries.uniqueness import KEY, ORDER, lines

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert queries()[name].__wrapped__ is QUERIES[name]
    assert compare(spark, con, SMALL, queries()[name], oracle_sql()[name]) is None


def outcomes(df):
    return {r["outcome"]: r["row_count"] for r in df.collect()}


def test_known_outcomes(spark):
    assert outcomes(entry(spark)) == {"accepted": 3967, "dup_in_batch": 1153, "dup_in_target": 290, "invalid": 590}
    assert outcomes(queries()["import_outcomes"](spark, MIDDLE)) == {
        "accepted": 39586, "dup_in_batch": 11675, "dup_in_target": 2772, "invalid": 5967}


def test_known_duplicates(spark):
    rejected = dedup.reject_copies(lines(spark, MIDDLE), KEY, ORDER)
    assert rejected.agg(F.count(F.lit(1)), F.sum("occurrences")).first()[:] == (25953, 28336)
    rows = lines(spark, MIDDLE)
    kept = dedup.not_in_target(rows, rows.filter("l_orderkey < 1000"), [*KEY, "l_partkey"])
    assert kept.count() == 56142


def test_results_do_not_depend_on_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.append(sorted(map(tuple, queries()["skipped_report"](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
