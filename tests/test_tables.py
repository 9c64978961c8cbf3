"""Keyed tables, page indexes and profiles that are kept and merged."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluicegate.operators import dedup, profile, reports
from sluicegate.plans import hash_index, numbered_log, store as tables
from sluicegate.plans.hash_index import HashIndex
from sluicegate.plans.keyed import KeyedTable
from sluicegate.plans.numbered_log import NumberedLog
from sluicegate.plans.pages import build_page_index
from sluicegate.plans.store import BATCHES, Store
from sluicegate.sources import landing


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def keyed(store):
    return KeyedTable(store, "people", store.spark.createDataFrame([], "id long, name string").schema, ["id"], buckets=8)


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def state(table):
    return {r["id"]: r["name"] for r in table.rows().collect()}


def test_changes_win_over_the_base_and_over_earlier_changes(spark, store):
    table = keyed(store)
    assert state(table) == {}
    table.upsert(people(spark, (1, "a"), (2, "b"), (None, "none"), (3, None)))
    table.delete(people(spark, (2, None), (9, None)))
    table.upsert(people(spark, (1, "A"), (2, "again"), (4, "d"), (None, "other")))
    want = {1: "A", 2: "again", 3: None, 4: "d", None: "other"}
    assert state(table) == want and table.rows().count() == 5
    table.compact()
    assert state(table) == want
    table.delete(people(spark, (None, None), (4, None)))
    assert state(table) == {1: "A", 2: "again", 3: None}
    table.upsert(people(spark, (4, "first"), (4, "last")), order=[F.col("name") == "last"])
    table.compact()
    assert state(table) == {1: "A", 2: "again", 3: None, 4: "last"}
    assert [tuple(r) for r in table.rows_of(people(spark, (4, None), (8, None))).collect()] == [(4, "last")]


def test_a_change_made_during_compaction_stays(spark, store, monkeypatch):
    table = keyed(store)
    table.upsert(people(spark, (1, "a"), (2, "b")))
    real = KeyedTable._write

    def meanwhile(self, rows, folder):
        real(self, rows, folder)
        if folder.startswith("base"):
            monkeypatch.setattr(KeyedTable, "_write", real)
            keyed(store).upsert(people(spark, (2, "B"), (3, "c")))

    monkeypatch.setattr(KeyedTable, "_write", meanwhile)
    table.compact()
    assert state(table) == {1: "a", 2: "B", 3: "c"}
    table.compact()
    assert state(table) == {1: "a", 2: "B", 3: "c"}


def test_an_upsert_writes_in_proportion_to_its_keys(spark, store, tmp_path):
    table = keyed(store)
    table.upsert(spark.range(20000).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name")))
    table.compact()

    def size():
        files = glob.glob(f"{tmp_path}/store/tables/people/**/*.parquet", recursive=True)
        return len(files), sum(map(os.path.getsize, files))

    before = size()
    table.upsert(people(spark, (5, "five"), (70, "seventy")))
    after = size()
    assert after[0] - before[0] <= 2 and after[1] - before[1] < before[1] / 50
    assert table.rows().count() == 20000
    touched = table.rows_of(people(spark, (5, None)))
    assert touched.collect()[0]["name"] == "five"


def test_pages_of_an_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(int(i), int(rng.integers(40)) if i % 9 else None, f"t{i}") for i in range(1234)]
    df = spark.createDataFrame(data, "id long, score long, `a text` string").repartition(5)
    index = build_page_index(df, [F.col("score").desc(), "id"], str(tmp_path / "i"), rows_per_range=200)
    assert index.total == 1234 and len(index.ranges) > 3
    for number in (1, 2, 4, 7, 12, 13, 14):
        want = reports.page_rows(df, [F.col("score").desc(), "id"], page=number, page_size=100).collect()
        assert [tuple(r) for r in index.page(number, 100).collect()] == [tuple(r) for r in want]
    page = index.page(6, 20)
    assert page.columns == df.columns and len(page.inputFiles()) >= 1
    read = [f for f in index.spark.read.parquet(index.path).filter(F.col("_range") == 0).inputFiles()]
    assert read
    scans = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "_range" in scans


def test_pages_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long")
    index = build_page_index(df, ["id"], str(tmp_path / "i"))
    assert index.total == 0 and index.page(1).collect() == [] and index.page(3).columns == ["id"]


def test_merged_states_equal_one_pass(spark):
    rows = [("f1", 2, "1", "2020-01-01", "x", ""), ("f1", 3, "2.5", "2020-01-02", None, None), ("f2", 2, "7", "no day", "1", None),
            ("f2", 3, "", "3", "y" * 400, None), ("f3", 2, "8", "2021-05-05", "2", None)]
    df = spark.createDataFrame(rows, f"{landing.FILE} string, row_number long, a string, b string, c string, d string")
    states = profile.profile_state(df, by=[landing.FILE])
    old = states.where(F.col(landing.FILE) != "f2")
    merged = profile.merge_states(old.unionByName(states.where(F.col(landing.FILE) == "f2")))
    one = profile.profile_state(df.drop(landing.FILE))
    columns = [c for c in one.columns]
    assert sorted(map(tuple, merged.select(*columns).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert sorted(map(tuple, profile.inferred(merged).collect())) == sorted(map(tuple, profile.infer_schema(df).collect()))
    breaks = {r["column_name"]: (r["first_no_day"], r["first_no_number"], r["first_not_whole"]) for r in merged.collect()}
    assert breaks == {"a": (2, None, 3), "b": (2, 2, 2), "c": (2, 2, 2), "d": (None, None, None)}
    # A part may lack a column, or have it at another place.
    other = profile.profile_state(spark.createDataFrame([("9", "x")], "c string, e string"))
    both = {r["column_name"]: r["filled"] for r in profile.merge_states(one.unionByName(other)).collect()}
    assert both == {"a": 4, "b": 5, "c": 5, "d": 0, "e": 1} or both == {"a": 4, "b": 5, "c": 5, "d": None, "e": 1}


def _hashed(spark, ids):
    rows = spark.createDataFrame([(i, f"name {i}") for i in ids], "id long, name string").coalesce(1)
    return rows.withColumn(dedup.ROW_HASH, dedup.row_hash(rows, ["id", "name"]))


def _indexed(spark, store, loads, file_rows):
    store.ensure("people", _hashed(spark, []).drop(dedup.ROW_HASH).schema)
    index = HashIndex(store, "people", file_rows)
    for version, ids in enumerate(loads, 1):
        store.write_rows(_hashed(spark, ids).repartition(8, "id"), "people", f"l-{version}")
        index.add(f"l-{version}")
        store.commit("people", version, f"l-{version}")
    return index


def _found(index, probes):
    return sorted(r["id"] for r in index.rows(probes).join(probes.select(dedup.ROW_HASH), dedup.ROW_HASH, "left_semi").collect())


def test_a_look_up_opens_files_by_its_own_size(spark, tmp_path):
    probes = _hashed(spark, [5, 700, 1_000_000]).cache()
    for n in (2_000, 8_000):
        index = _indexed(spark, Store(spark, f"file://{tmp_path}/{n}"), [range(n)], 100)
        files = index._read("ranges", hash_index.RANGES).count()
        assert files >= n / 100
        # Three hashes: a file of hashes each, and one more where a cell is shared.
        assert index._candidates(probes.select(dedup.ROW_HASH)).count() <= 6
        assert len(index.rows(probes).inputFiles()) <= 2
        assert _found(index, probes) == [5, 700]


def test_index_over_loads_merged_and_later_ones(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    index = _indexed(spark, store, [range(0, 500), range(500, 600), []], 50)
    probes = _hashed(spark, [*range(450, 720, 7), -3]).cache()
    store.write_rows(_hashed(spark, range(600, 700)), "people", "l-open")
    index.add("l-open")  # not committed
    expected = [i for i in range(450, 720, 7) if i < 600]
    assert _found(index, probes) == expected
    index.merge()
    assert index._visible().collect()[0][0].startswith("merged-") and index._visible().count() == 1
    assert _found(index, probes) == expected
    store.commit("people", 4, "l-open")
    expected = [i for i in range(450, 720, 7) if i < 700]
    assert _found(index, probes) == expected
    index.merge()
    assert _found(index, probes) == expected
    # More files than a reader is handed: the folders are read as a whole, with the same result.
    assert _found(HashIndex(store, "people", 50, most_files=0), probes) == expected
    assert _found(index, probes.limit(0)) == []


def test_index_of_a_table_without_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    index = _indexed(spark, store, [], 50)
    index.merge()
    assert _found(index, _hashed(spark, [1])) == []


def test_ranges_at_the_ends_of_the_numbers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ends = [-2**63, -2**63 + 1, -1, 0, 1, 2**62, 2**63 - 1]
    index = _indexed(spark, store, [], 50)
    rows = spark.createDataFrame([(i, "x", h) for i, h in enumerate(ends)], f"id long, name string, {dedup.ROW_HASH} long")
    for version, part in enumerate((rows, rows.filter("id IN (0, 6)"), rows.filter("id = 3")), 1):
        store.write_rows(part, "people", f"l-{version}")
        index.add(f"l-{version}")
        store.commit("people", version, f"l-{version}")
    for i, h in enumerate(ends):
        assert i in _found(index, rows.filter(F.col("id") == i)), h


def ledger_rows(spark, load, statuses):
    rows = [(f"{load}-{i}", "contract", "h", "f", "t", "ann", None, 1, 1, 0, 0, 0, status, None) for i, status in enumerate(statuses)]
    return spark.createDataFrame(rows, BATCHES[:-1])


def test_folded_ledger_equals_the_whole_one(spark, tmp_path):
    """Steps read from folds and their tail, beside the same steps read one by one; steps written
    again, before and after they were folded, count as they were written last."""
    stores = [Store(spark, f"file://{tmp_path}/{every}", fold_every=every) for every in (3, 1000)]
    for store in stores:
        for load in ("1", "b", "c"):
            store.record(ledger_rows(spark, load, ["VALIDATED", "REJECTED"]), load, 1)
            store.record(ledger_rows(spark, load, ["IMPORTED"]), load, 2)
        store.record(ledger_rows(spark, "1", ["FAILED", "FAILED"]), "1", 2)
        store.record(ledger_rows(spark, "d", ["VALIDATED"]), "d", 1)
        store.record(ledger_rows(spark, "d", ["REJECTED"]), "d", 1)
    folded, whole = [sorted(map(tuple, s.ledger().drop("event_time").collect()), key=str) for s in stores]
    assert folded == whole and len(folded) == 3 * 3 + 1 + 1
    assert [s._steps.base()[0] for s in stores] == [9, 0]
    assert len(stores[0].ledger().inputFiles()) < len(stores[1].ledger().inputFiles())
    for store in stores:
        assert {r["batch_id"]: r["status"] for r in store.statuses().collect()} == {
            "1-0": "FAILED", "1-1": "FAILED", "b-0": "IMPORTED", "b-1": "REJECTED", "c-0": "IMPORTED",
            "c-1": "REJECTED", "d-0": "REJECTED"}
        assert {r["load_id"] for r in store.committed_loads().collect()} == {"b", "c"}


def test_state_of_a_ledger_is_sorted_by_tasks_of_few_rows(spark, tmp_path, monkeypatch):
    """Files of the ledger and the tasks that look for the newest events hold a limited number of rows."""
    monkeypatch.setattr(tables, "SORTED_ROWS", 20)
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    store = Store(spark, f"file://{tmp_path}/s", fold_every=2)
    store.record(ledger_rows(spark, "1", ["VALIDATED"] * 100).coalesce(1), "1", 1)
    store.record(ledger_rows(spark, "1", ["IMPORTED"] * 100).coalesce(1), "1", 2)
    assert store._steps.base()[0] == 2
    store.record(ledger_rows(spark, "2", ["REJECTED"] * 100).coalesce(1), "2", 1)
    now = store.batches()
    assert now.rdd.getNumPartitions() >= 300 // 20
    assert sorted(r["status"] for r in now.collect()) == ["IMPORTED"] * 100 + ["REJECTED"] * 100
    sizes = [pq.read_metadata(f).num_rows for part in ("ledger/batches", "ledger/steps/folded")
             for f in glob.glob(f"{tmp_path}/s/{part}/*/*.parquet")]
    assert max(sizes) <= 10 and sum(sizes) == 300 + 200


def test_folded_versions_and_entries_without_a_text(spark, tmp_path):
    """A number that was taken and not named yet is neither read nor folded over."""
    store = Store(spark, f"file://{tmp_path}/s", fold_every=2)
    assert all(store.commit("t", n, f"l-{n}") for n in range(1, 4))
    assert store._commits("t").base()[0] == 2
    store._commits("t").take(4, "")
    assert store.commit("t", 5, "l-5") and not store.commit("t", 2, "other")
    assert store._commits("t").base()[0] == 3
    assert sorted(map(tuple, store.versions("t").collect())) == [(1, "l-1"), (2, "l-2"), (3, "l-3"), (5, "l-5")]


def test_log_finds_its_end_over_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(numbered_log, "GROUP", 3)
    log = NumberedLog(spark, f"file://{tmp_path}/log")
    assert [log.append(f"x{i}") for i in range(1, 12)] == list(range(1, 12))
    assert sorted(r["number"] for r in log.after(4).collect()) == list(range(5, 12))
    log.fold(log.after(0), 11)
    assert log.append("y") == 12 and [tuple(r) for r in log.after(11).collect()] == [(12, "y")]
    assert spark.read.parquet(log.base()[1]).count() == 11


def test_rows_of_a_load_are_not_shuffled_to_be_read(spark, store):
    store.ensure("t", spark.range(1).schema)
    store.write_rows(spark.range(1000, numPartitions=4).withColumn("_batch_id", F.lit("b")), "t", "l-1")
    assert store.commit("t", 1, "l-1")
    rows = store.table("t")
    assert rows.count() == 1000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_narrow_ranges_of_an_index_need_few_tasks(spark, tmp_path):
    df = spark.range(3000, numPartitions=3).select("id", (F.col("id") * 7919 % 1000).alias("score"))
    index = build_page_index(df, [F.col("score").desc(), "id"], str(tmp_path / "i"), rows_per_range=20)
    assert index.total == 3000 and len(index.ranges) == 150
    writers = {os.path.basename(f).split("-")[1] for f in glob.glob(f"{tmp_path}/i/*/*.parquet")}
    assert len(writers) == 1
    for number in (1, 30, 60):
        want = reports.page_rows(df, [F.col("score").desc(), "id"], page=number, page_size=50).collect()
        assert [tuple(r) for r in index.page(number, 50).collect()] == [tuple(r) for r in want]
