"""Whole loads: folders of files into committed tables."""

import os
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sluicegate import messages
from sluicegate.contracts import Contract, Field
from sluicegate.operators import validate
from sluicegate.plans import imports
from sluicegate.plans.outcomes import ACCEPTED, DUP_IN_BATCH, DUP_IN_TARGET
from sluicegate.plans.store import Store
from sluicegate.registry import CONTRACTS
from sluicegate.sources import fingerprint, landing, workbooks
from sluicegate.sources.fingerprint import fingerprint_files
from sluicegate.streaming.landing_stream import start_landing
from workbook_writer import write_workbook

HEAD = "Дата,ИИН,ФИ,Доп. Балл,Подтверждение"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


def put(folder, name, *lines, head=HEAD):
    (folder / name).write_text("\n".join([head, *lines]) + "\n", encoding="utf8")


def listing(spark, folder, glob="*.csv"):
    return landing.list_files(spark, str(folder), glob)


def by_name(ledger):
    return {r["file_name"]: r for r in ledger.collect()}


ATTESTATION = CONTRACTS.get("attestation")


def test_contract_load_counts_and_rows(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,123456789012,Анна,\"12,5%\",да", "1.4.2026,123456789012,Анна,\"12,5%\",да",
        ",,,,", "31.02.2026,1,Б,x,нет")
    put(inbox, "b.csv", "01.04.2026,123456789012,Анна,12.5,да", "2026-05-01,2,В,,да", "2026-05-01,2,В,,да")
    ledger = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", by_name="Ann"))
    a, b = ledger["a.csv"], ledger["b.csv"]
    assert (a["total_rows"], a["valid_rows"], a["error_rows"], a["inserted_rows"], a["skipped_rows"]) == (3, 2, 1, 2, 0)
    # The first row of b equals a row of the earlier file; its last row repeats its second.
    assert (b["total_rows"], b["valid_rows"], b["error_rows"], b["inserted_rows"], b["skipped_rows"]) == (3, 2, 1, 1, 1)
    assert a["status"] == b["status"] == messages.IMPORTED
    rows = store.table("attestation").collect()
    assert len(rows) == 3
    assert {(str(r["exam_date"]), r["bonus_score"]) for r in rows} == {
        ("2026-04-01", 12.5), ("None", None), ("2026-05-01", None)}
    assert {r["_imported_by"] for r in rows} == {"ann"}
    errors = {(r["row_number"], r["error_message"]) for r in store.errors().collect()}
    assert errors == {(3, messages.DUPLICATE_IN_FILE), (4, messages.DUPLICATE_IN_FILE)}
    skips = store.skipped().collect()
    assert sorted((r["row_number"], r["reason"]) for r in skips if r["reason"] == messages.ROW_EXISTS) == [
        (2, messages.ROW_EXISTS)]
    assert skips[0]["preview"].startswith("Дата: ")


def test_source_row_numbers_survive_blank_rows(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да", ",,,,", "2.4.2026,2,Б,2,нет")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    assert sorted(r["_row_number"] for r in store.table("attestation").collect()) == [2, 4]


def test_second_load_of_the_same_content_is_refused(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    put(inbox, "copy.csv", "1.4.2026,1,А,1,да")
    again = imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    assert again.count() == 0
    assert store.table("attestation").count() == 1


def test_rows_already_in_target_are_skipped(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,1,А,,да")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    put(inbox, "b.csv", "01.04.2026, 1 ,А,,да", "1.4.2026,1,А,5,да")
    b = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann"))["b.csv"]
    assert (b["inserted_rows"], b["skipped_rows"]) == (1, 1)
    assert store.table("attestation").count() == 2


def test_constants_keep_two_contracts_apart(spark, store, inbox):
    head = "ИИН,Группа №,Дата"
    put(inbox, "s.csv", "1,1,1.4.2026", head=head)
    imports.import_files(store, listing(spark, inbox), CONTRACTS.get("supervisor_school"), "ann")
    put(inbox, "d.csv", "1,1,01.04.2026", head=head)
    imports.import_files(store, listing(spark, inbox, "d.csv"), CONTRACTS.get("director_school"), "ann")
    assert sorted(r["school_type"] for r in store.table("school_sessions").collect()) == ["director", "supervisor"]


def test_each_file_is_matched_by_its_own_header(spark, store, inbox):
    """Columns in another order, with one less, one more, or spelled differently."""
    put(inbox, "a.csv", "1.4.2026,1,А,1,да")
    put(inbox, "b.csv", "нет,2,Б,2.4.2026", head="подтверждение, ИИН ,фи,ДАТА,доп. балл")
    put(inbox, "c.csv", '"3.4.2026","да, верно","x",3,В,3,9', head='Дата,Подтверждение,"Лишний, с запятой",ИИН,ФИ,Доп. Балл,иин')
    put(inbox, "d.csv", "1", head="Дата")
    (inbox / "e.csv").write_text("\n\n")
    put(inbox, "f.csv")
    ledger = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann"))
    assert {n: ledger[n]["status"] for n in ledger} == {
        **dict.fromkeys(["a.csv", "b.csv", "c.csv"], messages.IMPORTED),
        **dict.fromkeys(["d.csv", "e.csv", "f.csv"], messages.REJECTED)}
    assert "missing required columns" in ledger["d.csv"]["notes"] and "иин" in ledger["d.csv"]["notes"]
    assert ledger["e.csv"]["notes"] == "the file has no rows"
    rows = {r["iin"]: r for r in store.table("attestation").collect()}
    assert {k: (str(r["exam_date"]), r["full_name"], r["bonus_score"], r["confirmed"], r["_row_number"]) for k, r in rows.items()} == {
        "1": ("2026-04-01", "А", 1.0, "да", 2), "2": ("2026-04-02", "Б", None, "нет", 2),
        "3": ("2026-04-03", "В", 3.0, "да, верно", 2)}


def test_an_old_file_of_another_header_blocks_nothing(spark, store, inbox):
    put(inbox, "old.csv", "да,7,Ж,1.4.2026,", head="Подтверждение,ИИН,ФИ,Дата,Доп. Балл")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    put(inbox, "new.csv", "1.4.2026,1,А,1,да", "1.4.2026,7,Ж,,да")
    ledger = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann"))
    assert set(ledger) == {"new.csv"}
    assert (ledger["new.csv"]["inserted_rows"], ledger["new.csv"]["skipped_rows"]) == (1, 1)


def test_free_files_of_different_headers(spark, store, inbox):
    put(inbox, "a.csv", "1,x", head="id,name")
    put(inbox, "b.csv", "y,2.5,2,9", head="name,rate,id,")
    ledger = by_name(imports.import_free(store, listing(spark, inbox), "mixed", "bob"))
    assert {r["inserted_rows"] for r in ledger.values()} == {1}
    rows = sorted((r["id"], r["name"], r["rate"]) for r in store.table("mixed").collect())
    assert rows == [(1, "x", None), (2, "y", 2.5)]


def test_a_file_may_lack_columns_of_its_table(spark, store, inbox):
    """Rows are compared on the columns of the file; the others become NULL."""
    put(inbox, "a.csv", "1,x,1.5", "2,y,2.5", head="id,name,rate")
    imports.import_free(store, listing(spark, inbox, "a.csv"), "t", "bob")
    put(inbox, "b.csv", "1,x", "2,other", "3,z", "3,z", head="id,name")
    b = by_name(imports.import_free(store, listing(spark, inbox, "b.csv"), "t", "bob"))["b.csv"]
    assert (b["inserted_rows"], b["skipped_rows"]) == (2, 2)
    put(inbox, "c.csv", "3,z,", "4,w,4", "1,x,1.5", head="id,name,rate")
    c = by_name(imports.import_free(store, listing(spark, inbox, "c.csv"), "t", "bob"))["c.csv"]
    assert (c["inserted_rows"], c["skipped_rows"]) == (1, 2)
    assert sorted(map(str, ((r["id"], r["name"], r["rate"]) for r in store.table("t").collect()))) == sorted(map(str, [
        (1, "x", 1.5), (2, "y", 2.5), (2, "other", None), (3, "z", None), (4, "w", 4.0)]))


def test_two_loads_at_once_accept_each_row_once(spark, store, inbox, monkeypatch):
    """Another load commits between the look-up and the commit of this one."""
    put(inbox, "a.csv", "1.4.2026,1,А,1,да", "1.4.2026,2,Б,1,да", "1.4.2026,3,В,1,да")
    put(inbox, "b.csv", "1.4.2026,2,Б,1,да", "1.4.2026,9,Я,1,да")
    put(inbox, "c.csv", "1.4.2026,3,В,1,да", "1.4.2026,9,Я,1,да")
    real = Store.write_rows

    def meanwhile(self, df, name, load_id):
        real(self, df, name, load_id)
        if load_id == "l-a":
            monkeypatch.setattr(Store, "write_rows", real)
            for other in "bc":
                imports.import_files(store, listing(spark, inbox, f"{other}.csv"), ATTESTATION, "bob", load_id=f"l-{other}")

    monkeypatch.setattr(Store, "write_rows", meanwhile)
    a = by_name(imports.import_files(store, listing(spark, inbox, "a.csv"), ATTESTATION, "ann", load_id="l-a"))["a.csv"]
    assert (a["status"], a["inserted_rows"], a["skipped_rows"]) == (messages.IMPORTED, 1, 2)
    rows = store.table("attestation").collect()
    assert sorted(r["iin"] for r in rows) == ["1", "2", "3", "9"]
    assert [r["load_id"] for r in store.versions("attestation").orderBy("version").collect()] == ["l-b", "l-c", "l-a"]
    skipped = [r for r in store.skipped().collect() if r["reason"] == messages.ROW_EXISTS]
    assert len(skipped) == 3


def test_a_load_that_stopped_after_its_commit_is_finished(spark, store, inbox, monkeypatch):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да")
    real = Store.finish

    def stopped(self, load_id, name):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(Store, "finish", stopped)
    with pytest.raises(RuntimeError):
        imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", load_id="l-1")
    assert store.table("attestation").count() == 1
    assert [r["status"] for r in store.statuses().collect()] == [messages.VALIDATED]
    monkeypatch.setattr(Store, "finish", real)
    ledger = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", load_id="l-1"))
    assert (ledger["a.csv"]["status"], ledger["a.csv"]["inserted_rows"]) == (messages.IMPORTED, 1)


def test_a_version_is_taken_once(store):
    store.ensure("t", store.spark.range(1).schema)
    assert store.commit("t", 1, "l-1") and not store.commit("t", 1, "l-2") and store.commit("t", 2, "l-2")
    assert store.version("t") == 2 and store.version("other") == 0
    with pytest.raises(TimeoutError):
        store.commit("t", 3, "")
        store.rows_since("t", 2, patience=0.3)


def test_a_repeated_event_write_replaces_itself(spark, store):
    events = spark.createDataFrame([("ann", "Ann"), ("bob", "Bob")], "username string, display_name string")
    for write_id in ("w1", "w1", None):
        store.log_events(events, write_id)
    assert sorted(r["username"] for r in store.log().collect()) == ["ann", "ann", "bob", "bob"]
    assert store.log().columns == ["username", "display_name", "logged_at"]


def test_rules_reject_rows(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,123456789012,А,1,да", "1.4.2026,12,А,1,может быть")
    rules = [validate.digits("iin", F.col("iin"), 12, "twelve digits"),
             validate.one_of("confirmed", F.col("confirmed"), ("да", "нет"), "yes or no")]
    a = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", rules=rules))["a.csv"]
    assert (a["valid_rows"], a["error_rows"], a["inserted_rows"]) == (1, 1, 1)
    assert store.errors().count() == 2


def test_failed_write_leaves_nothing_visible_and_can_be_repeated(spark, store, inbox, monkeypatch):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да", "2.4.2026,2,Б,1,да")
    real = Store.write_rows

    def broken(self, df, name, load_id):
        boom = F.when(F.col("iin") == "2", F.raise_error(F.lit("disk full"))).otherwise(F.col("iin"))
        real(self, df.withColumn("iin", boom.cast("string")), name, load_id)

    monkeypatch.setattr(Store, "write_rows", broken)
    with pytest.raises(Exception, match="disk full"):
        imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", load_id="l-once")
    assert store.table("attestation").count() == 0
    assert [r["status"] for r in store.statuses().collect()] == [messages.FAILED]
    monkeypatch.setattr(Store, "write_rows", real)
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", load_id="l-once")
    assert store.table("attestation").count() == 2
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann", load_id="l-once")
    assert store.table("attestation").count() == 2
    assert [r["status"] for r in store.statuses().collect()] == [messages.IMPORTED]


def hashes(spark, inbox):
    return {r["file_name"]: r["file_hash"] for r in fingerprint_files(listing(spark, inbox)).collect()}


def test_fingerprints_do_not_depend_on_blocks(spark, store, inbox):
    """Lines count with their place; how a file is cut does not count."""
    lines = [f"1.4.2026,{i},А,1,да" for i in range(1200)]
    put(inbox, "a.csv", *lines)
    put(inbox, "copy.csv", *lines)
    put(inbox, "swapped.csv", lines[1], lines[0], *lines[2:])
    put(inbox, "far.csv", lines[-1], *lines[1:-1], lines[0])
    put(inbox, "other.csv", *lines[:-1], "1.4.2026,x,А,1,да")
    (inbox / "no-end.csv").write_text("\n".join([HEAD, *lines]), encoding="utf8")
    (inbox / "blank.csv").write_text("\n\n")
    (inbox / "line.csv").write_text("\n")
    whole = hashes(spark, inbox)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines_read = landing.list_files(spark, str(inbox), "a.csv").load(spark.read.format("text"))
        assert lines_read.rdd.getNumPartitions() > 5
        assert hashes(spark, inbox) == whole
        ledger = by_name(imports.import_files(store, listing(spark, inbox, "a.csv"), ATTESTATION, "ann"))
        assert (ledger["a.csv"]["status"], ledger["a.csv"]["inserted_rows"]) == (messages.IMPORTED, 1200)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert whole.pop("copy.csv") == whole["a.csv"]
    assert len(set(whole.values())) == len(whole) and all(len(h) == 64 for h in whole.values())
    assert by_name(imports.import_files(store, listing(spark, inbox, "copy.csv"), ATTESTATION, "ann")) == {}


def test_sums_of_lines_against_python_numbers(spark):
    """Powers and sums modulo the prime, and the shift of a block to its place."""
    places = [0, 1, 255, 256, 70000, 2**31, 2**33 - 1]
    rows = [("f", 0, p, f"line {p}") for p in places]
    df = spark.createDataFrame(rows, "_file string, _block long, _place long, value string")
    seeds = [F.xxhash64(F.lit(s), "value").alias(f"h{s}") for s in fingerprint.SEEDS]
    hashed = {r["_place"]: r for r in df.select("_place", *seeds).collect()}
    got = fingerprint.block_sums(df).first()
    for i, seed in enumerate(fingerprint.SEEDS):
        want = sum(hashed[p][f"h{seed}"] % fingerprint.PRIME * pow(fingerprint.BASE, p, fingerprint.PRIME) for p in places)
        assert got[f"s{i}"] == want % fingerprint.PRIME
    assert (got["first"], got["n"], got["head"]) == (0, len(places), "line 0")


def test_files_left_out_are_joined_away(spark, store, inbox):
    """A folder is read as a whole: old files take no part, whatever their number."""
    for i in range(5):
        put(inbox, f"old{i}.csv", f"1.4.2026,{i},А,1,да")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    put(inbox, "new.csv", "1.4.2026,9,А,1,да", "1.4.2026,3,А,1,да")
    ledger = by_name(imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann"))
    assert set(ledger) == {"new.csv"}
    assert (ledger["new.csv"]["inserted_rows"], ledger["new.csv"]["skipped_rows"]) == (1, 1)
    assert store.table("attestation").count() == 6


def test_work_folder_must_be_shared_on_a_cluster(monkeypatch):
    from sluicegate import session

    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Cluster, Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Session, "x")


def test_free_load_infers_and_overrides(spark, store, inbox):
    put(inbox, "f.csv", "1,1.5,2026-01-01,,012345678901,x", "2,2,2026-01-02,,012345678902,y",
        "2,2,2026-01-02,,012345678902,y", head="id,rate,day,blank,code,Id")
    seen = []
    ledger = by_name(imports.import_free(
        store, listing(spark, inbox), "my[table]", "bob",
        overrides={"code": {"type": "NVARCHAR(255)", "name": "card]"}}, on_contract=seen.append))
    assert [(f.name, f.type) for f in seen[0].fields] == [
        ("id", "INT"), ("rate", "FLOAT"), ("day", "DATE"), ("card_", "NVARCHAR(255)"), ("Id_5", "NVARCHAR(255)")]
    assert (ledger["f.csv"]["inserted_rows"], ledger["f.csv"]["skipped_rows"], ledger["f.csv"]["error_rows"]) == (2, 1, 0)
    rows = store.table("my_table_").orderBy("id").collect()
    assert rows[0]["card_"] == "012345678901" and str(rows[1]["day"]) == "2026-01-02"


def test_flows_have_separate_ledgers(spark, store, inbox):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да")
    imports.import_files(store, listing(spark, inbox), ATTESTATION, "ann")
    assert imports.import_free(store, listing(spark, inbox), "other", "ann").count() == 1


def test_existing_table_with_other_columns_is_refused(spark, store, inbox):
    put(inbox, "a.csv", "1", head="x")
    imports.import_free(store, listing(spark, inbox, "a.csv"), "t", "bob")
    put(inbox, "b.csv", "1", head="y")
    with pytest.raises(ValueError, match="do not match"):
        imports.import_free(store, listing(spark, inbox, "b.csv"), "t", "bob")


def test_workbook_folder(spark, store, inbox):
    write_workbook(inbox / "a.xlsx", [
        [" дата ", "ИИН", "ФИ", "Доп. Балл", "Подтверждение", "Лишний"],
        [(46113, "date"), "inline:123", "Анна & Co", 12.5, "да", 1],
        [None, None, None, None, None, None],
        ["1.4.2026", 77, "Б", None, True, 2]])
    write_workbook(inbox / "b.xlsx", [["ИИН"], ["1"]])
    write_workbook(inbox / "c.xlsx", [["ИИН"]])
    (inbox / "d.xlsx").write_bytes(b"this is not a workbook")
    ledger = by_name(imports.import_files(store, listing(spark, inbox, "*.xlsx"), ATTESTATION, "ann", fmt="xlsx"))
    assert (ledger["a.xlsx"]["total_rows"], ledger["a.xlsx"]["inserted_rows"]) == (2, 2)
    assert {ledger[n]["status"] for n in ("b.xlsx", "c.xlsx", "d.xlsx")} == {messages.REJECTED}
    assert "missing required columns" in ledger["b.xlsx"]["notes"]
    assert "unreadable" in ledger["d.xlsx"]["notes"]
    rows = {r["_row_number"]: r for r in store.table("attestation").collect()}
    assert set(rows) == {2, 4}
    assert (str(rows[2]["exam_date"]), rows[2]["iin"], rows[2]["full_name"], rows[2]["bonus_score"]) == (
        "2026-04-01", "123", "Анна & Co", 12.5)
    assert (rows[4]["iin"], rows[4]["confirmed"]) == ("77", "true")


def test_workbook_repeated_headers(spark, inbox):
    write_workbook(inbox / "a.xlsx", [["x", "x", None, "y"], ["1", "2", "3", "4"]])
    rows = workbooks.scan_workbooks(landing.list_files(spark, str(inbox)))
    got = workbooks.sheet_table(rows).drop(landing.FILE).collect()[0].asDict()
    assert got == {"row_number": 2, "x": "1", "x_1": "2", "y": "4"}


def test_a_workbook_over_two_gigabytes_is_read(spark, tmp_path):
    """An archive may follow other bytes; here a hole, which takes no disk."""
    write_workbook(tmp_path / "small.xlsx", [["x", "y"], ["1", "2"], [None, "3"]])
    os.makedirs(tmp_path / "big")
    with open(tmp_path / "big" / "a b%20c.xlsx", "wb") as out:
        out.truncate(2200 << 20)
        out.seek(0, os.SEEK_END)
        out.write((tmp_path / "small.xlsx").read_bytes())
    rows = workbooks.scan_workbooks(landing.list_files(spark, str(tmp_path / "big")))
    got = workbooks.sheet_table(rows).drop(landing.FILE).collect()
    assert sorted(map(tuple, got)) == [(2, "1", "2"), (3, None, "3")]


def test_memory_does_not_follow_the_rows(tmp_path):
    def peak(rows):
        write_workbook(tmp_path / "w.xlsx", [["x", "y"], *[[f"inline:{i}", i] for i in range(rows)]])
        tracemalloc.start()
        with workbooks.open_by_range(str(tmp_path / "w.xlsx")) as stream:
            assert sum(1 for _ in workbooks._file_rows("w", stream, False)) == rows + 1
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(20000) < 1.2 * peak(2000)


def test_limits_and_damage_reject_a_file(spark, inbox):
    write_workbook(inbox / "a.xlsx", [["x"], *[[f"text {i}"] for i in range(3000)]])
    whole = (inbox / "a.xlsx").read_bytes()
    middle = whole.index(b"first.xml") + 200
    (inbox / "b.xlsx").write_bytes(whole[:middle] + bytes(300) + whole[middle + 300:])
    files = landing.list_files(spark, str(inbox))

    def problems(**limits):
        found = workbooks.sheet_problems(workbooks.scan_workbooks(files, **limits)).collect()
        return {r[landing.FILE].rsplit("/", 1)[1]: r["problem"] for r in found}

    assert set(problems()) == {"b.xlsx"}
    assert "shared strings" in problems(max_strings=1000)["a.xlsx"]
    assert "allowed size" in problems(max_unpacked=1000)["a.xlsx"]
    assert problems(max_bytes=100) == dict.fromkeys(["a.xlsx", "b.xlsx"], "the file is over the size limit")


def test_landing_stream_takes_each_file_once(spark, store, inbox, tmp_path):
    put(inbox, "a.csv", "1.4.2026,1,А,1,да")
    put(inbox, "b.csv", "2.4.2026,2,Б,1,да")

    def run():
        start_landing(store, str(inbox), ATTESTATION, "ann", str(tmp_path / "state"), "s1",
                      files_per_batch=1).awaitTermination()

    run()
    assert store.table("attestation").count() == 2
    run()
    put(inbox, "c.csv", "2.4.2026,2,Б,1,да", "3.4.2026,3,В,1,да")
    put(inbox, "a-again.csv", "1.4.2026,1,А,1,да")
    run()
    assert store.table("attestation").count() == 3
    assert store.batches().filter(F.col("status") == messages.IMPORTED).count() == 3


def test_row_numbers_over_many_blocks(spark, tmp_path):
    lines = "\n".join(f"{i},text {i}" for i in range(20000))
    os.makedirs(tmp_path / "big")
    for name in ("one.csv", "two.csv"):
        (tmp_path / "big" / name).write_text(f"id,t\n{lines}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        staged = landing.stage(landing.scan(landing.list_files(spark, str(tmp_path / "big"))), str(tmp_path / "staged"))
        assert staged.select(landing.FILE, landing.BLOCK).distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    numbered = landing.number_rows(staged)
    assert numbered.count() == 40000
    assert numbered.filter(F.col("id").cast("long") + 2 != F.col("row_number")).count() == 0


def test_files_with_other_headers_are_not_shifted(spark, tmp_path):
    os.makedirs(tmp_path / "mix")
    (tmp_path / "mix" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "mix" / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception):
        landing.scan(landing.list_files(spark, str(tmp_path / "mix"))).collect()


def test_empty_input_raises(spark, tmp_path):
    os.makedirs(tmp_path / "e")
    (tmp_path / "e" / "a.csv").write_text("x,y\n")
    with pytest.raises(landing.EmptyInput):
        landing.require_rows(landing.scan(landing.list_files(spark, str(tmp_path / "e"))), "no rows")


def test_rows_of_a_large_file_stay_where_they_are_read(spark, store, inbox):
    for name in ("a.csv", "b.csv"):
        put(inbox, name, *[f"{name}{i},{i * 7919 % 100_003},x{i * 104_729 % 1_000_003}" for i in range(30_000)], head="k,n,t")
    files = listing(spark, inbox)
    plan = imports.plan_files(store, files, "free", ",")
    # Parsed rows are larger than this, header records and offsets are smaller.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        rows, _ = imports.read_landing(store, files, plan, "csv", None)
        assert rows.count() == 60_000
        joins = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins and "ShuffledHashJoin" not in joins
    assert rows.agg(F.min("row_number"), F.max("row_number")).first()[:] == (2, 30_001)


def test_lines_of_files_are_summed_without_a_sort(spark, tmp_path):
    """The width of a file comes from numbers of its lines: with a text among them all lines were sorted."""
    (tmp_path / "a.csv").write_text("x,y,z\n" + "1,2,3,4\n" * 50)
    (tmp_path / "b.csv").write_text("x\n1,2\n")
    found = fingerprint_files(listing(spark, tmp_path), ",")
    assert {r["file_name"]: r["width"] for r in found.collect()} == {"a.csv": 3, "b.csv": 1}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_are_judged_in_one_look_at_the_row_before(spark):
    """A load is not counted apart from its hashes, and equal rows are ranked by the row before them only."""
    contract = Contract("t", "T", "t", (Field("A", "a", "NVARCHAR(9)"),))
    rows = spark.createDataFrame(
        [("f1", 2, "x"), ("f1", 3, "x"), ("f2", 2, "x"), ("f2", 3, "y"), ("f2", 4, "z"), ("f2", 5, "z"), ("f2", 6, None), ("f3", 2, None)],
        "_file string, row_number long, A string")
    target = spark.createDataFrame([("y",), ("z",), ("z",)], "a string")
    judged = imports.classify(rows, contract, target)
    assert {(r["_file"], r["row_number"]): r["outcome"] for r in judged.collect()} == {
        ("f1", 2): ACCEPTED, ("f1", 3): DUP_IN_BATCH, ("f2", 2): DUP_IN_TARGET, ("f2", 3): DUP_IN_TARGET,
        ("f2", 4): DUP_IN_TARGET, ("f2", 5): DUP_IN_BATCH, ("f2", 6): ACCEPTED, ("f3", 2): DUP_IN_TARGET}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lag(") >= 2 and "row_number()" not in plan and "first(" not in plan
