"""Duplicate operators against brute force, and the plans they must keep."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sluicegate.operators import changes, dedup, reports, validate
from sluicegate.plans import imports, records
from sluicegate.plans.outcomes import OUTCOME, assign_outcomes
from sluicegate.contracts import Contract, Field

ROWS = "n long, a string, b double"


def brute_flags(rows):
    groups = defaultdict(list)
    for n, a, b in rows:
        groups[(a, b)].append(n)
    return {n: (n == min(g), len(g) - 1 if n == min(g) else 0) for g in groups.values() for n in g}


def hot_rows(count=3000, seed=1):
    rnd = random.Random(seed)
    return [(i, *(("hot", None) if rnd.random() < 0.4 else (rnd.choice(["x", "y", None]), float(rnd.randrange(200)))))
            for i in range(count)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_flag_copies_matches_brute_force_with_a_hot_key(spark, partitions):
    rows = hot_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(partitions)
    got = {r["n"]: (r["is_first"], r["later_copies"]) for r in dedup.flag_copies(df, ["a", "b"], ["n"]).collect()}
    assert got == brute_flags(rows)
    kept = {r["n"] for r in dedup.first_copies(df, ["a", "b"], ["n"]).collect()}
    assert kept == {n for n, (first, _) in got.items() if first}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "", None]), st.sampled_from([1.0, -0.0, 0.0, None])), min_size=1, max_size=40))
def test_flag_copies_on_random_rows(spark, pairs):
    rows = [(i, a, 0.0 if b == 0 else b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], ROWS).repartition(3)
    got = {r["n"]: (r["is_first"], r["later_copies"]) for r in dedup.flag_copies(df, ["a", "b"], ["n"]).collect()}
    assert got == brute_flags(rows)


def test_identical_rows_leave_exactly_one(spark):
    df = spark.createDataFrame([("k", 1)] * 500, "a string, v int").repartition(7)
    flags = dedup.flag_copies(df, ["a", "v"], ["a", "v"])
    assert flags.filter("is_first").count() == 1
    assert flags.agg(F.sum("later_copies")).first()[0] == 499


def test_error_count_is_two_per_extra_copy(spark):
    rows = hot_rows()
    sizes = defaultdict(int)
    for _, a, b in rows:
        if a is not None and b is not None:
            sizes[(a, b)] += 1
    rejected = dedup.reject_copies(spark.createDataFrame(rows, ROWS).repartition(5), ["a", "b"], ["n"])
    assert rejected.agg(F.sum("occurrences")).first()[0] == sum(2 * (k - 1) for k in sizes.values())
    assert rejected.count() == sum(k for k in sizes.values() if k > 1)


def test_expand_occurrences(spark, monkeypatch):
    monkeypatch.setattr(validate, "EXPLODE_CHUNK", 10)
    lines = spark.createDataFrame([("a", 1), ("b", 10), ("c", 25), ("d", 0)], "k string, occurrences long")
    got = {r["k"]: r["count"] for r in validate.expand_occurrences(lines).groupBy("k").count().collect()}
    assert got == {"a": 1, "b": 10, "c": 25}


def test_target_compare_is_null_safe(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "y", -0.0), (4, "z", 1.0)], ROWS)
    target = spark.createDataFrame([(9, "x", None), (9, "x", None), (9, None, None), (9, "y", 0.0)], ROWS)
    assert [r["n"] for r in dedup.not_in_target(rows, target, ["a", "b"]).collect()] == [4]
    marked = dedup.mark_in_target(rows, target, ["a", "b"], "known", when=F.col("n") > 1).orderBy("n").collect()
    assert [r["known"] for r in marked] == [False, True, True, False]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops_and_no_python(spark):
    rows = spark.createDataFrame(hot_rows(), ROWS)
    for df in (dedup.not_in_target(rows, rows, ["a", "b"]), dedup.flag_copies(rows, ["a", "b"], ["n"]),
               assign_outcomes(rows, F.col("b") > 3, ["a"], ["n"], rows, ["a", "b"])):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_first_copies_are_cut_before_the_shuffle(spark):
    plan = plan_of(dedup.first_copies(spark.createDataFrame(hot_rows(), ROWS), ["a", "b"], ["n"]))
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_hot_key_of_a_target_join_is_split(spark):
    """Adaptive execution may split a hot key, as a shuffle lies under both sides."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
        rows = spark.range(0, 200000, numPartitions=16).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        target = spark.range(0, 1000).select((F.col("id") - 1).alias("k"))
        marked = dedup.mark_in_target(rows, target, ["k"], "known")
        marked.write.format("noop").mode("overwrite").save()
        counted = marked.collect()
        assert "skew=true" in plan_of(marked)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["known"] for r in counted) == 66667 + 666


def test_outcomes_add_up_and_a_second_run_accepts_nothing(spark):
    rows = spark.createDataFrame(hot_rows(), ROWS)
    valid = F.coalesce(F.col("b") >= 20, F.lit(False))
    empty = rows.limit(0)
    first = assign_outcomes(rows, valid, ["a", "b"], ["n"], empty, ["a", "b"])
    counts = {r[OUTCOME]: r["row_count"] for r in reports.count_by(first, OUTCOME).collect()}
    assert sum(counts.values()) == 3000 and counts.get("dup_in_target", 0) == 0
    accepted = first.filter(F.col(OUTCOME) == "accepted").select("n", "a", "b")
    assert accepted.select("a", "b").distinct().count() == accepted.count()
    again = assign_outcomes(rows, valid, ["a", "b"], ["n"], accepted, ["a", "b"])
    repeat = {r[OUTCOME]: r["row_count"] for r in reports.count_by(again, OUTCOME).collect()}
    assert "accepted" not in repeat and repeat["dup_in_target"] == counts["accepted"]


def test_classify_follows_file_order(spark):
    """Brute force: files one after another, each checked against itself, then the target."""
    rnd = random.Random(3)
    rows = [(f"f{rnd.randrange(4)}", i, rnd.choice("abc"), str(rnd.randrange(6))) for i in range(400)]
    stored = [("a", 1), ("b", 5)]
    seen, expected = set(stored), {}
    for name in sorted({r[0] for r in rows}):
        own = set()
        for _, i, a, b in [r for r in rows if r[0] == name]:
            key = (a, int(b))
            expected[i] = "dup_in_batch" if key in own else "dup_in_target" if key in seen else "accepted"
            own.add(key)
        seen |= own
    contract = Contract("t", "t", "t", (Field("a", "a", "NVARCHAR(9)"), Field("b", "b", "INT")))
    df = spark.createDataFrame(rows, "_file string, row_number long, a string, b string").repartition(6)
    target = spark.createDataFrame(stored, "a string, b int")
    got = {r["row_number"]: r[OUTCOME] for r in imports.classify(df, contract, target).collect()}
    assert got == expected


@pytest.mark.parametrize("hot, bins, larger", [(10_000, 1 << 16, 4), (3, 2, 4), (25, 4, 0), (0, 2, 0)])
def test_classify_of_frequent_rows_and_large_targets(spark, monkeypatch, hot, bins, larger):
    """Outcomes are the same however many copies may meet, and however the target is looked up."""
    monkeypatch.setattr(imports, "HOT_COPIES", hot)
    monkeypatch.setattr(imports, "HASH_BINS", bins)
    monkeypatch.setattr(imports, "MUCH_LARGER", larger)
    rnd = random.Random(4)
    keys = [("a", 1.0)] * 20 + [("b", 0.0), ("b", -0.0), (None, None), (None, 2.0), ("c", None), ("d", 7.0), ("e", 9.0)]
    rows = [(f"f{rnd.randrange(3)}", i, *rnd.choice(keys)) for i in range(300)]
    stored = [("b", 0.0), (None, 2.0), ("z", 1.0), (None, 2.0)]
    seen, expected = set(stored), {}
    for name in sorted({r[0] for r in rows}):
        own = set()
        for _, i, a, b in [r for r in rows if r[0] == name]:
            if a == "e":
                expected[i] = "invalid"
                continue
            expected[i] = "dup_in_batch" if (a, b) in own else "dup_in_target" if (a, b) in seen else "accepted"
            own.add((a, b))
        seen |= own
    contract = Contract("t", "t", "t", (Field("a", "a", "NVARCHAR(9)"), Field("b", "b", "FLOAT")))
    df = spark.createDataFrame([(f, i, a, None if b is None else str(b)) for f, i, a, b in rows],
                               "_file string, row_number long, a string, b string").repartition(5)
    rules = [validate.error_if(F.coalesce(F.col("a") == "e", F.lit(False)), "a", "no e")]
    kind = {f.name: f.dataType.simpleString() for f in contract.schema()}
    target = spark.createDataFrame(stored, "a string, b double").select("a", F.col("b").cast(kind["b"]).alias("b"))
    got = imports.classify(df, contract, target, rules)
    assert {r["row_number"]: r[OUTCOME] for r in got.collect()} == expected
    assert got.count() == len(rows)


def test_classify_moves_the_rows_of_a_load_once(spark):
    contract = Contract("t", "t", "t", (Field("a", "a", "NVARCHAR(9)"), Field("b", "b", "INT")))
    df = spark.createDataFrame([("f", i, str(i % 50), "1") for i in range(100)], "_file string, row_number long, a string, b string")
    target = spark.createDataFrame([("3", 1)], "a string, b int")
    plan = imports.classify(df, contract, target)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


GOOD = ("E1", "Ann", "a@b.co", "C1", "Course", "2026-04-01", "90")


def test_record_checks(spark):
    rows = [
        (2, *GOOD),
        (3, "E2", "Bob", "bob", "C1", "Course", "not a date", "abc"),
        (4, "E3", "Cy", "c@d.ef", "C1", "Course", "2026-04-02", ""),
        (5, "E4", "Di", "d@d.ef", "C1", "Course", "2026-04-02", "50"),
        (6, "E4", "Di", "d@d.ef", "C1", "Course", "2026-04-02", "60"),
        (7, "E4", "Di", "d@d.ef", "C1", "Course", "2026-04-02", "70"),
        (8, "E5", "Ed", "e@d.ef", "C1", "Course", "2026-04-02", "100"),
        (9, "", "No", "n@d.ef", "C1", "Course", "2026-04-02", "101"),
        (10, "", "No", "n@d.ef", "C1", "Course", "2026-04-02", "1.5"),
    ]
    raw = spark.createDataFrame(rows, "row_number long, " + ", ".join(f"`{c.title()} ` string" for c in records.RECORD_COLUMNS))
    stored = spark.createDataFrame([("E5", "C1", "2026-04-02")], "employee_id string, course_code string, d string").select(
        "employee_id", "course_code", F.col("d").cast("date").alias("completion_date"))
    checked = records.check_records(raw, stored, "row_number")
    errors = defaultdict(list)
    for r in records.record_errors(checked, "row_number").collect():
        errors[r["row_number"]].append(r["field_name"])
    assert {n: sorted(e) for n, e in errors.items()} == {
        3: ["completion_date", "completion_date", "email", "score"], 4: ["score"],
        5: ["duplicate", "duplicate"], 6: ["duplicate"], 7: ["duplicate"], 8: ["duplicate"],
        9: ["employee_id", "score"], 10: ["employee_id", "score"]}
    assert [r["score"] for r in records.accepted_records(checked, "row_number").collect()] == [90]


def test_labels_and_roles(spark):
    labels = spark.createDataFrame([("a", "old", None, None, None)],
                                   "template_id string, display_name string, description string, updated_by string, updated_at timestamp")
    new = spark.createDataFrame([("a", " ", "d"), ("b", "B", "")], "template_id string, display_name string, description string")
    got = {r["template_id"]: (r["display_name"], r["description"]) for r in changes.save_labels(labels, new, "me").collect()}
    assert got == {"a": (None, "d"), "b": ("B", None)}


def test_top_n_falls_back(spark):
    df = spark.range(30).select(F.col("id").alias("b"), F.lit(1).alias("t"))
    for bad in (0, -1, 2.5, None, True, "7"):
        assert reports.recent_batches(df, "t", "b", bad).count() == 20
    assert [r["b"] for r in reports.recent_batches(df, "t", "b", 2).collect()] == [29, 28]
    assert reports.page_rows(df, ["b"], page=-3, page_size=5).count() == 5
