"""Truth tables of the lenient casts, nested and staged."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from sluicegate.functions import casts, names, text

D = dt.date
CASES = [
    ("contract_int", "1 234,5", 1235), ("contract_int", "-2.5", -2), ("contract_int", "2.5", 3),
    ("contract_int", "1,234.5", None), ("contract_int", "abc", None), ("contract_int", "", None),
    ("contract_int", None, None), ("contract_int", "   ", None), ("contract_int", "5d", None),
    ("contract_int", "0x10", None), ("contract_int", "123456789012", None), ("contract_int", "1e3", 1000),
    ("contract_int", "2147483647.4", 2147483647), ("contract_int", "2147483647.5", None),
    ("contract_int", "-2147483648.5", -2147483648), ("contract_int", "1e300", None), ("contract_int", "1e999", None),
    ("contract_int", "0.49999999999999994", 0), ("contract_int", "12%", None), ("contract_int", "NaN", None),
    ("contract_float", "12,5%", 12.5), ("contract_float", "1 000.25", 1000.25), ("contract_float", "1,2,3", None),
    ("contract_float", "5%%", None), ("contract_float", "1e999", None), ("contract_float", ".5", 0.5),
    ("contract_float", "Infinity", None), ("contract_float", "7.", 7.0),
    ("contract_decimal", "12,5%", "12.50"), ("contract_decimal", "2500.455", "2500.46"),
    ("contract_decimal", "123456789012", None), ("contract_decimal", "1e3", "1000.00"),
    ("contract_date", "1.4.2026", D(2026, 4, 1)), ("contract_date", " 01.04.2026 ", D(2026, 4, 1)),
    ("contract_date", "31.02.2026", None), ("contract_date", "2026-04-01", D(2026, 4, 1)),
    ("contract_date", "04/01/2026", None), ("contract_date", "45000", None), ("contract_date", "", None),
    ("contract_date", "2026-04-01T23:30:00-02:00", D(2026, 4, 2)), ("contract_date", "2026-04-01 10:00", D(2026, 4, 1)),
    ("contract_date", "2026-04-01T25:00", None), ("contract_date", "2026-13-01", None),
    ("contract_text", "\u00a0a", "a"), ("contract_text", "   ", ""), ("contract_text", "", None),
    ("contract_text", " \u2003Ъ ъ\ufeff", "Ъ ъ"), ("contract_text", "漢\u3000", "漢"),
    ("free_text", " a ", " a "), ("free_text", "", None),
    ("free_int", "1 234", None), ("free_int", " 12 ", 12), ("free_int", "12,5", None),
    ("free_long", "9007199254740993", 9007199254740993), ("free_long", "123456789012", 123456789012),
    ("free_long", "-1.5", -1), ("free_long", "99999999999999999999", None), ("free_long", "x", None),
    ("free_float", "1.5", 1.5), ("free_float", "1,5", None), ("free_date", "1.4.2026", None),
    ("free_date", "2026-04-01", D(2026, 4, 1)), ("free_bit", "0", 1), ("free_bit", "", None), ("free_bit", None, None),
    ("legacy_text", None, ""), ("legacy_text", " a ", "a"), ("legacy_score", "abc", None), ("legacy_score", "88", 88.0),
]


def test_truth_table(spark):
    rows = [(i, name, value) for i, (name, value, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, v string").repartition(2)
    kinds = sorted({name for name, _, _ in CASES})
    staged = casts.apply_casts(df, {k: (getattr(casts, k), F.col("v")) for k in kinds}, keep=["i", "name"])
    nested = df.select("i", "name", *[getattr(casts, k)(F.col("v")).alias(k) for k in kinds])
    for got in (staged, nested):
        wrong = []
        for r in got.collect():
            name, value, expected = CASES[r["i"]]
            if isinstance(expected, str) and name == "contract_decimal":
                expected = decimal.Decimal(expected)
            if r[name] != expected:
                wrong.append((name, value, r[name], expected))
        assert not wrong


def test_serial_dates_and_bits(spark):
    df = spark.createDataFrame([(45000.0,), (1.0,), (60.0,), (61.0,), (45000.99,), (-1.0,), (3e9,), (None,)], "n double")
    got = [r[0] for r in df.select(casts.serial_date(F.col("n"))).collect()]
    assert got == [D(2023, 3, 15), D(1900, 1, 1), D(1900, 3, 1), D(1900, 3, 1), D(2023, 3, 15), None, None, None]
    bits = spark.createDataFrame([(0.0,), (2.0,), (None,)], "n double").select(casts.number_bit(F.col("n"))).collect()
    assert [r[0] for r in bits] == [0, 1, None]


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2026-04-01T23:30:00-02:00",), ("2026-04-01T00:30:00",)], "v string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Almaty")
    try:
        got = [r[0] for r in df.select(casts.contract_date(F.col("v"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [D(2026, 4, 2), D(2026, 4, 1)]


@pytest.mark.parametrize("raw, expected", [
    ("Щука Ёж.xlsx", "Shchuka_Yozh"), ("a/b/Отчёт за май.2026.xlsx", "Otchyot_za_may.2026"), (".xlsx", ".xlsx"),
    ("[x].csv", "_x_"), ("  .csv", "import"), ("объём", "obyom"), ("noext", "noext")])
def test_table_names(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "v string").select(text.table_name_from_path(F.col("v"))).first()[0]
    assert got == expected


def test_identifiers_and_mojibake(spark):
    df = spark.createDataFrame([(" a[b]\x00c ", "Отчёт".encode().decode("latin-1")), ("", "naïve"), (None, "漢"),
                                ("x" * 200, "plain")], "a string, b string")
    got = df.select(text.sanitize_identifier(F.col("a")), text.repair_mojibake(F.col("b"))).collect()
    assert [r[0] for r in got] == ["a_b__c", "col", "col", "x" * 128]
    assert [r[1] for r in got] == ["Отчёт", "naïve", "漢", "plain"]
    for raw in (" a[b]\x00c ", "", None, "x" * 200):
        one = spark.createDataFrame([(raw,)], "a string").select(text.sanitize_identifier(F.col("a"))).first()[0]
        assert names.sanitize_name(raw) == one


def test_unique_names():
    assert names.unique_names(["a", "A", "a_1", "b"]) == ["a", "A_1", "a_1_2", "b"]
    assert [h for h in ["a", " ", "__EMPTY_3", "_c2", "_c"] if names.is_named(h)] == ["a", "_c"]
