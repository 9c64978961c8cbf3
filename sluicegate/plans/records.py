"""Validated training records: clean, check, find duplicates, look up the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate import messages
from sluicegate.contracts import ContractError
from sluicegate.functions import casts, names
from sluicegate.operators import dedup, validate
from sluicegate.registry import RECORD_COLUMNS, RECORD_KEY

TEXT_COLUMNS = ("employee_id", "full_name", "email", "course_code", "course_name")


def normalize_records(raw: DataFrame, *keep: str) -> DataFrame:
    """Text columns trimmed (blank stays ""), date and score cast, raw score kept beside."""
    by_key = {names.header_key(c): c for c in raw.columns}
    missing = [c for c in RECORD_COLUMNS if c not in by_key]
    if missing:
        raise ContractError(f"missing required columns: {', '.join(missing)}")

    def cell(name: str) -> Column:
        return F.col(names.quoted(by_key[name])).cast("string")

    wanted = {c: (casts.legacy_text, cell(c)) for c in TEXT_COLUMNS}
    wanted["completion_date"] = (casts.legacy_date, cell("completion_date"))
    wanted["score"] = (casts.legacy_score, cell("score"))
    wanted["score_text"] = (casts.Cast(casts.trimmed), cell("score"))
    return casts.apply_casts(raw, wanted, keep)


def record_rules() -> list[Column]:
    """Required cells in column order, then shape, date and range."""
    cells = {c: F.col(c) for c in RECORD_COLUMNS} | {"score": F.col("score_text")}
    return [
        *[validate.required(c, cells[c]) for c in RECORD_COLUMNS],
        validate.email_shape("email", F.col("email")),
        validate.parsed("completion_date", F.col("completion_date"), messages.BAD_DATE),
        validate.whole_between("score", F.col("score_text"), F.col("score"), 0, 100, messages.BAD_SCORE),
    ]


def check_records(raw: DataFrame, target: DataFrame, row: str, scope: Sequence[str] = ()) -> DataFrame:
    """Records with all their errors as ``errors``, plus ``duplicate_errors`` (a count).

    ``row`` numbers the rows within ``scope`` (the file column, when there are several).

    Duplicates by key reject every copy.  A key already in the target, looked up for rows
    without errors, is an error on every row that carries it.
    """
    checked = validate.validate(normalize_records(raw, *scope, row), record_rules())
    complete = (F.col("employee_id") != "") & (F.col("course_code") != "") & F.col("completion_date").isNotNull()
    # Rows without a full key share no key with any other: their own number tells them apart.
    alone = F.when(~complete, F.col(row))
    flagged = dedup.flag_copies(checked.withColumn("_alone", alone), [*scope, *RECORD_KEY, "_alone"], [row])
    copies = F.when(F.col(dedup.IS_FIRST), F.col(dedup.LATER_COPIES)).otherwise(F.lit(1)).cast("long")
    counted = flagged.withColumn("duplicate_errors", copies)
    # A clean row is the only one with its key, so looking up clean rows covers every row
    # that carries a found key.
    clean = validate.is_valid() & (F.col("duplicate_errors") == 0)
    known = dedup.mark_in_target(counted, target, RECORD_KEY, "_known", when=clean)
    exists = validate.error_if(F.col("_known"), messages.DUPLICATE_FIELD, messages.RECORD_EXISTS)
    return known.withColumn(validate.ERRORS, F.concat(validate.ERRORS, exists)).drop(
        "_alone", "_known", dedup.IS_FIRST, dedup.LATER_COPIES)


def record_errors(checked: DataFrame, *keys: str) -> DataFrame:
    """The error ledger of a batch: one line per error, duplicates repeated as counted."""
    copies = validate.error_if(
        F.col("duplicate_errors") > 0, messages.DUPLICATE_FIELD, messages.DUPLICATE_IN_FILE)
    lines = checked.select(*keys, "duplicate_errors", F.explode(F.concat(validate.ERRORS, copies)).alias("e"))
    repeated = F.when(F.col("e.error_message") == messages.DUPLICATE_IN_FILE, F.col("duplicate_errors"))
    return validate.expand_occurrences(lines.select(
        *keys, "e.field_name", "e.error_message", F.coalesce(repeated, F.lit(1)).alias("occurrences")))


def accepted_records(checked: DataFrame, *keys: str) -> DataFrame:
    good = checked.filter(validate.is_valid() & (F.col("duplicate_errors") == 0))
    return good.select(*keys, *[c for c in RECORD_COLUMNS if c != "score"], F.col("score").cast("int").alias("score"))
