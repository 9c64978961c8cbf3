"""Row validation: rules produce error structs, errors leave as one long table.

A rule is a Column of ``array<struct<field_name, error_message>>`` that is empty when the
row passes.  All rules of a batch are concatenated in one Project; no rule shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate import messages
from sluicegate.functions import casts

ERRORS = "errors"
ERROR_TYPE = "array<struct<field_name:string,error_message:string>>"
# Fixed value: the e-mail shape, one @ and a dot in the domain, no blanks.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
EXPLODE_CHUNK = 100_000


def _none() -> Column:
    return F.array().cast(ERROR_TYPE)


def error_if(broken: Column, field: str, message: str) -> Column:
    """One error where ``broken`` is true, no error elsewhere."""
    error = F.struct(F.lit(field).alias("field_name"), F.lit(message).alias("error_message"))
    return F.when(broken, F.array(error)).otherwise(_none())


def required(field: str, value: Column, message: str = messages.REQUIRED) -> Column:
    blank = F.coalesce(F.length(value.cast("string")) == 0, F.lit(True))
    return error_if(blank, field, message.format(field=field))


def matches(field: str, value: Column, pattern: str, message: str) -> Column:
    """Shape check that leaves blank cells to ``required``."""
    filled = F.length(value) > 0
    return error_if(filled & ~value.rlike(pattern), field, message)


def email_shape(field: str, value: Column) -> Column:
    return matches(field, value, EMAIL, messages.BAD_EMAIL)


def parsed(field: str, value: Column, message: str) -> Column:
    """The cast value must exist; blank and malformed cells both fail."""
    return error_if(value.isNull(), field, message)


def whole_between(field: str, raw: Column, value: Column, low: float, high: float,
                  message: str) -> Column:
    """A filled cell must hold a whole number in range; unreadable text fails here too."""
    good = (value >= low) & (value <= high) & (F.floor(value) == value)
    return error_if(casts.is_filled(raw) & ~F.coalesce(good, F.lit(False)), field, message)


def between(field: str, value: Column, low: float, high: float, message: str) -> Column:
    return error_if(~value.between(low, high), field, message)


def one_of(field: str, value: Column, allowed: Sequence[str], message: str) -> Column:
    return error_if(~value.isin(*allowed), field, message)


def digits(field: str, value: Column, count: int, message: str) -> Column:
    return matches(field, value, rf"^\d{{{count}}}$", message)


def within_length(field: str, value: Column, limit: int, message: str) -> Column:
    """Over-long text is a row error, so that it cannot fail the whole batch on write."""
    return error_if(F.length(value) > limit, field, message)


def validate(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Add ``errors``: the broken rules of each row, in rule order."""
    return df.withColumn(ERRORS, F.concat(_none(), *rules))


def is_valid() -> Column:
    return F.size(ERRORS) == 0


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(is_valid()).drop(ERRORS)


def invalid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(~is_valid())


def error_table(validated: DataFrame, *keys: str) -> DataFrame:
    """One line per broken rule: keys, field_name, error_message."""
    lines = validated.select(*keys, F.explode(ERRORS).alias("e"))
    return lines.select(*keys, "e.field_name", "e.error_message")


def expand_occurrences(errors: DataFrame, count: str = "occurrences") -> DataFrame:
    """Repeat each line ``count`` times.

    Two steps, so that one line with a huge count neither builds a huge array nor stays in
    one task: first one line per chunk, spread over the cluster, then the chunk itself.
    """
    last = (F.ceil(F.col(count) / EXPLODE_CHUNK) - 1).cast("int")
    left = F.col(count) - F.col("_chunk") * EXPLODE_CHUNK
    chunks = (
        errors.filter(F.col(count) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("_size", F.least(F.lit(EXPLODE_CHUNK), left).cast("int"))
        .repartition(F.xxhash64(*errors.columns, "_chunk"))
    )
    repeated = chunks.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_size"))))
    return repeated.drop("_chunk", "_size", "_n", count)
