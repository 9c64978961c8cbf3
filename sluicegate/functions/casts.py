"""Lenient casts: text in, typed value or NULL out, never an error.

All of them are native expressions.  Numbers pass a grammar check first, as Spark would
read ``5d`` as a double; dates are rebuilt into ISO form and cast, so neither the session
time zone nor the datetime parser policy has a say.

A cast has three steps: clean the text, parse it, adjust the value.  As a function of one
Column the steps are simply nested.  ``apply_casts`` gives each step its own Project: a step
mentions its input more than once, and Catalyst evaluates every mention unless it is a plain
column.  It takes a few columns per Project, because the JVM does not compile a generated
method over 8000 bytes, which makes one Project for all columns several times slower.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.functions.names import SPACES, quoted

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+$"
DAY_FIRST = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
_CLOCK = r"[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?"
ISO_DAY = rf"^(\d{{4}}-\d{{2}}-\d{{2}})({_CLOCK})?$"
ISO_ZONED = rf"^\d{{4}}-\d{{2}}-\d{{2}}{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})$"
SECONDS_PER_DAY = 86400
COLUMNS_PER_STEP = 4
LONG_LIMIT = 4.0e18  # doubling stays inside 64 bits
LAST_SERIAL_DAY = 2958465


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _begins_inside(c: Column) -> Column:
    """The first character lies between the white-space code points below U+1680."""
    return ((c >= "!") & (c < "\u00a0")) | ((c >= "\u00a1") & (c < "\u1680"))


def trimmed(c: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank.

    Trimming a set of characters walks the whole text, so text with a visible character at
    both ends is passed through.
    """
    clean = _begins_inside(c) & _begins_inside(F.substring(c, -1, 1))
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(SPACES)))


def is_filled(c: Column) -> Column:
    """True when the cell holds something besides white space."""
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def _same(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class Cast:
    clean: Callable[[Column], Column] = _same
    parse: Callable[[Column], Column] = _same
    adjust: Callable[[Column], Column] = _same

    def __call__(self, c: Column) -> Column:
        return self.adjust(self.parse(self.clean(c)))


def apply_casts(df: DataFrame, wanted: Mapping[str, tuple[Cast, Column]],
                keep: Sequence[str] = ()) -> DataFrame:
    """Cast many columns: ``wanted`` maps the new name to a cast and its text column."""
    out = df.select(*[F.col(quoted(k)) for k in keep], *[raw.alias(n) for n, (_, raw) in wanted.items()])
    columns = list(wanted)
    for start in range(0, len(columns), COLUMNS_PER_STEP):
        group = set(columns[start:start + COLUMNS_PER_STEP])
        for step in ("clean", "parse", "adjust"):
            out = out.select(*[
                getattr(wanted[c][0], step)(F.col(quoted(c))).alias(c) if c in group else F.col(quoted(c))
                for c in [*keep, *columns]])
    return out


def _no_spaces(c: Column) -> Column:
    return F.translate(c, SPACES, "")


def _first_replaced(c: Column, mark: str, by: str) -> Column:
    """Replace the first ``mark`` only."""
    return F.concat_ws(by, F.split(c, mark, 2))


def _clean_int(c: Column) -> Column:
    """Drop white space, turn the first comma into a point; plain numbers pass through."""
    return F.when(c.rlike(NUMBER), c).otherwise(_first_replaced(_no_spaces(c), ",", "."))


def _clean_float(c: Column) -> Column:
    """As for whole numbers, with the first percent sign dropped."""
    bare = _first_replaced(_no_spaces(c), "%", "")
    return F.when(c.rlike(NUMBER), c).otherwise(_first_replaced(bare, ",", "."))


def parse_number(text: Column) -> Column:
    """Double from plain decimal or scientific notation, else NULL; may be infinite."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _parse_decimal(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("decimal(10,2)"))


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def round_half_up(value: Column) -> Column:
    """Round towards plus infinity at .5, so -2.5 gives -2 (doubling a double is exact)."""
    return F.ceil(F.floor(value * 2) / 2)


def _to_int(value: Column) -> Column:
    """Beyond 32 bits -> NULL."""
    return round_half_up(value).try_cast("int")


def _parse_long(text: Column) -> Column:
    """Whole numbers keep every digit; others go through the double."""
    rounded = round_half_up(parse_number(text))
    return F.when(text.rlike(WHOLE), text.try_cast("bigint")).otherwise(
        F.when(F.abs(rounded) < LONG_LIMIT, rounded))


def _zoned_day(text: Column) -> Column:
    """UTC day of a date-time with a zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(text.try_cast("timestamp")) / SECONDS_PER_DAY).cast("int"))


def parse_iso(text: Column) -> Column:
    dashed = F.substring(text, 5, 1) == "-"  # spares other text the patterns
    return (
        F.when(dashed & text.rlike(ISO_DAY), F.substring(text, 1, 10).try_cast("date"))
        .when(dashed & text.rlike(ISO_ZONED), _zoned_day(text))
    )


def _parse_day_first(text: Column) -> Column:
    """``D.M.YYYY`` or one of the ISO forms; anything else is NULL."""
    turned = F.regexp_replace(text, DAY_FIRST, "$3-$2-$1")
    return parse_iso(text).when(text.rlike(DAY_FIRST), turned.try_cast("date"))


contract_int = Cast(_clean_int, parse_number, _to_int)  # " 1 234,5 " -> 1235
contract_float = Cast(_clean_float, parse_number, _finite)  # one % dropped, no division
contract_decimal = Cast(_clean_float, _parse_decimal)
contract_date = Cast(trimmed, _parse_day_first)
free_int = Cast(trimmed, parse_number, _to_int)
free_long = Cast(trimmed, _parse_long)
free_float = Cast(trimmed, parse_number, _finite)
free_date = Cast(trimmed, parse_iso)


contract_text = Cast(lambda c: trimmed(null_if_empty(c)))
free_text = Cast(null_if_empty)
# Truth of a text cell: any filled text counts, even "0".
free_bit = Cast(null_if_empty, lambda c: F.when(c.isNotNull(), F.lit(1)))
legacy_date = free_date
legacy_score = free_float  # keep the text beside it to tell blank from unreadable
legacy_text = Cast(lambda c: F.coalesce(trimmed(c), F.lit("")))


def number_bit(c: Column) -> Column:
    """Truth of a numeric cell: zero is false."""
    return F.when(c.isNotNull(), F.when(c != 0, F.lit(1)).otherwise(F.lit(0)))


def serial_date(c: Column) -> Column:
    """Date of a spreadsheet day number.

    Day 1 is 1900-01-01.  Spreadsheets count a 29 February 1900 that never was, hence the
    other origin after day 60.
    """
    day = F.floor(c.cast("double")).cast("int")
    origin = F.when(day <= 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("date")
    return F.when((c >= 0) & (c < LAST_SERIAL_DAY + 1), F.date_add(origin, day))


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def contract_cast(type_text: str) -> Cast:
    name = type_text.strip().upper()
    if name.startswith("DECIMAL"):
        return contract_decimal
    return {"INT": contract_int, "FLOAT": contract_float, "DATE": contract_date}.get(name, contract_text)


def free_cast(type_text: str) -> Cast:
    return {
        "INT": free_int, "BIGINT": free_long, "FLOAT": free_float, "DATE": free_date, "BIT": free_bit,
    }.get(type_text.strip().upper(), free_text)
