"""Text functions: transliteration, mojibake repair, identifiers, cell display."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from sluicegate.functions.casts import trimmed
from sluicegate.functions.names import IDENTIFIER_LIMIT, SPACES

# Cyrillic letters and their Latin spelling.  Upper-case letters follow by
# capitalising the spelling, so only the lower-case half is listed.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya",
}
CYRILLIC_TO_LATIN = CYRILLIC | {k.upper(): v.capitalize() for k, v in CYRILLIC.items()}

EMPTY_CELL = "—"
PREVIEW_WIDTH = 40
TABLE_WIDTH = 80


def transliterate(c: Column, mapping: Mapping[str, str] = CYRILLIC_TO_LATIN) -> Column:
    """Spell letters by ``mapping``; other characters stay.

    Letters with a spelling of one or no character go through a single ``translate``; the
    few longer ones are one ``replace`` each.
    """
    longer = {k: v for k, v in mapping.items() if len(v) > 1}
    single = {k: v for k, v in mapping.items() if len(v) == 1}
    dropped = [k for k, v in mapping.items() if not v]
    for letter, spelling in longer.items():
        c = F.replace(c, F.lit(letter), F.lit(spelling))
    return F.translate(c, "".join([*single, *dropped]), "".join(single.values()))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1.

    Text with wider characters, or whose bytes are not UTF-8, was not broken that way and
    is left alone.
    """
    narrow = F.when(c.rlike("^[\\x00-\\xFF]*$"), c)
    read_again = F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))
    return F.coalesce(read_again, c)


def sanitize_identifier(c: Column) -> Column:
    text = F.translate(trimmed(c), "[]\x00", "___")
    return F.coalesce(F.nullif(F.substring(text, 1, IDENTIFIER_LIMIT), F.lit("")), F.lit("col"))


def table_name_from_path(c: Column) -> Column:
    """Target name for a file: base name, no extension, Latin letters, no blanks."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    stem = trimmed(F.regexp_replace(base, r"(.)\.[^.]*$", "$1"))
    safe = F.translate(transliterate(stem), "[]\x00", "___")
    name = F.substring(F.regexp_replace(safe, f"[{SPACES}]+", "_"), 1, IDENTIFIER_LIMIT)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("import"))


def display_cell(c: Column, width: int = PREVIEW_WIDTH) -> Column:
    return F.coalesce(F.substring(c.cast("string"), 1, width), F.lit(EMPTY_CELL))


def row_preview(labelled: Sequence[tuple[str, Column]], count: int = 3) -> Column:
    """``header: value | header: value`` over the first columns, for skip reports."""
    parts = [
        F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(EMPTY_CELL)))
        for label, value in labelled[:count]
    ]
    return F.concat_ws(" | ", *parts)
