"""Helpers for column and table names.  They run on the driver, once per schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The white space that header and cell trimming removes (Unicode space
# separators, line ends and the byte-order mark).
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
IDENTIFIER_LIMIT = 128

_GENERATED = re.compile(r"__EMPTY.*|_c\d+")


def quoted(name: str) -> str:
    """Backquote a name so that dots and spaces in it are literal."""
    return "`" + name.replace("`", "``") + "`"


def header_key(header: str) -> str:
    """The form in which two headers are compared."""
    return str(header).strip(SPACES).lower()


def is_named(header: str) -> bool:
    """False for blank headers and for names a reader made up for blank ones."""
    text = str(header).strip(SPACES)
    return bool(text) and not _GENERATED.fullmatch(text)


def sanitize_name(raw: str | None) -> str:
    """Driver-side twin of ``text.sanitize_identifier`` for a single name."""
    text = (raw or "").strip(SPACES)
    for bad in "[]\x00":
        text = text.replace(bad, "_")
    return text[:IDENTIFIER_LIMIT] or "col"


def unique_names(candidates: Iterable[str], positions: Iterable[int] | None = None) -> list[str]:
    """Make names unique without regard to case; a clash gets ``_<position>``.

    Unlike a single suffix, the suffixed name is checked again until it is free.
    """
    candidates = list(candidates)
    used: set[str] = set()
    out = []
    for position, name in zip(positions or range(len(candidates)), candidates):
        chosen, suffix = name, position
        while chosen.lower() in used:
            chosen = f"{name}_{suffix}"
            suffix += 1
        used.add(chosen.lower())
        out.append(chosen)
    return out
