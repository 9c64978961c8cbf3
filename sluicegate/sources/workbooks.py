"""Folders of .xlsx workbooks: the first sheet of each file as text rows.

Spark has no workbook source, so this is the one place where Python sees row data.  Spark lists
the files and spreads them over the tasks; a task opens one workbook at a time by its path, reads
the parts of the archive that it needs, and streams them.  It holds a row, a batch of rows and the
shared strings of the workbook; these have a limit, so its memory does not follow the size of
files, which may be over 2 GB.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import zipfile
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from sluicegate.functions.names import SPACES, header_key, is_named
from sluicegate.sources.landing import FILE, ROW_NUMBER, Landing

ROWS_PER_BATCH = 2000
READ_BYTES = 1 << 20
#: Default limits of a workbook: all its parts unpacked, and the distinct strings that a task keeps.
MAX_UNPACKED = 64 << 30
MAX_STRINGS = 512 << 20
ROW_SCHEMA = f"{FILE} string, {ROW_NUMBER} long, cells map<string,string>, problem string"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Built-in number formats of the workbook standard that show a date.
_DATE_FORMATS = frozenset([14, 15, 16, 17, 22])


class WorkbookError(ValueError):
    pass


def open_by_range(path: str) -> BinaryIO:
    """A stream over a file that reads the parts asked for, wherever the path lies.

    Local and mounted paths are opened as files; others by the file systems of Arrow, which take
    their credentials from the worker's environment.
    """
    if path.startswith("file:"):
        path = f"/{path[5:].lstrip('/')}"
    scheme, _, place = path.rpartition("://")
    if not scheme:
        return open(path, "rb", buffering=READ_BYTES)
    uri = quote(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{place}", safe=":/@")
    system, place = pyarrow.fs.FileSystem.from_uri(uri)
    return io.BufferedReader(system.open_input_file(place), READ_BYTES)


def _part(book: zipfile.ZipFile, name: str):
    with book.open(name) as part:
        return ET.parse(part).getroot()


def _elements(stream, tag: str) -> Iterator[ET.Element]:
    """Elements of one tag, in order; one that was used is released, as is all around them."""
    above, inside = [], 0
    for event, node in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(node)
            inside += node.tag == tag
            continue
        above.pop()
        if node.tag == tag:
            inside -= 1
            yield node
        if above and not inside:
            above[-1].remove(node)


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the first sheet, and whether days count from 1904."""
    root = _part(book, "xl/workbook.xml")
    sheet = root.find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        raise WorkbookError("the workbook has no sheets")
    targets = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")
               if r.tag == f"{_REL}Relationship"}
    target = targets[sheet.get(_REL_ID)]
    props = root.find(f"{_MAIN}workbookPr")
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), from_1904


def _text(node) -> str:
    """Text of a plain or rich string, without phonetic hints."""
    direct = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    runs = [t.text or "" for t in node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(direct + runs)


class _Strings:
    """Texts by number, one after the other in one buffer."""

    def __init__(self):
        self._bytes, self._ends = bytearray(), array("q", [0])

    def append(self, text: str) -> int:
        """Adds a text; the bytes kept so far."""
        self._bytes += text.encode()
        self._ends.append(len(self._bytes))
        return len(self._bytes) + 8 * len(self._ends)

    def __getitem__(self, number: int) -> str:
        if not 0 <= number < len(self._ends) - 1:
            raise WorkbookError(f"there is no shared string {number}")
        return self._bytes[self._ends[number]:self._ends[number + 1]].decode()


def _shared_strings(book: zipfile.ZipFile, max_strings: int | None) -> _Strings:
    strings = _Strings()
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as part:
            for node in _elements(part, f"{_MAIN}si"):
                kept = strings.append(_text(node))
                if max_strings is not None and kept > max_strings:
                    raise WorkbookError("the workbook has more shared strings than allowed")
    return strings


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = _part(book, "xl/styles.xml")
    custom = set()
    for fmt in root.findall(f"{_MAIN}numFmts/{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", "")).lower()
        if "d" in code or "y" in code:
            custom.add(int(fmt.get("numFmtId")))
    dated = _DATE_FORMATS | custom
    return {i for i, xf in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf"))
            if int(xf.get("numFmtId", 0)) in dated}


def _column(reference: str) -> int:
    number = 0
    for ch in re.match(r"[A-Z]+", reference).group(0):
        number = number * 26 + ord(ch) - 64
    return number - 1


def _serial_text(value: float, from_1904: bool) -> str:
    if from_1904:
        origin = dt.datetime(1904, 1, 1)
    else:
        origin = dt.datetime(1899, 12, 31) if value < 61 else dt.datetime(1899, 12, 30)
    moment = origin + dt.timedelta(seconds=round(value * 86400))
    if moment.time() == dt.time(0):
        return moment.date().isoformat()
    return moment.isoformat(timespec="seconds")


def _cell_text(cell, shared: _Strings, dated: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return _text(inline) if inline is not None else None
    value = cell.findtext(f"{_MAIN}v")
    if value is None or value == "" or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dated:
        return _serial_text(float(value), from_1904)
    if kind == "n":
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number)
    return value


def _sheet_rows(stream: BinaryIO, max_unpacked: int | None, max_strings: int | None) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, {column: text}) for each row of the first sheet, in order."""
    with zipfile.ZipFile(stream) as book:
        if max_unpacked is not None and sum(i.file_size for i in book.infolist()) > max_unpacked:
            raise WorkbookError("the workbook unpacks to more than the allowed size")
        name, from_1904 = _first_sheet(book)
        shared, dated = _shared_strings(book, max_strings), _date_styles(book)
        with book.open(name) as sheet:
            last_row = 0
            for node in _elements(sheet, f"{_MAIN}row"):
                last_row = int(node.get("r", last_row + 1))
                cells, place = {}, -1
                for cell in node.findall(f"{_MAIN}c"):
                    place = _column(cell.get("r")) if cell.get("r") else place + 1
                    text = _cell_text(cell, shared, dated, from_1904)
                    if text:
                        cells[place] = text
                yield last_row, cells


def _header_names(cells: dict[int, str], by_key: bool) -> dict[int, str]:
    """Column -> header; unnamed columns are left out.

    A repeated header gets a numeric suffix.  With ``by_key`` headers take the form in
    which contracts compare them, and only the first of equal ones counts.
    """
    used: set[str] = set()
    out = {}
    for place in sorted(cells):
        header = cells[place].strip(SPACES)
        if not is_named(header):
            continue
        if by_key:
            header = header_key(header)
            if header in used:
                continue
        name, n = header, 1
        while name in used:
            name, n = f"{header}_{n}", n + 1
        used.add(name)
        out[place] = name
    return out


#: What a damaged or foreign file raises.  Errors of the file system are not among them: Spark
#: repeats the task.
_DAMAGED = (ValueError, LookupError, AttributeError, EOFError, NotImplementedError, RuntimeError,
            zipfile.BadZipFile, zlib.error, ET.ParseError)


def _file_rows(file: str, stream: BinaryIO, by_key: bool, max_unpacked: int | None = MAX_UNPACKED,
               max_strings: int | None = MAX_STRINGS) -> Iterator[tuple]:
    """Records of one workbook; a failure becomes its last record."""
    headers, first, last = None, 0, 0
    try:
        for last, cells in _sheet_rows(stream, max_unpacked, max_strings):
            if headers is None:
                headers, first = _header_names(cells, by_key), last
                yield file, 1, {h: h for h in headers.values()}, None
            else:
                yield file, last - first + 1, {headers[p]: t for p, t in cells.items() if p in headers}, None
        if last == first:
            yield file, 0, {}, "the workbook has no rows"
    except _DAMAGED as error:
        yield file, 0, {}, f"unreadable workbook: {error}"


def _reader(opened: Callable[[object], BinaryIO], by_key: bool, max_unpacked: int | None, max_strings: int | None):
    """Rows of the workbooks of (file, source), each opened from its source."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, source in zip(batch[FILE], batch["source"]):
                with opened(source) as stream:
                    records = _file_rows(file, stream, by_key, max_unpacked, max_strings)
                    while chunk := list(itertools.islice(records, ROWS_PER_BATCH)):
                        yield pd.DataFrame(chunk, columns=[FILE, ROW_NUMBER, "cells", "problem"])
    return read


def scan_workbooks(landing: Landing, by_key: bool = False, without: DataFrame | None = None,
                   max_bytes: int | None = None, max_unpacked: int | None = MAX_UNPACKED,
                   max_strings: int | None = MAX_STRINGS,
                   opened: Callable[[str], BinaryIO] = open_by_range) -> DataFrame:
    """One record per sheet row: file, row number, ``cells`` (header -> text), ``problem``.

    Row 1 carries the headers themselves.  A file that cannot be read ends with a record of
    row number 0 that gives the reason; leave out such files with ``readable``.  No shuffle of
    rows: a sheet is parsed where it is opened, and no content passes Spark.  Files of
    ``without`` are left out unread.  The limits refuse larger files; None is no limit.
    ``opened`` gives a seekable stream for a path, on the worker.
    """
    files = landing.files()
    if without is not None:
        files = files.join(without.select(FILE), FILE, "left_anti")
    admitted = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    rows = admitted.select(FILE, F.col("path").alias("source")).mapInPandas(
        _reader(opened, by_key, max_unpacked, max_strings), ROW_SCHEMA)
    if max_bytes is None:
        return rows
    return rows.unionByName(files.filter(F.col("length") > max_bytes).select(
        FILE, F.lit(0).cast("long").alias(ROW_NUMBER),
        F.create_map().cast("map<string,string>").alias("cells"),
        F.lit("the file is over the size limit").alias("problem")))


def scan_contents(files: DataFrame, by_key: bool = False, max_unpacked: int | None = MAX_UNPACKED,
                  max_strings: int | None = MAX_STRINGS) -> DataFrame:
    """As ``scan_workbooks``, of workbooks that are cells of a table (``_file``, ``content``)."""
    return files.select(FILE, F.col("content").alias("source")).mapInPandas(
        _reader(io.BytesIO, by_key, max_unpacked, max_strings), ROW_SCHEMA)


def sheet_problems(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNotNull()).select(FILE, "problem")


def missing_headers(rows: DataFrame, required: list[str]) -> DataFrame:
    """Files that lack required headers, with the list; ``rows`` scanned with ``by_key``."""
    wanted = F.array(*[F.lit(header_key(h)) for h in required]).cast("array<string>")
    missing = F.array_except(wanted, F.map_keys("cells"))
    return (
        rows.filter((F.col(ROW_NUMBER) == 1) & (F.size(missing) > 0))
        .select(FILE, F.concat(F.lit("missing required columns: "), F.array_join(missing, ", ")).alias("problem"))
    )


def readable(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """Rows of the files without a problem (at most one small record per file)."""
    return rows.join(problems.select(FILE).distinct(), FILE, "left_anti")


def sheet_headers(rows: DataFrame) -> list[str]:
    """All headers that occur, in name order; bounded by the width of the sheets."""
    keys = rows.filter(F.col(ROW_NUMBER) == 1).select(F.explode(F.map_keys("cells")).alias("h"))
    return sorted(r["h"] for r in keys.distinct().collect())


def sheet_table(rows: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Sheet rows as an ordinary text table with file and row number."""
    headers = sheet_headers(rows) if headers is None else headers
    data = rows.filter(F.col(ROW_NUMBER) > 1)
    return data.select(FILE, ROW_NUMBER, *[F.col("cells")[h].alias(h) for h in headers])
