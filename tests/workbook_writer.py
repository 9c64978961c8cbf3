"""Minimal .xlsx files for the tests: shared and inline strings, numbers, dates."""

import zipfile
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letter(i: int) -> str:
    return chr(ord("A") + i)


def _cell(ref: str, value, shared: list[str]) -> str:
    if value is None:
        return ""
    if isinstance(value, tuple):  # (day number, "date")
        return f'<c r="{ref}" s="1"><v>{value[0]}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    if value not in shared:
        shared.append(value)
    return f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>'


def write_workbook(path, rows) -> None:
    shared: list[str] = []
    lines = []
    for n, row in enumerate(rows, start=1):
        cells = "".join(_cell(f"{_letter(i)}{n}", v, shared) for i, v in enumerate(row))
        lines.append(f'<row r="{n}">{cells}</row>')
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    strings = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", (
            f'<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets>'
            '<sheet name="Data" sheetId="1" r:id="rId7"/><sheet name="Other" sheetId="2" r:id="rId8"/>'
            "</sheets></workbook>"))
        book.writestr("xl/_rels/workbook.xml.rels", (
            f'<Relationships xmlns="{PKG}">'
            '<Relationship Id="rId7" Type="t" Target="worksheets/first.xml"/>'
            '<Relationship Id="rId8" Type="t" Target="worksheets/second.xml"/></Relationships>'))
        book.writestr("xl/worksheets/first.xml", sheet)
        book.writestr("xl/worksheets/second.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        book.writestr("xl/styles.xml", (
            f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'))
