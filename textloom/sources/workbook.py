"""Excel workbooks without a spreadsheet library: the zip archive and its sheet XML are read as a stream.

Only standard modules are used, so executors need nothing installed. Rows leave as Arrow batches of bounded size; what a
reader holds is the file and its shared strings. A sheet has at most 1,048,576 rows by the format, so a file is never too much for one task,
and many files are many tasks.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

MAX_ROWS = 1_048_576
# Texts that common table readers take for missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Numbers of the built-in date and time formats.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_LEGACY = b"\xd0\xcf\x11\xe0"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _elements(archive: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Whole elements of one kind, each let go after use."""
    with archive.open(name) as stream:
        parents: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _local(element.tag) == wanted:
                yield element
                if parents:
                    parents[-1].clear()


def _text(element: ElementTree.Element) -> str:
    """Text of an entry, its formatted runs joined, without reading aids."""
    out = []
    for child in element:
        kind = _local(child.tag)
        if kind == "t":
            out.append(child.text or "")
        elif kind == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _column(reference: str) -> int:
    """Column number (from 0) of a cell reference like BC12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _reference(column: int, row: int) -> str:
    name, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row}"


class Workbook:
    """One file: its sheet names and the cells of a sheet."""

    def __init__(self, content: bytes):
        if content[:4] == _LEGACY:
            raise ValueError("a workbook of the binary format before 2007; save it as xlsx")
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.archive.namelist())
        targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in _elements(self.archive, "xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets = {}
        for sheet in _elements(self.archive, "xl/workbook.xml", "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = targets[link]
            self.sheets[sheet.attrib["name"]] = target.lstrip("/") if target.startswith("/") else "xl/" + target
        properties = next(_elements(self.archive, "xl/workbook.xml", "workbookPr"), None)
        old = properties is not None and properties.attrib.get("date1904") in ("1", "true")
        self.epoch = datetime.datetime(1904, 1, 1) if old else datetime.datetime(1899, 12, 30)
        self.strings = [_text(e) for e in _elements(self.archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        root = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
        formats = {}
        for f in root.iter():
            if _local(f.tag) == "numFmt" and "formatCode" in f.attrib:
                # Quoted text and colours aside, one of these letters makes it a date or time.
                code = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.attrib["formatCode"].lower())
                formats[int(f.attrib["numFmtId"])] = bool(re.search("[dmyhs]", code)) and code != "general"
        cells = next((e for e in root if _local(e.tag) == "cellXfs"), [])
        ids = [int(x.attrib.get("numFmtId", 0)) for x in cells]
        return {i for i, n in enumerate(ids) if n in _DATE_FORMATS or formats.get(n)}

    def _value(self, cell: ElementTree.Element):
        kind = cell.attrib.get("t", "n")
        if kind == "inlineStr":
            held = next((c for c in cell if _local(c.tag) == "is"), None)
            return None if held is None else _text(held)
        raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "str":
            return raw
        if kind == "b":
            return raw.strip() == "1"
        if kind == "d":
            return datetime.datetime.fromisoformat(raw.replace("Z", ""))
        number = float(raw)
        if int(cell.attrib.get("s", 0)) in self.dates:
            return self.epoch + datetime.timedelta(milliseconds=round(number * 86_400_000))
        # Whole numbers keep all their digits.
        return int(raw) if re.fullmatch(r"-?\d{1,18}", raw) else int(number) if number == int(number) and abs(number) < 2**53 else number

    def rows(self, sheet: int | str = 0, missing: Sequence[str] = MISSING) -> Iterator[list]:
        """Rows from the first to the last, empty ones included, as lists that may differ in length."""
        names = list(self.sheets)
        name = names[sheet] if isinstance(sheet, int) else sheet
        if name not in self.sheets:
            raise ValueError(f"no sheet {name!r}; there are {names}")
        gone, expected = set(missing), 1
        for row in _elements(self.archive, self.sheets[name], "row"):
            number = int(row.attrib.get("r", expected))
            for _ in range(expected, number):
                yield []
            expected, values = number + 1, []
            for cell in row:
                if _local(cell.tag) != "c":
                    continue
                at = _column(cell.attrib["r"]) if "r" in cell.attrib else len(values)
                values += [None] * (at - len(values))
                value = self._value(cell)
                values.append(None if isinstance(value, str) and value in gone else value)
            yield values


def table(content: bytes, sheet: int | str = 0, missing: Sequence[str] = MISSING) -> tuple[list[str], Iterator[list]]:
    """Column names from the first row, and the rows below it. Unnamed and repeated columns get names of their own."""
    rows = Workbook(content).rows(sheet, missing)
    names: list[str] = []
    for i, cell in enumerate(next(rows, [])):
        name = f"Unnamed: {i}" if cell is None else str(cell)
        base, n = name, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names, rows


def kind_of(values: Iterable) -> str:
    """The narrowest Spark type that holds all values; text where they do not agree, null without any."""
    found = {type(v) for v in values if v is not None}
    return merged(*[{bool: "boolean", int: "bigint", float: "double", datetime.datetime: "timestamp_ntz"}.get(t, "string") for t in found])


def merged(*kinds: str) -> str:
    left = {k for k in kinds if k != "void"}
    if len(left) <= 1:
        return left.pop() if left else "void"
    return "double" if left == {"bigint", "double"} else "string"


def shown(value) -> str | None:
    """A cell as text."""
    if value is None or isinstance(value, str):
        return value
    return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)


def workbook_bytes(names: Sequence[str], rows: Iterable[Sequence], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet. The archive ends in a comment of one line end, so a text writer may put the last byte there itself."""

    def cell(column: int, row: int, value) -> str:
        at = _reference(column, row)
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (datetime.datetime, datetime.date)):
            moment = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
            days = (moment.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
            return f'<c r="{at}" s="1"><v>{days!r}</v></c>'
        if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        text = escape(_ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.comment = b"\n"
        archive.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>')
        archive.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        archive.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        archive.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        archive.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as stream:
            stream.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            stream.write(f'<row r="1">{"".join(cell(i, 1, v) for i, v in enumerate(names))}</row>'.encode())
            for n, values in enumerate(rows, 2):
                if n > MAX_ROWS:
                    raise ValueError(f"a sheet holds {MAX_ROWS} rows; write more files")
                stream.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(values))}</row>'.encode())
            stream.write(b"</sheetData></worksheet>")
    return out.getvalue()
