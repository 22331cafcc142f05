"""Spreadsheet files (xlsx) as rows: a sheet is a small XML document in a zip file."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

#: Rows of a sheet that are handed on at a time.
TOGETHER = 4096


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a sheet (the first one by default) as texts, row by row as the sheet is parsed; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        sheets = [(s.get("name"), targets[s.get(_REL)]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        path = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if path is None:
            raise KeyError(f"no sheet {sheet!r}; there are {[n for n, _ in sheets]}")
        with z.open("xl/" + path.removeprefix("/xl/")) as part:
            above = []
            for event, row in ET.iterparse(part, ("start", "end")):
                if event == "start":
                    above.append(row)
                    continue
                above.pop()
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield cells
                above[-1].clear()  # the rows that were read, which the tree would keep


def read_sheet(raw: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """All of ``sheet_rows``."""
    return list(sheet_rows(raw, sheet))


def write_sheets(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """A workbook of named sheets, each a header and rows; numbers stay numbers, None stays empty."""

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, i: int, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{name(i)}{r}"><v>{v!r}</v></c>'
        return f'<c r="{name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    main, rel = _MAIN[1:-1], _REL[1 : _REL.index("}")]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate(chain([header], rows), 1):
                    part.write(f'<row r="{r}">{"".join(cell(r, i, v) for i, v in enumerate(row))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def excel(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """Rows of spreadsheet files below their header (S08), read by Spark, one row of ``content`` each."""
    return sheets(spark.read.format("binaryFile").load(path), columns, sheet, header_row)


def sheets(books: DataFrame, columns: dict[str, str], sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """Rows below the header of the workbooks in ``content``: columns {header: type} by name, texts that do not fit the type null.

    Workbooks are parsed on the workers, whose memory holds a workbook's bytes and some thousand of its rows.
    """
    names = list(columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                cells = sheet_rows(raw.as_py(), sheet) if raw.is_valid else iter(())
                head = next(islice(cells, header_row, None), [])
                at = [head.index(n) if n in head else None for n in names]
                while body := list(islice(cells, TOGETHER)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] if i is not None and i < len(r) else None for r in body], pa.string()) for i in at], [f"c{i}" for i in range(len(names))])

    found = books.select("content").mapInArrow(rows, ", ".join(f"c{i} string" for i in range(len(names))))
    return found.select(*[F.col(f"c{i}").try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())])


def workbooks(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """by, content: one workbook per group, a sheet for each table."""
    from gridwright.operators.network import as_document

    schemas = {n: sorted(c for c in df.columns if c not in by) for n, df in tables.items()}

    @F.arrow_udf("binary")
    def book(docs: pa.Array) -> pa.Array:
        def written(p: dict) -> bytes:
            return write_sheets({n: (cols, (tuple(r.get(c) for c in cols) for r in p.get(n) or [])) for n, cols in schemas.items()})

        return pa.array([written(json.loads(d.as_py())) for d in docs], pa.binary())  # one document is parsed at a time

    return as_document(tables, by).select(*by, book("grid").alias("content"))
