"""Spreadsheet workbooks (OOXML): a sheet whose header row is found by the names that stand in it.

Rows are read from the compressed sheet one after another, so a task holds the compressed file and one row.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.sources.shared import new_path

SHEET = "xl/worksheets/sheet1.xml"
# Fixed values of the format: built-in number formats that show dates, and the day that serial 0 stands for.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
DAY_0 = dt.date(1899, 12, 30)
ROWS = 5_000


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter() if _name(t.tag) == "t") for item in root]


def _dated(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter() if _name(f.tag) == "numFmt" and re.search(r"[ymd]", re.sub(r"\[.*?\]|\".*?\"", "", f.get("formatCode", "")).lower())}
    styles = next((x for x in root if _name(x.tag) == "cellXfs"), ())
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def cells(content: bytes) -> Iterator[dict[int, object]]:
    """Rows of the first sheet: column to text, number or date."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dated = _shared(book), _dated(book)
        with book.open(SHEET) as sheet:
            row: dict[int, object] = {}
            for _, e in ET.iterparse(sheet, ("end",)):
                kind = _name(e.tag)
                if kind == "c":
                    raw = next((x.text for x in e.iter() if _name(x.tag) in ("v", "t") and x.text), None)
                    if raw is not None:
                        how = e.get("t", "n")
                        if how == "s":
                            raw = shared[int(raw)]
                        elif how == "d":
                            raw = dt.date.fromisoformat(raw[:10])
                        elif how == "n":
                            raw = DAY_0 + dt.timedelta(days=int(float(raw))) if int(e.get("s", -1)) in dated else float(raw)
                        row[_column(e.get("r"))] = raw
                elif kind == "row":
                    yield row
                    row = {}
                    e.clear()


def long_rows(content: bytes, code: str, also: str) -> Iterator[tuple[str, dt.date, float]]:
    """(code, date, value) of the positive numbers under the last dated column of each month."""
    at, days = None, {}
    for row in cells(content):
        if at is None:
            names = {v: k for k, v in row.items() if isinstance(v, str)}
            if code in names and also in names:
                at = names[code]
                for k, v in row.items():
                    if isinstance(v, dt.date) and v >= days.get((v.year, v.month), (v, 0))[0]:
                        days[v.year, v.month] = (v, k)
            continue
        if row.get(at) is None:
            continue
        for day, k in days.values():
            try:
                value = float(row.get(k, "nan"))
            except (TypeError, ValueError):
                continue
            if value > 0:
                yield str(row[at]), day, value


def read(paths: DataFrame, code: str = "Code", also: str = "Name") -> DataFrame:
    """Long rows code, date, value of the workbooks at `paths`; the header is the row with both marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                out = []
                for row in long_rows(bytes(content), code, also):
                    out.append(row)
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=["code", "date", "value"])
                        out = []
                yield pd.DataFrame(out, columns=["code", "date", "value"])

    files = paths.sparkSession.read.format("binaryFile").load([r.path for r in paths.collect()])
    return files.select("content").mapInPandas(run, "code string, date date, value double")


def document(header: list[dt.date], rows: list[tuple[str, list[float | None]]]) -> bytes:
    """A workbook with two rows of prose, a header (Code, Name, dates) and a row a code."""
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    said = lambda r, k, s: f'<c r="{letters(k)}{r}" t="inlineStr"><is><t>{escape(s)}</t></is></c>'
    lines = ['<row r="1">' + said(1, 0, "Monthly sheet") + "</row>", '<row r="2"/>']
    days = "".join(f'<c r="{letters(k + 2)}3" s="1"><v>{(d - DAY_0).days}</v></c>' for k, d in enumerate(header))
    lines.append(f'<row r="3">{said(3, 0, "Code")}{said(3, 1, "Name")}{days}</row>')
    for r, (name, values) in enumerate(rows, 4):
        own = "".join(f'<c r="{letters(k + 2)}{r}"><v>{v!r}</v></c>' for k, v in enumerate(values) if v is not None)
        lines.append(f'<row r="{r}">{said(r, 0, name)}{said(r, 1, name)}{own}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr(SHEET, f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def write(long: DataFrame, code: str, date: str, value: str) -> DataFrame:
    """Write small monthly rows as one workbook; returns (path). For sinks and tests: a workbook is one file."""
    spark = long.sparkSession
    wide = long.groupBy(code).pivot(date).agg(F.first(value))
    header = [dt.date.fromisoformat(c) for c in wide.columns[1:]]
    path = new_path(spark)

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        body = pd.concat(list(rows))
        values = [(r[0], [None if pd.isna(x) else float(x) for x in r[1:]]) for r in body.itertuples(index=False, name=None)]
        yield pd.DataFrame({"content": [document(header, values)]})

    made = wide.coalesce(1).mapInPandas(pack, "content binary")
    made.write.parquet(f"{path}/book")
    # Spark has no sink for single binary files: the Hadoop file system writes the one workbook
    content = bytes(spark.read.parquet(f"{path}/book").first().content)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/sheet.xlsx")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray(content))
    stream.close()
    return spark.createDataFrame([(f"{path}/sheet.xlsx",)], "path string")
