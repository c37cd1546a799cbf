"""``.xlsx`` workbooks: first sheet, first row as header, every cell as text.

Workbooks are read with the binary-file source (any Hadoop filesystem, one
row per workbook, spread over tasks) and parsed per workbook inside
``mapInPandas`` with the standard library's zip and XML readers. The output
columns are those of all headers, which a first pass over the workbooks gives.

Cell text: shared and inline strings as written; numbers as their stored
text; booleans as ``True``/``False``; numbers styled as dates as ISO text
(``yyyy-MM-dd HH:mm:ss``, 1900 or 1904 date system); error cells as null.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}

# Built-in number formats that display dates or times.
_DATE_FORMAT_IDS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))
_DATE_CODE = re.compile(r"[dmyhs]", re.I)


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("p:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    raise ValueError("workbook has no first sheet")


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    st = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in st.findall("m:numFmts/m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", ""))
        custom[int(nf.get("numFmtId"))] = bool(_DATE_CODE.search(code))
    out = set()
    for i, xf in enumerate(st.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FORMAT_IDS or custom.get(fid, False):
            out.add(i)
    return out


def _serial_to_text(v: str, date1904: bool) -> str | None:
    try:
        x = float(v)
    except ValueError:
        return None
    base = _dt.datetime(1904, 1, 1) if date1904 else _dt.datetime(1899, 12, 30)
    ts = base + _dt.timedelta(days=x)
    ts = ts.replace(microsecond=0) if ts.microsecond < 500000 else \
        (ts + _dt.timedelta(seconds=1)).replace(microsecond=0)
    return ts.strftime("%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """All rows of the first sheet as lists of text (ragged rows padded)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in sst.findall("m:si", _NS)]
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    pr = wb.find("m:workbookPr", _NS)
    date1904 = pr is not None and pr.get("date1904") in ("1", "true")
    dates = _date_styles(z)
    sheet = ET.fromstring(z.read(_first_sheet(z)))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for pos, c in enumerate(row.findall("m:c", _NS)):
            idx = _col_index(c.get("r")) if c.get("r") else pos
            t, v = c.get("t", "n"), c.find("m:v", _NS)
            raw = v.text if v is not None else None
            if t == "s" and raw is not None:
                val = shared[int(raw)]
            elif t == "inlineStr":
                val = _text(c)
            elif t == "b" and raw is not None:
                val = "True" if raw == "1" else "False"
            elif t == "e":
                val = None
            elif t == "n" and raw is not None and int(c.get("s", "0")) in dates:
                val = _serial_to_text(raw, date1904)
            else:
                val = raw
            cells[idx] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def _header(names: list[str | None]) -> list[str]:
    """Header cells as names: blanks become ``Unnamed: i``, repeats get ``.1``, ``.2``."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = n if n not in (None, "") else f"Unnamed: {i}"
        if n in seen:
            seen[n] += 1
            n = f"{n}.{seen[n]}"
        else:
            seen[n] = 0
        out.append(n)
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks at ``path``, columns matched by header name.

    Cells beyond a header get names of their own (``Unnamed: i``), as pandas
    gives them; none is cut.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
                 .option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:          # one workbook at a time
                rows = sheet_rows(bytes(content))
                if not rows:
                    raise ValueError("workbook sheet is empty")
                width = max(map(len, rows))
                names = _header(rows[0] + [None] * (width - len(rows[0])))
                body = [r + [None] * (width - len(r)) for r in rows[1:]] or [None]
                yield pd.DataFrame({"names": [names] * len(body), "cells": body})

    sheets = files.mapInPandas(parse, "names array<string>, cells array<string>")
    headers = [r.names for r in sheets.select("names").distinct().collect()]   # one per header
    if not headers:
        raise ValueError(f"no .xlsx workbook at {path}")
    columns = list(dict.fromkeys(n for h in sorted(headers) for n in h))
    at = F.col("names")
    return sheets.where("cells is not null").select(*[
        F.get("cells", F.array_position(at, n).cast("int") - 1).alias(n) for n in columns])
