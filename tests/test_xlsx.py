import datetime as dt
import os
import zipfile

from ledgerloom.plans.upload import typed_upload
from ledgerloom.sources.files import read_file

_CT = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>"""
_WB = """<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>"""
_RELS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
_STYLES = """<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>"""
_SST = """<?xml version="1.0" encoding="UTF-8"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Order Date</t></si><si><t>SKU</t></si><si><t>Qty</t></si><si><t>P1</t></si></sst>"""


def _sheet(rows):
    body = "".join(f'<row r="{i + 1}">{"".join(cells)}</row>' for i, cells in enumerate(rows))
    return ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
            f'spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def _book(path):
    rows = [['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="s"><v>2</v></c>']]
    for i in range(5):
        rows.append([f'<c r="A{i + 2}" s="1"><v>{45352 + i}</v></c>', f'<c r="B{i + 2}" t="s"><v>3</v></c>',
                     f'<c r="C{i + 2}"><v>{i + 1}</v></c>'])
    rows.append(['<c r="A7" s="1"><v>45360</v></c>', '<c r="C7" t="inlineStr"><is><t>7</t></is></c>'])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", _CT)
        z.writestr("xl/workbook.xml", _WB)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS)
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/sharedStrings.xml", _SST)
        z.writestr("xl/worksheets/sheet1.xml", _sheet(rows))


def test_xlsx_first_sheet_as_text(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "book.xlsx")
    _book(p)
    df = read_file(spark, p)
    assert df.columns[:3] == ["Order Date", "SKU", "Qty"]
    rows = df.orderBy("_row_id").collect()
    assert rows[0]["Order Date"] == "2024-03-01 00:00:00" and rows[0]["SKU"] == "P1"
    assert rows[5]["SKU"] is None and rows[5]["Qty"] == "7"
    typed = typed_upload(spark, p)[0].orderBy("_row_id").collect()
    assert typed[0].order_date == dt.datetime(2024, 3, 1) and typed[5].qty == 7
