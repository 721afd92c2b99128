import io
import zipfile

from semspark.sources.readers import sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(listed, active=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in (2, 10):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="B1"><v>{n}</v></c></row></sheetData></worksheet>')
        if listed:
            z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
    return out.getvalue()


def test_the_active_sheet_is_read():
    assert [list(sheet_rows(book(True, n))) for n in (0, 1)] == [[(1, [None, "2"])], [(1, [None, "10"])]]
    assert list(sheet_rows(book(False))) == [(1, [None, "2"])]
