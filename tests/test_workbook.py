import zipfile

import pytest

from ledgermesh.sources.workbook import book_flags, read_parts, whole_books
from ledgermesh.functions.a1 import shifted
from ledgermesh.operators import names
from ledgermesh.sources.workbook import Unreadable, facts_of, read_books, read_cells

REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rel(i, kind, to):
    return f'<Relationship Id="{i}" Type="{KIND}{kind}" Target="{to}"/>'


def book(path, sheet):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", REL.format(rel("a", "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="P&amp;L" sheetId="1" r:id="s"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", REL.format(rel("s", "worksheet", "worksheets/sheet1.xml") + rel("t", "sharedStrings", "sharedStrings.xml") + rel("y", "styles", "/xl/styles.xml")))
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Item</t></si><si><r><t>Rev</t></r><r><t>enue</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="0.0x"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}>{sheet}</worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", REL.format(rel("c", "comments", "../comments1.xml")))
        z.writestr("xl/comments1.xml", f'<comments {MAIN}><commentList><comment ref="A3"><text><t>why</t></text></comment></commentList></comments>')


def test_cells_and_errors(spark, tmp_path):
    book(tmp_path / "a.xlsx", '<cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45000</v></c><c r="C1" s="2"><v>1.5</v></c><c r="D1" s="0"/></row>'
         '<row r="2" hidden="1"><c r="A2" t="s"><v>1</v></c><c r="B2"><f t="shared" si="0" ref="B2:B3">A1+$A$1*SUM(C2:C3)</f><v>3</v></c></row>'
         '<row r="3"><c r="A3"/><c r="B3"><f t="shared" si="0"/><v>4</v></c><c r="E3" t="inlineStr"><is><t>x</t></is></c><c r="F3" t="s"><v>99</v></c></row></sheetData>')
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/big.xml", b"0" * 100_000)
    book(tmp_path / "e.xlsx", "<sheetData><row>")
    rows = read_cells(spark, f"file://{tmp_path}").collect()
    got = {r["addr"]: r for r in rows if r["addr"]}
    assert sorted(got) == ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "E3", "F3"]
    assert [got[a]["cached_value"] for a in ("A1", "A2", "A3", "E3", "F3")] == ["Item", "Revenue", None, "x", "99"]
    assert got["B2"]["formula_raw"] == "A1+$A$1*SUM(C2:C3)" and got["B3"]["formula_raw"] == "A2+$A$1*SUM(C3:C4)"
    assert [got[a]["number_format"] for a in ("A1", "B1", "C1")] == [None, "mm-dd-yy", "0.0x"]
    assert (got["C1"]["hidden"], got["B2"]["hidden"], got["B3"]["hidden"], got["A3"]["comment"]) == (True, True, False, "why")
    assert {r["book"][-6:]: (r["error"], r["detail"]) for r in rows if r["error"] and r["error"] != "parse_failed"} == {"c.xlsx": ("zip_rejected", "not a zip"), "d.xlsx": ("zip_rejected", "compression ratio")}
    assert [r["book"][-6:] for r in rows if r["error"] == "parse_failed"] == ["e.xlsx"]
    cells, parts = read_cells(spark, f"file://{tmp_path}"), read_parts(spark, f"file://{tmp_path}")
    assert {r["book"][-6:] for r in whole_books(cells).collect()} == {"a.xlsx"}
    flags = {r["book"][-6:]: r for r in book_flags(cells, parts).collect()}
    assert (flags["a.xlsx"]["first_ref"], flags["a.xlsx"]["locale"], flags["a.xlsx"]["has_vba"], flags["a.xlsx"]["has_xlm"]) == ("P&L!A1", "en", False, False)


def test_no_bytes():
    with pytest.raises(Unreadable, match="empty_file"):
        list(facts_of(b""))


def test_moved():
    # one rule everywhere: what would leave the sheet stays at its first row or column
    assert shifted("A1&\"B2\"+'C3 x'!D4+LOG10(E$5)+$F6", 2, 1) == "C2&\"B2\"+'C3 x'!F5+LOG10(G$5)+$F7"
    assert shifted("A1", 0, -1) == "A1" and shifted("B3", -5, -1) == "A2"


def test_what_a_book_says_of_itself(spark, tmp_path):
    sheet = '<sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><f>Rate*2+Unknown</f><v>2</v></c><c r="C1"><f>SUM(Costs)+"Rate"</f><v>3</v></c><c r="D1"><f t="shared" si="0">A1+1</f><v>1</v></c><c r="E1"><f t="shared" si="0"/><v>1</v></c></row>' \
            '<row r="2"><c r="D2"><f t="shared" si="0">A2*9</f><v>1</v></c><c r="E2"><f t="shared" si="0"/><v>1</v></c></row></sheetData>'
    with zipfile.ZipFile(tmp_path / "n.xlsx", "w") as z:
        z.writestr("_rels/.rels", REL.format(rel("a", "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="1" r:id="s"/></sheets><definedNames><definedName name="Rate">Inputs!$B$3</definedName><definedName name="costs" hidden="1">Base+S!$A$1:$A$2</definedName>'
                   '<definedName name="Base">Inputs!$C$1</definedName><definedName name="Ring">Ring2</definedName><definedName name="Ring2">Ring+1</definedName></definedNames><calcPr iterate="1"/></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", REL.format(rel("s", "worksheet", "worksheets/sheet1.xml") + rel("x", "externalLink", "externalLinks/externalLink1.xml")))
        z.writestr("xl/externalLinks/externalLink1.xml", "<externalLink/>")
        z.writestr("xl/externalLinks/_rels/externalLink1.xml.rels", REL.format(f'<Relationship Id="e" Type="{KIND}externalLinkPath" Target="file:///other.xlsx" TargetMode="External"/>'))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}>{sheet}</worksheet>")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    b = read_books(spark, f"file://{tmp_path}")
    said = b.books.first()
    assert (said["externals"], said["date1904"], said["iterates"]) == (["file:///other.xlsx"], True, True)
    assert [(r["book"][-10:], r["error"]) for r in b.errors.collect()] == [("empty.xlsx", "empty_file")]
    formulas = {r["addr"]: r["formula_raw"] for r in b.cells.collect()}
    assert [formulas[a] for a in ("D1", "E1", "D2", "E2")] == ["A1+1", "B1+1", "A2*9", "B2*9"]
    got = names.name_edges(b.cells, b.names)
    assert sorted((r["src"], r["kind"], r["dst"]) for r in got.collect()) == [("S!B1", "cross_sheet", "Inputs!B3"), ("S!C1", "cross_sheet", "Inputs!C1"), ("S!C1", "range", "S!A1:A2")]
    assert sorted(r["name"] for r in names.circular_names(b.names).collect()) == ["ring", "ring2"]
