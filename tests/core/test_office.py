"""Office files: what the readers see, what the writers put back."""

import io
import zipfile

from glossmill.sources import office

MAIN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in parts.items():
            archive.writestr(name, data)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}<w:tbl><w:tr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    split = "<w:p><w:r><w:t>one </w:t></w:r><w:hyperlink><w:r><w:t>two</w:t><w:tab/></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>"
    box = f"<w:p><w:r><w:t>out</w:t><w:pict><w:txbxContent>{p('boxed')}</w:txbxContent></w:pict></w:r></w:p>"
    body = f"<w:document {MAIN}><w:body>{p('first')}{table}{split}{box}</w:body></w:document>"
    return packed({"word/document.xml": body, "word/header1.xml": f"<w:hdr {MAIN}>{p('top')}</w:hdr>", "word/footnotes.xml": f"<w:footnotes {MAIN}>{p('note')}</w:footnotes>", "other.bin": b"\0\1"})


def xlsx():
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="AA1" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3" t="str"><f>A1</f><v>hello</v></c><c t="inlineStr"><is><t>= sum</t></is></c><c r="C3" t="b"><v>1</v></c><c r="D3"/></row>'
    )
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return packed({
        "xl/workbook.xml": f'<workbook {SHEET} xmlns:r="{kinds}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {SHEET}><si><t>hello</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {SHEET}><sheetData>{rows}</sheetData></worksheet>",
        "xl/comments1.xml": f"<comments {SHEET}><commentList><comment ref='A1'/><comment ref='B1'/></commentList></comments>",
    })


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.docx": docx(), "b.xlsx": xlsx(), "~$a.docx": b"lock", "bad.docx": b"no zip", "bad.xlsx": packed({"x": b""}), "empty.docx": b""}.items():
        (tmp_path / "in" / name).write_bytes(data)
    return str(tmp_path / "in")


def test_paragraphs(spark, tmp_path):
    found = office.paragraphs(office.office_files(spark, folder(tmp_path), ".docx")).orderBy("path", "part", "ord").collect()
    good = [(r.part, r.in_table, r.text) for r in found if r.error is None]
    assert good == [("document", False, "first"), ("document", True, "cell"), ("document", True, "deep"), ("document", False, "one two\t"), ("document", False, "out"), ("header1", False, "top")]
    assert [(r.path.rsplit("/")[-1], r.error) for r in found if r.error] == [("bad.docx", "error: BadZipFile")]


def test_cells(spark, tmp_path):
    files = office.office_files(spark, folder(tmp_path), ".xlsx")
    found = office.cells(files)
    good = [(r.sheet, r.row, r.col, r.value, r.kind, r.is_formula) for r in found.filter("error IS NULL").orderBy("row", "col").collect()]
    assert good == [
        ("Data", 1, 1, "hello", "string", False), ("Data", 1, 2, "5", "number", False), ("Data", 1, 27, "rich text", "string", False),
        ("Data", 3, 1, "hello", "string", True), ("Data", 3, 2, "= sum", "string", True), ("Data", 3, 3, "1", "boolean", False),
    ]
    assert [r.value for r in office.translatable(found, [1, 2]).collect()] == ["hello"]
    assert {(r.path.rsplit("/")[-1], r.sheet_names, r.comments) for r in office.unreached(files).collect()} == {("b.xlsx", 1, 2), ("bad.xlsx", None, None)}


def test_texts(spark, tmp_path):
    got = {r.path.rsplit("/")[-1]: (r.text, r.method) for r in office.texts(office.office_files(spark, folder(tmp_path), ".docx", ".xlsx")).collect()}
    assert got == {
        "a.docx": ("first\none two\t\nout\ncell\ndeep", "docx"), "b.xlsx": ("hello\nrich text\nhello\n= sum", "xlsx"),
        "bad.docx": (None, "error: BadZipFile"), "bad.xlsx": (None, "error: KeyError"),
    }


def test_rewritten_and_saved(spark, tmp_path):
    files = office.office_files(spark, folder(tmp_path), ".docx", ".xlsx")
    paths = {r.path.rsplit("/")[-1]: r.path for r in files.select("path").collect()}
    pairs = [(paths["a.docx"], "one two\t", "ena <dva> \x01"), (paths["a.docx"], "top", "vrh"), (paths["b.xlsx"], "hello", "zdravo"), (paths["a.docx"], None, "x")]
    out = office.rewritten(files, spark.createDataFrame(pairs, "path string, src string, tgt string"))
    assert out.count() == 2
    said = [r.text for r in office.paragraphs(out.filter("path LIKE '%.docx'")).orderBy("part", "ord").collect()]
    assert said == ["first", "cell", "deep", "ena <dva> ", "out", "vrh"]
    cells = [(r.value, r.is_formula) for r in office.cells(out.filter("path LIKE '%.xlsx'")).orderBy("row", "col").collect()]
    assert cells == [("zdravo", False), ("5", False), ("rich text", False), ("hello", True), ("= sum", True), ("1", False)]
    one = out.selectExpr("concat('deep/er/', regexp_extract(path, '([^/]*)$', 1)) AS path", "content")
    sizes = {r.path: r.bytes for r in office.save(one, str(tmp_path / "out")).collect()}
    assert {p: (tmp_path / "out" / p).stat().st_size for p in sizes} == sizes and len(sizes) == 2


def test_new_documents(spark):
    pairs = spark.createDataFrame([("x.docx", 2, "b", "B"), ("x.docx", 1, "a", "A"), ("y.docx", 1, None, "C")], "path string, ord int, src string, tgt string")
    said = lambda made: [(r.path, r.text) for r in office.paragraphs(made).orderBy("path", "ord").collect()]
    assert said(office.as_docx(pairs)) == [("x.docx", "A"), ("x.docx", "B"), ("y.docx", "C")]
    assert said(office.as_docx(pairs, bilingual=True)) == [("x.docx", t) for t in "aAbB"] + [("y.docx", ""), ("y.docx", "C")]
    assert office.paragraphs(office.as_docx(pairs.limit(0))).count() == 0
