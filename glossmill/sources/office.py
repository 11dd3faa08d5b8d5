"""Office files: paragraphs of DOCX, cells of XLSX, and both written back. Only zip and XML of the standard library are used.

A file is read whole by one task, never by the driver. One that can't be read gives one row whose error names the exception's type.
Lock files and hidden files are left out, and so are files of no bytes, which Spark's file sources skip. Text boxes, footnotes and comments aren't reached, as they hold no running text.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as X

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
_PARTS = re.compile(r"word/(document|header\d*|footer\d*)\.xml")
PARAGRAPHS = "path string, part string, ord int, in_table boolean, text string, error string"
CELLS = "path string, sheet_ord int, sheet string, row int, col int, value string, kind string, is_formula boolean, error string"


def office_files(spark: SparkSession, root: str, *exts: str) -> DataFrame:
    """path, content of the files with the extensions below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.filter(~name.rlike(r"^(~\$|\.)") & F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*exts)).select("path", "content")


def _clean(text: str) -> str:
    """Text without the characters that XML can't hold."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]", "", text)


def _walk(node: X.Element, in_table: bool = False) -> Iterator[tuple[X.Element, bool]]:
    """Paragraphs at any depth of tables, each with whether it stands in one; text boxes are left out."""
    stack = [(node, in_table)]
    while stack:
        at, inside = stack.pop()
        if at.tag == W + "p":
            yield at, inside
        elif at.tag != W + "txbxContent":
            stack += [(child, inside or at.tag == W + "tbl") for child in reversed(at)]


def _runs(node: X.Element) -> Iterator[X.Element]:
    for child in node:
        if child.tag == W + "r":
            yield child
        elif child.tag in (W + "hyperlink", W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
            yield from _runs(child)


def _said(paragraph: X.Element) -> str:
    return "".join((t.text or "") if t.tag == W + "t" else _BREAKS.get(t.tag, "") for run in _runs(paragraph) for t in run)


def _docx_parts(archive: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in archive.namelist() if _PARTS.fullmatch(n)), key=lambda n: (not n.endswith("/document.xml"), n))


def docx_rows(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in _docx_parts(archive):
            for i, (paragraph, inside) in enumerate(_walk(X.fromstring(archive.read(name)))):
                yield path, name[5:-4], i, inside, _said(paragraph), None


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, part) of each sheet in the workbook's order."""
    targets = {r.get("Id"): r.get("Target", "") for r in X.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(P + "Relationship")}
    for sheet in X.fromstring(archive.read("xl/workbook.xml")).iter(S + "sheet"):
        target = targets[sheet.get(R + "id")]
        if "worksheets/" in target:
            yield sheet.get("name", ""), target[1:] if target.startswith("/") else "xl/" + target


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    return [_plain(item) for item in X.fromstring(archive.read("xl/sharedStrings.xml")).iter(S + "si")]


def _plain(node: X.Element) -> str:
    """Text of a string item, its runs joined; phonetic hints are no text."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == S + "t" else part.findall(S + "t") if part.tag == S + "r" else []))


def _places(sheet: X.Element) -> Iterator[tuple[int, int, X.Element]]:
    """Row, column (from 1) and element of each cell; one without a reference follows the cell before."""
    row = 0
    for line in sheet.iter(S + "row"):
        row, col = int(line.get("r", row + 1)), 0
        for cell in line.iter(S + "c"):
            col += 1
            if letters := (cell.get("r") or "").rstrip("0123456789"):
                col = 0
                for c in letters:
                    col = 26 * col + ord(c) - 64
            yield row, col, cell


def _cell(cell: X.Element, shared: list[str]) -> tuple[str | None, str]:
    """Computed value and kind: string, number, boolean, error or empty."""
    kind, value = cell.get("t", "n"), cell.findtext(S + "v")
    if kind == "inlineStr":
        inline = cell.find(S + "is")
        return ("" if inline is None else _plain(inline)), "string"
    if value is None:
        return None, "empty"
    return (shared[int(value)], "string") if kind == "s" else (value, {"str": "string", "b": "boolean", "e": "error", "d": "date"}.get(kind, "number"))


def xlsx_rows(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = _shared(archive)
        for n, (name, part) in enumerate(_sheets(archive)):
            for row, col, cell in _places(X.fromstring(archive.read(part))):
                value, kind = _cell(cell, shared)
                formula = cell.find(S + "f") is not None or kind == "string" and (value or "").lstrip().startswith("=")
                if kind != "empty" or formula:
                    yield (path, n, name, row, col, value, kind, formula, None)


def _read(files: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = list(rows(path, content.as_py()))
                except (zipfile.BadZipFile, X.ParseError, KeyError, IndexError, ValueError, NotImplementedError, RuntimeError) as e:
                    found = [(path, *[None] * (len(names) - 2), f"error: {type(e).__name__}")]
                for at in range(0, len(found), 4096):
                    columns = list(zip(*found[at : at + 4096], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, shape, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    """path, part, ord, in_table, text, error of each paragraph in files (path, content): body, tables, headers, footers."""
    return _read(files, docx_rows, PARAGRAPHS)


def cells(files: DataFrame) -> DataFrame:
    """path, sheet_ord, sheet, row, col, value, kind, is_formula, error of each filled cell in files (path, content)."""
    return _read(files, xlsx_rows, CELLS)


def texts(files: DataFrame) -> DataFrame:
    """path, text, method: DOCX body before its tables, XLSX string cells in row order; a file without text has an empty one."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    body = paragraphs(files.filter(ext == ".docx")).filter("error IS NOT NULL OR part = 'document'")
    strings = cells(files.filter(ext != ".docx")).filter("error IS NOT NULL OR (kind = 'string' AND trim(value) <> '')")
    place = lambda *c: F.struct(*[F.expr(x).alias(f"c{i}") for i, x in enumerate(c)]).alias("at")
    both = body.select("path", place("0", "CAST(in_table AS int)", "ord"), "text", "error").unionByName(
        strings.select("path", place("sheet_ord", "row", "col"), F.col("value").alias("text"), "error")
    )
    joined = both.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"), F.max("error").alias("error"))
    found = joined.select("path", F.array_join(F.col("parts.text"), "\n").alias("text"), "error")
    known = files.select("path", ext.alias("ext")).join(found, "path", "left")
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))
    return known.select("path", text.alias("text"), F.coalesce("error", F.substring("ext", 2, 9)).alias("method"))


def translatable(found: DataFrame, cols: list[int] | None = None) -> DataFrame:
    """Cells with text to translate: strings that aren't formulas, of the given columns (all, if none are given)."""
    keep: Column = (F.col("kind") == "string") & ~F.col("is_formula") & (F.trim("value") != "")
    return found.filter(keep if cols is None else keep & F.col("col").isin(*cols))


def unreached(files: DataFrame) -> DataFrame:
    """path, sheet_names, comments of each workbook: content that no reader of cells sees; null if it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        notes = [n for n in archive.namelist() if re.fullmatch(r"xl/(comments/)?comment[^/]*\.xml", n)]
                        out.append((path, len(list(_sheets(archive))), sum(len(list(X.fromstring(archive.read(n)).iter(S + "comment"))) for n in notes)))
                except (zipfile.BadZipFile, X.ParseError, KeyError):
                    out.append((path, None, None))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["path", "sheet_names", "comments"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet_names int, comments int")


def _repack(content: bytes, changed: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            new.writestr(item, changed.get(item.filename, None) or old.read(item.filename))
    return out.getvalue()


def _keep_prefixes(data: bytes) -> None:
    for _, (prefix, uri) in X.iterparse(io.BytesIO(data), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            X.register_namespace(prefix, uri)


def docx_with(content: bytes, new: dict[str, str]) -> bytes:
    """The document with paragraphs replaced by their text; the first run keeps its format and holds the new text."""
    changed = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in _docx_parts(archive):
            data = archive.read(name)
            _keep_prefixes(data)
            root, touched = X.fromstring(data), False
            for paragraph, _ in _walk(root):
                runs = list(_runs(paragraph))
                if runs and (text := new.get(_said(paragraph))) is not None:
                    for i, run in enumerate(runs):
                        for t in [t for t in run if t.tag == W + "t" or t.tag in _BREAKS]:
                            run.remove(t)
                        if not i:
                            X.SubElement(run, W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = _clean(text)
                    touched = True
            if touched:
                changed[name] = X.tostring(root, "utf-8", xml_declaration=True)
    return _repack(content, changed)


def xlsx_with(content: bytes, new: dict[str, str]) -> bytes:
    """The workbook with the string cells that the mapping names replaced; formulas stay."""
    changed = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = _shared(archive)
        for _, part in _sheets(archive):
            data = archive.read(part)
            _keep_prefixes(data)
            root, touched = X.fromstring(data), False
            for cell in root.iter(S + "c"):
                value, kind = _cell(cell, shared)
                if kind == "string" and cell.find(S + "f") is None and value in new:
                    for child in list(cell):
                        cell.remove(child)
                    cell.set("t", "inlineStr")
                    X.SubElement(X.SubElement(cell, S + "is"), S + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = _clean(new[value])
                    touched = True
            if touched:
                changed[part] = X.tostring(root, "utf-8", xml_declaration=True)
    return _repack(content, changed)


def rewritten(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """path, content of files (path, content) with texts replaced by mapping (path, src, tgt): a file's own pairs only reach its task."""
    pairs = mapping.filter("src IS NOT NULL AND tgt IS NOT NULL").groupBy("path", "src").agg(F.min("tgt").alias("tgt"))
    pairs = pairs.groupBy("path").agg(F.collect_list("src").alias("src"), F.collect_list("tgt").alias("tgt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, src, tgt in zip(*(batch.column(i) for i in range(4)), strict=True):
                make = docx_with if path.as_py().lower().endswith(".docx") else xlsx_with
                out = make(content.as_py(), dict(zip(src.as_py(), tgt.as_py(), strict=True)))
                yield pa.record_batch([pa.array([path.as_py()]), pa.array([out], pa.binary())], ["path", "content"])

    return files.select("path", "content").join(pairs, "path").select("path", "content", "src", "tgt").mapInArrow(run, "path string, content binary")


_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def new_docx(lines: list[str]) -> bytes:
    X.register_namespace("w", W[1:-1])
    root = X.Element(W + "document")
    body = X.SubElement(root, W + "body")
    for line in lines:
        run = X.SubElement(X.SubElement(body, W + "p"), W + "r")
        X.SubElement(run, W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = _clean(line)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", _TYPES)
        archive.writestr("_rels/.rels", _RELS)
        archive.writestr("word/document.xml", X.tostring(root, "utf-8", xml_declaration=True))
    return out.getvalue()


def as_docx(pairs: DataFrame, bilingual: bool = False) -> DataFrame:
    """path, content: one document for each path of pairs (path, ord, src, tgt), of targets, or of sources and targets in turn."""
    line = F.array("src", "tgt") if bilingual else F.array("tgt")
    lines = pairs.groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [new_docx([x or "" for x in lines]) for lines in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return lines.mapInArrow(run, "path string, content binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path: a relative one, content) below a shared folder; returns path, bytes. A retried task replaces its files whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (pafs.LocalFileSystem(), folder) if "://" not in folder else pafs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = f"{base.rstrip('/')}/{path}"
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                part = f"{to.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, to)
                sizes.append(len(content))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
