"""Office documents, CSV and PDF to markdown, from binary columns."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.functions import predicates
from tidemill.operators.batches import map_rows, spread

PDF_CEILING = 50 * 1024 * 1024
RESULT = "markdown string, title string, author string, description string, error_kind string, error string, partial boolean"


class DocumentError(Exception):
    pass


def docx_markdown(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml")
    except (zipfile.BadZipFile, KeyError, zlib.error) as e:
        raise DocumentError(f"DOCX: {e}") from e
    out: list[str] = []
    text: list[str] = []
    flags = {"p": False, "pPr": False, "r": False, "t": False}
    level = 0

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal level
        local = name.rpartition(":")[2]
        if local == "p" and name in ("p", "w:p"):
            flags["p"], level = True, 0
            text.clear()
        elif local == "pStyle" and flags["pPr"]:
            style = next((v.lower() for k, v in attrs.items() if k.rpartition(":")[2] == "val"), "")
            m = re.fullmatch(r"heading(\d{1,3})", style)
            level = 1 if style == "title" else min(int(m[1]), 6) if m else 0
        elif local in ("pPr", "r") and flags["p"]:
            flags[local] = True
        elif local == "t" and flags["r"]:
            flags["t"] = True
        elif local in ("br", "tab") and flags["p"]:
            text.append("\n" if local == "br" else "\t")

    def end(name: str) -> None:
        local = name.rpartition(":")[2]
        if local == "p" and flags["p"]:
            line = "".join(text).strip()
            if line:
                out.append(f"{'#' * level} {line}" if level else line)
        if local in flags:
            flags[local] = False
        if local == "r":
            flags["t"] = False

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda x: text.append(x) if flags["t"] else None
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise DocumentError(f"DOCX: {e}") from e
    return "\n\n".join(out)


def table(rows: list[list[str]]) -> str:
    """Rows as a markdown table, the first as its head."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    written = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([written[0], f"| {' | '.join(['---'] * width)} |", *written[1:]])


def csv_rows(text: str) -> list[list[str]]:
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted, k = False, 0

    def close() -> None:
        row.append("".join(cell).strip())
        cell.clear()

    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell.append('"')
                k += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"':
            quoted = True
        elif c in ",\n":
            close()
            if c == "\n":
                rows.append(row)
                row = []
        elif c != "\r":
            cell.append(c)
        k += 1
    if cell or row:
        close()
        rows.append(row)
    return [r for r in rows if any(r)]


def csv_markdown(data: bytes) -> str:
    rows = csv_rows(data.decode("utf-8", "replace"))
    return table(rows) if rows else "(empty CSV)"


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 2**63 else repr(value)


def xlsx_markdown(data: bytes) -> str:
    """Each sheet that has cells, as a table under its name."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            read = lambda name: ElementTree.fromstring(z.read(name))
            tag = lambda e: e.tag.rpartition("}")[2]
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in read("xl/sharedStrings.xml")]
            targets = {r.get("Id"): r.get("Target", "") for r in read("xl/_rels/workbook.xml.rels")}
            out = []
            for sheet in (s for s in read("xl/workbook.xml").iter() if tag(s) == "sheet"):
                target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None), "")
                rows = _cells(read(target[1:] if target.startswith("/") else f"xl/{target}"), shared, tag)
                if rows:
                    out.append(f"## Sheet: {sheet.get('name')}\n\n{table(rows)}")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, zlib.error) as e:
        raise DocumentError(f"XLSX: {e}") from e
    return "\n\n".join(out) or "(empty spreadsheet)"


def _cells(sheet: ElementTree.Element, shared: list[str], tag: Any) -> list[list[str]]:
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(x for x in sheet.iter() if tag(x) == "row"):
        for c, cell in enumerate(x for x in row if tag(x) == "c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
            across = 0
            for letter in m[1] if m else "":
                across = across * 26 + ord(letter) - 64
            at = (int(m[2]) - 1, across - 1) if m else (r, c)
            value = next((v.text or "" for v in cell if tag(v) == "v"), None)
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                grid[at] = "".join(t.text or "" for t in cell.iter() if tag(t) == "t")
            elif value is not None:
                words = {"s": lambda v: shared[int(v)], "b": lambda v: "true" if v == "1" else "false", "n": _number}
                grid[at] = words.get(kind, str)(value)
    if not grid:
        return []
    top, left = min(r for r, _ in grid), min(c for _, c in grid)
    bottom, right = max(r for r, _ in grid), max(c for _, c in grid)
    return [[grid.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _literal(raw: str) -> str:
    def one(m: re.Match[str]) -> str:
        return chr(int(m[1], 8) & 255) if m[1][0].isdigit() else _ESCAPES.get(m[1], m[1])

    return re.sub(r"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode() + "0" * (len(re.sub(rb"[^0-9A-Fa-f]", b"", raw)) % 2))
    else:
        data = _literal(raw[1:-1].decode("latin-1")).encode("latin-1", "replace")
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def read_pdf(data: bytes, mode: str = "auto") -> dict[str, Any]:
    """Text and metadata of a PDF; partial, as only plain content streams are read. auto fails on empty text, fast doesn't."""
    if not data.startswith(b"%PDF-"):
        raise DocumentError("not a PDF: header missing")
    if len(data) > PDF_CEILING:
        raise DocumentError("PDF over the size ceiling")
    about = {}
    for key, name in (("title", b"Title"), ("author", b"Author"), ("description", b"Subject")):
        m = re.search(rb"/" + name + rb"\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", data, re.S)
        about[key] = (_pdf_string(m[1]).strip() if m else "") or None
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        if b"FlateDecode" in data[max(0, m.start() - 300) : m.start()]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        found = []
        for t in re.finditer(rb"\[((?:\((?:\\.|[^\\)])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\)])*\))\s*(?:Tj|'|\")|(T\*|(?:Td|TD|ET)\b)", body, re.S):
            if t[3]:
                found.append("\n")
            else:
                found += [_pdf_string(x) for x in re.findall(rb"\((?:\\.|[^\\)])*\)", t[1] if t[1] is not None else t[2], re.S)]
        text = re.sub(r"\s*\n\s*", "\n", "".join(found)).strip()
        if text:
            pages.append(text)
    text = "\n\n".join(pages)
    if not text and mode == "auto":
        raise DocumentError("no text: the pages may be images")
    head = f"# {about['title']}\n\n" if about["title"] else ""
    return about | {"markdown": head + text, "partial": True}


def read_document(kind: str | None, data: bytes | None, mode: str = "auto") -> dict[str, Any]:
    data = bytes(data or b"")
    try:
        if kind == "pdf":
            return read_pdf(data, mode)
        if kind == "xls":
            raise DocumentError("the old binary workbook format is not supported")
        reader = {"docx": docx_markdown, "xlsx": xlsx_markdown, "csv": csv_markdown}.get(kind or "")
        if reader is None:
            raise DocumentError(f"unknown kind of document: {kind}")
        return {"markdown": reader(data), "partial": False}
    except DocumentError as e:
        return {"error_kind": "document", "error": str(e)}


def documents(files: DataFrame, mode: str = "auto") -> DataFrame:
    """Rows of path (or url), mime and content to markdown; failures are rows."""
    from pyspark.sql.types import StructType

    place = F.coalesce(*(F.col(c) for c in ("url", "path") if c in files.columns))
    mime = F.col("mime") if "mime" in files.columns else F.lit("")
    pdf = (F.trim(F.lower(F.split(mime, ";")[0])) == "application/pdf") | F.lower(place).rlike(r"\.pdf($|\?)")
    rows = spread(files).withColumn("kind", F.when(pdf, "pdf").otherwise(predicates.document_kind(F.coalesce(mime, F.lit("")), place))).withColumn("_kind", F.col("kind"))
    return map_rows(rows, ["_kind", "content"], lambda k, c: read_document(k, c, mode), StructType.fromDDL(RESULT))


def pdf_rows(files: DataFrame, mode: str = "auto") -> DataFrame:
    """PDF rows in the shape of extracted pages: metadata and content."""
    rows = documents(files, mode)
    meta = {"title": F.col("title"), "author": F.col("author"), "description": F.col("description"), "word_count": predicates.word_count(F.col("markdown"))}
    cast = {f.name: f.dataType for f in schemas.METADATA}
    fields = [meta.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in cast.items()]
    return rows.withColumn("metadata", F.struct(*fields))
