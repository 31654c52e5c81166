"""Text of documents: which extractor takes a file, what it gives, and the record of each attempt.

Plain text stays in the JVM. Formats that need a parser run in Arrow batches on the executors, with the standard library's
zip, XML and HTML readers; formats that need more (PDF, pictures) go to whoever is registered for them, else they are recorded as failures. Who reads
pictures is also given those inside office files.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.instants import as_column
from ..sources.shipping import ship
from . import legacy_sheets
from .queues import UNSUPPORTED

OFFICE = "application/vnd.openxmlformats-officedocument."
#: The extractors in the order in which they are asked, with media types and extensions.
FORMATS = {
    "plain_text": (("text/plain", "text/uri-list"), (".txt",)),
    "html_text": (("text/html",), (".html", ".htm")),
    "pdf_hybrid": (("application/pdf",), (".pdf",)),
    "docx": ((OFFICE + "wordprocessingml.document",), (".docx",)),
    "pptx": ((OFFICE + "presentationml.presentation", OFFICE + "presentationml.slideshow"), (".pptx", ".ppsx")),
    "xlsx": ((OFFICE + "spreadsheetml.sheet", "application/vnd.ms-excel.sheet.macroEnabled.12"), (".xlsx", ".xlsm")),
    "xls": (("application/vnd.ms-excel",), (".xls",)),
    "odt": (("application/vnd.oasis.opendocument.text",), (".odt",)),
    "ods": (("application/vnd.oasis.opendocument.spreadsheet",), (".ods",)),
    "image_ocr": (("image/png", "image/jpeg", "image/jpg", "image/gif", "image/webp", "image/bmp", "image/tiff"), (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif")),
}
VERSIONS = {"html_text": "2"}
IMAGES = 20
ANGLES = np.arange(-30, 30.5, 0.5)
RESULT = "extractor_name string, extractor_version string, status string, error_reason string, extracted_text string, metadata string"


def extractor(mimetype: Column | str, extension: Column | str, pictures: bool = False) -> Column:
    """The first extractor whose media types or extensions hold these; unsupported when there is none. Pictures have one only where an OCR engine is given."""
    m, e, out = as_column(mimetype), as_column(extension), F.lit(UNSUPPORTED)
    for name, (types, extensions) in reversed(FORMATS.items()):
        if name != "image_ocr" or pictures:
            out = F.when(m.isin(*types) | e.isin(*extensions), F.lit(name)).otherwise(out)
    return out


# --- parsers ----------------------------------------------------------------------------------------


@dataclass
class Extracted:
    text: str
    metadata: dict = field(default_factory=dict)


class _Events(HTMLParser):
    """A page as a list of what its parser met: begin, end and text, in order."""

    def __init__(self):
        super().__init__()
        self.met: list[tuple[str, str, list]] = []

    def handle_starttag(self, tag, attrs):
        self.met.append(("begin", tag, attrs))

    def handle_endtag(self, tag):
        self.met.append(("end", tag, []))

    def handle_data(self, data):
        self.met.append(("text", data, []))


HIDDEN = ("script", "style")


def _shown(events: Iterable[tuple[str, str, list]]) -> Iterable[tuple[str, str]]:
    """What a reader of the page gets, as kind and text: text nodes and descriptions of pictures outside scripts and styles."""
    inside = 0
    for kind, what, attrs in events:
        if what in HIDDEN and kind != "text":
            inside = max(0, inside + (1 if kind == "begin" else -1))
        elif not inside and kind == "text":
            yield "text", what.strip()
        elif not inside and kind == "begin":
            yield from (("described", (value or "").strip()) for name, value in attrs if name == "alt")


def html_text(data: bytes) -> Extracted:
    """Visible text of a page, a line for each node. The parser is not closed, so what is cut off at the end stays out."""
    raw = data.decode("utf-8")
    page = _Events()
    page.feed(raw)
    shown = [(kind, line) for kind, line in _shown(page.met) if line]
    text = "\n".join(line for _, line in shown)
    return Extracted(text, {"char_count": len(text), "raw_char_count": len(raw), "tag_count": sum(kind == "begin" for kind, *_ in page.met), "attribute_chunks": sum(kind == "described" for kind, _ in shown)})


def plain_text(data: bytes) -> Extracted:
    text = data.decode("utf-8")
    return Extracted(text, {"char_count": len(text)})


class Archive:
    """A zip container of which members are read only within limits. The total counts what was read."""

    def __init__(self, data: bytes):
        self.zip, self.total = zipfile.ZipFile(io.BytesIO(data)), 0

    def named(self, start: str, end: str = "") -> list[zipfile.ZipInfo]:
        return sorted((m for m in self.zip.infolist() if m.filename.startswith(start) and m.filename.endswith(end)), key=lambda m: m.filename)

    def refused(self, m: zipfile.ZipInfo) -> str | None:
        if m.file_size > rules.MEMBER_BYTES:
            return f"{m.file_size} bytes; the limit is {rules.MEMBER_BYTES}"
        if m.compress_size and m.file_size > rules.MEMBER_RATIO * m.compress_size:
            return f"expands over {rules.MEMBER_RATIO} times"
        if self.total + m.file_size > rules.TOTAL_BYTES:
            return f"over {rules.TOTAL_BYTES} bytes in all"
        return None

    def read(self, m: zipfile.ZipInfo | str) -> bytes:
        m = self.zip.getinfo(m) if isinstance(m, str) else m
        if why := self.refused(m):
            raise ValueError(f"{m.filename}: {why}")
        self.total += m.file_size
        return self.zip.read(m)

    def xml(self, m: zipfile.ZipInfo | str) -> ElementTree.Element:
        return ElementTree.fromstring(self.read(m))


def _own(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e: ElementTree.Element, name: str) -> Iterable[ElementTree.Element]:
    return (x for x in e.iter() if _own(x) == name)


def _run_text(e: ElementTree.Element) -> str:
    """Text of a paragraph of a word-processing document."""
    plain = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join(x.text or "" if _own(x) == "t" else plain.get(_own(x), "") for x in e.iter())


Reader = Callable[[bytes], str]


def _with_pictures(made: Extracted, data: bytes, folder: str, read: Reader | None) -> Extracted:
    """made with the texts of the file's pictures behind its own, and what became of each; without a reader only that there was none."""
    made.metadata["embedded_images_ocr"] = None
    if read:
        texts, made.metadata["embedded_images_ocr"] = embedded_images(data, folder, read)
        made.text = "\n\n".join([made.text, *texts])
    return made


def docx_text(data: bytes, read: Reader | None = None) -> Extracted:
    """Paragraphs of the body, then cells of its tables, then what `read` finds in its pictures."""
    root = Archive(data).xml("word/document.xml")
    body = next(iter(_all(root, "body")))
    paragraphs = [e for e in body if _own(e) == "p"]
    tables = [e for e in body if _own(e) == "tbl"]
    parts = [_run_text(p) for p in paragraphs]
    for t in tables:
        for row in (r for r in t if _own(r) == "tr"):
            parts += ["\n".join(_run_text(p) for p in cell if _own(p) == "p") for cell in row if _own(cell) == "tc"]
    made = Extracted("\n".join(parts), {"method": "native", "paragraphs": len(paragraphs), "tables": len(tables), "images_embedded": sum(1 for _ in _all(body, "inline"))})
    return _with_pictures(made, data, "word/media/", read)


def pptx_text(data: bytes, read: Reader | None = None) -> Extracted:
    """Slides in the order of their file names; unreadable ones are left out but counted. Then what `read` finds in their pictures."""
    archive, parts = Archive(data), []
    slides = archive.named("ppt/slides/slide", ".xml")
    for m in slides:
        if not archive.refused(m):
            try:
                parts.append("".join(archive.xml(m).itertext()))
            except ElementTree.ParseError:
                continue
    return _with_pictures(Extracted("\n".join(parts), {"method": "manual_ooxml", "slides": len(slides)}), data, "ppt/media/", read)


def _sheets(sheets: Iterable[tuple[str, Iterable[list[str]]]], count: str) -> Extracted:
    lines, cells, n = [], 0, 0
    for name, rows in sheets:
        n += 1
        lines.append(f"# {name}")
        for row in rows:
            if row:
                cells += len(row)
                lines.append(" | ".join(row))
    return Extracted("\n".join(lines), {"method": "native", count: n, "cells": cells})


def _number(raw: str) -> str:
    """A stored number as it is shown: whole ones without a point."""
    try:
        return str(int(raw)) if re.fullmatch(r"-?\d+", raw) else str(float(raw))
    except ValueError:
        return raw


#: Numbers of the formats of dates and times that need no description in the file.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or time: a letter for one outside quotes, escapes, colours and conditions."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^]]*\]', "", code.lower())
    return "general" not in bare and bool(re.search("[dmyhs]", bare.split(";")[0]))


def _date_styles(archive: Archive, names: set[str]) -> set[int]:
    """The cell styles whose numbers are dates."""
    if "xl/styles.xml" not in names:
        return set()
    root = archive.xml("xl/styles.xml")
    own = {int(f.attrib["numFmtId"]) for f in _all(root, "numFmt") if _is_date(f.attrib.get("formatCode", ""))}
    told = {int(f.attrib["numFmtId"]) for f in _all(root, "numFmt")}
    formats = next(iter(_all(root, "cellXfs")), ())
    return {i for i, x in enumerate(formats) if (n := int(x.attrib.get("numFmtId", 0))) in own or n in DATE_FORMATS - told}


def _date(raw: str, from_1904: bool) -> str:
    """A serial day as it is: date with time, or the time alone of less than a day."""
    try:
        days = float(raw)
        if 0 <= days < 1:
            return str((datetime(1900, 1, 1) + timedelta(seconds=round(days * 86400))).time())
        base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if days >= 60 else 31)  # 1900 has a leap day there
        return str(base + timedelta(days=int(days // 1), seconds=round(days % 1 * 86400)))
    except (ValueError, OverflowError):
        return raw


def xlsx_text(data: bytes) -> Extracted:
    """Sheets in the workbook's order, cached values of formulas, dates as such, a line for each row that has any."""
    archive = Archive(data)
    names = {m.filename for m in archive.zip.infolist()}
    targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in archive.xml("xl/_rels/workbook.xml.rels")}
    dates, book = _date_styles(archive, names), archive.xml("xl/workbook.xml")
    from_1904 = any(x.attrib.get("date1904") in ("1", "true") for x in _all(book, "workbookPr"))
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in archive.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []

    def value(c: ElementTree.Element) -> str | None:
        kind = c.attrib.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _all(c, "t"))
        v = next((x.text for x in c if _own(x) == "v"), None)
        if v is None:
            return None
        return shared[int(v)] if kind == "s" else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v if kind in ("str", "e", "d") else _date(v, from_1904) if int(c.attrib.get("s", 0)) in dates else _number(v)

    def sheets():
        for s in _all(book, "sheet"):
            target = targets[_attribute(s, "id")]
            root = archive.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            yield s.attrib["name"], ([v for c in row if _own(c) == "c" and (v := value(c)) is not None] for row in _all(root, "row"))

    return _sheets(sheets(), "sheets")


def xls_text(data: bytes) -> Extracted:
    """Worksheets of a legacy workbook; numbers, dates among them, as they are stored: with a point."""
    try:
        return _sheets(legacy_sheets.sheets(data), "sheets")
    except (struct.error, IndexError) as e:
        raise ValueError(f"a broken workbook: {e}") from e


def _open_text(e: ElementTree.Element) -> str:
    """Text of a paragraph of an OpenDocument file."""
    out = [e.text or ""]
    for x in e:
        out.append(" " * int(_attribute(x, "c") or 1) if _own(x) == "s" else {"tab": "\t", "line-break": "\n"}.get(_own(x)) or _open_text(x))
        out.append(x.tail or "")
    return "".join(out)


def odt_text(data: bytes) -> Extracted:
    parts = [_open_text(p) for p in _all(Archive(data).xml("content.xml"), "p")]
    return Extracted("\n".join(parts), {"method": "native", "paragraphs": len(parts)})


def ods_text(data: bytes) -> Extracted:
    root = Archive(data).xml("content.xml")
    rows = lambda t: ([v for c in _all(r, "table-cell") if (v := " ".join(_open_text(p) for p in _all(c, "p")))] for r in _all(t, "table-row"))
    return _sheets(((_attribute(t, "name"), rows(t)) for t in _all(root, "table")), "tables")


def embedded_images(data: bytes, folder: str, ocr: Callable[[bytes], str], most: int = IMAGES) -> tuple[list[str], list[dict]]:
    """Texts of pictures in an office file, and what became of each: done, failed, skipped; the last entry says so when there were more."""
    texts: list[str] = []
    told: list[dict] = []
    try:
        archive = Archive(data)
    except zipfile.BadZipFile:
        return texts, told
    found = archive.named(folder)
    for m in found[:most]:
        if why := archive.refused(m):
            told.append({"file": m.filename, "status": "skipped", "reason": why})
            continue
        try:
            text = ocr(archive.read(m))
        except Exception as e:  # noqa: BLE001 - one picture never stops the rest
            told.append({"file": m.filename, "status": "failed", "error": f"{type(e).__name__}: {e}"})
            continue
        if text.strip():
            texts.append(f"[{m.filename}]\n{text}")
        told.append({"file": m.filename, "status": "done", "chars": len(text)})
    if len(found) > most:
        told.append({"truncated": True, "total_embedded_images": len(found), "processed": most})
    return texts, told


def pages_result(pages: list[str], ocr_pages: Callable[[], list[str]] | None = None) -> Extracted:
    """A paged document's text: the native one if sufficient, else that of OCR, else none but a flag."""
    lengths = sorted(map(len, pages))
    enough = bool(lengths) and lengths[len(lengths) // 2] >= rules.NATIVE_CHARS
    told = {"method": "native", "pages": len(pages), "native_chars": sum(lengths), "sufficient_text": enough}
    if enough:
        return Extracted("\n".join(pages), told)
    if ocr_pages is None:
        return Extracted("", told | {"scanned": True, "ocr_available": False})
    return Extracted("\n".join(ocr_pages()), told | {"method": "ocr", "scanned": True, "ocr_available": True})


def skew(gray: np.ndarray, angles: np.ndarray = ANGLES, most: int = 500) -> float:
    """The angle in degrees at which the rows of a grey picture tell dark from light best.

    The picture is thinned to `most` pixels a side; instead of turning it, dark pixels are dealt to the rows that they
    would turn to, so that an angle costs one count of them.
    """
    step = max(1, -(-max(gray.shape) // most))
    small = gray[::step, ::step].astype(np.float32)
    y, x = np.nonzero(small < small.mean() - 0.15 * small.std())
    if not len(y):
        return 0.0
    best, score = 0.0, -1.0
    for a in angles:
        rows = np.round(y * np.cos(np.deg2rad(a)) - x * np.sin(np.deg2rad(a))).astype(int)
        counts = np.bincount(rows - rows.min()).astype(np.float64)
        if (spread := counts.var()) > score:
            best, score = float(a), spread
    return best


PARSERS: dict[str, Callable[[bytes], Extracted]] = {"plain_text": plain_text, "html_text": html_text, "docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "xls": xls_text, "odt": odt_text, "ods": ods_text}
_MODELS: dict[str, object] = {}


def register(name: str, parser: Callable[[bytes], Extracted]) -> None:
    """Gives a format its parser, say one that needs a library or an OCR engine. That of image_ocr is also given the pictures inside office files."""
    if name not in FORMATS:
        raise ValueError(f"no such format: {name}")
    PARSERS[name] = parser


def per_worker(name: str, make: Callable[[], Callable[[bytes], Extracted]]) -> Callable[[bytes], Extracted]:
    """A parser that needs something large, a model say, which each Python worker makes once, when it first needs it."""

    def parser(data: bytes) -> Extracted:
        from quadrivo.operators import extraction

        if name not in extraction._MODELS:
            extraction._MODELS[name] = make()
        return extraction._MODELS[name](data)

    return parser


def supports(name: str, mimetype: str | None, extension: str) -> bool:
    """Whether a format takes files of a media type or an extension."""
    types, extensions = FORMATS[name]
    return mimetype in types or extension in extensions


# --- on tables --------------------------------------------------------------------------------------


def decoded(content: Column | str) -> Column:
    """Strict UTF-8 text of bytes; null when they are no such text."""
    return F.try_validate_utf8(as_column(content).cast("string"))


def extract(documents: DataFrame, content: str = "content", name: str = "extractor_name") -> DataFrame:
    """documents with the record of one attempt for each row (RESULT): done with text and metadata, or failed with the reason. A row's failure is its own."""
    parsers, versions = dict(PARSERS), dict(VERSIONS)
    keep = [c for c in documents.columns if c != content and c not in {f.split(" ")[0] for f in RESULT.split(", ")}]

    def attempt(data: bytes | None, kind: str) -> tuple:
        if kind == UNSUPPORTED:
            return kind, "1", "failed", "no extractor for this format", None, None
        if data is None:
            return "none", "1", "failed", "the stored content could not be read", None, None
        try:
            if kind not in parsers:
                raise NotImplementedError(f"no parser is registered for {kind}")
            parser, pictures = parsers[kind], parsers.get("image_ocr")
            made = parser(data, lambda picture: pictures(picture).text) if pictures and parser in (docx_text, pptx_text) else parser(data)
            return kind, versions.get(kind, "1"), "done", None, made.text, json.dumps(made.metadata)
        except Exception as e:  # noqa: BLE001 - the reason is the record
            return kind, versions.get(kind, "1"), "failed", f"{type(e).__name__}: {e}"[:1000], None, None

    def run(batches):
        for b in batches:
            rows = [attempt(None if d is None else bytes(d), k) for d, k in zip(b[content], b[name])]
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(rows, columns=[f.split(" ")[0] for f in RESULT.split(", ")])], axis=1)

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), RESULT])
    ship(documents.sparkSession)
    return documents.mapInPandas(run, schema)


def embedded_image_rows(documents: DataFrame, key: str, ocr: Callable[[bytes], str], content: str = "content", folder: str = "word/media/", most: int = IMAGES) -> DataFrame:
    """A row for each picture in each office file (key, file, status, chars, reason), and one with status truncated where there were more than `most`."""
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, file string, status string, chars long, reason string"

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[content]):
                for t in embedded_images(bytes(data), folder, ocr, most)[1] if data is not None else []:
                    rows.append((k, t.get("file"), t.get("status", "truncated"), t.get("chars"), t.get("reason") or t.get("error")))
            yield pd.DataFrame(rows, columns=[key, "file", "status", "chars", "reason"]).astype({"chars": "Int64"})

    ship(documents.sparkSession)
    return documents.select(key, content).mapInPandas(run, schema)
