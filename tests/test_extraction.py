import io
import json
import struct
import zipfile

import numpy as np
import pytest

from quadrivo.operators import extraction as x
from quadrivo.operators import legacy_sheets

PAGES = [
    ("<html><body><h2>Unit 4</h2><p>Waves carry energy.</p></body></html>", "Unit 4\nWaves carry energy."),
    ("<style>p{color:red}</style><script>track(1)</script><p>Only this shows</p>", "Only this shows"),
    ('<p>Before it</p><img src="wave.svg" alt="A sine wave"><p>behind it</p>', "Before it\nA sine wave\nbehind it"),
    ('<img alt=""><img alt="\t ">', ""),
    ('<iframe title="a frame"></iframe>', ""),
    ('<script><img alt="code, not a picture"></script><p>shown</p>', "shown"),
    ("<p>one</p>rest &y", "one"),
    ("<p>one</p>this & that &lt;", "one\nthis & that <"),
    ("<p>one</p><cut-off", "one"),
    ("<title>Lesson</title>text", "Lesson\ntext"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_html(page, text):
    if page.endswith("&lt;"):  # a reference at the very end waits for more
        assert x.html_text((page + "<br>").encode()).text == text
    else:
        assert x.html_text(page.encode()).text == text


def test_html_counts():
    assert x.html_text(b"<div><p>a</p><p>b</p></div>").metadata["tag_count"] == 3
    assert x.html_text(b'<img alt="q">').metadata["attribute_chunks"] == 1
    with pytest.raises(UnicodeDecodeError):
        x.plain_text(b"\xff")


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="w"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_office():
    table = f"<w:tbl><w:tr><w:tc>{P.format('c1')}</w:tc><w:tc>{P.format('c2')}</w:tc></w:tr></w:tbl>"
    made = x.docx_text(zipped(**{"word__document.xml": f"<w:document {W}><w:body>{P.format('one')}{table}<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>"}))
    assert made.text == "one\na\tb\nc1\nc2" and made.metadata["paragraphs"] == 2 and made.metadata["tables"] == 1
    slide = "<s><t>{}</t></s>"
    made = x.pptx_text(zipped(**{"ppt__slides__slide1.xml": slide.format("A"), "ppt__slides__slide2.xml": slide.format("B"), "ppt__slides__slide10.xml": slide.format("J"), "ppt__slides__slide3.xml": "<bad"}))
    assert made.text == "A\nJ\nB" and made.metadata["slides"] == 4
    book = {
        "xl__workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/><sheet name="E" r:id="b"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl__sharedStrings.xml": "<sst><si><t>hi</t></si><si><r><t>r</t></r><r><t>t</t></r></si></sst>",
        "xl__worksheets__s1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c><c><v>1.50</v></c></row><row><c/></row><row><c t="s"><v>1</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        "xl__worksheets__s2.xml": "<worksheet/>",
    }
    made = x.xlsx_text(zipped(**book))
    assert made.text == "# S\nhi | 12 | 1.5\nrt | True | in\n# E" and made.metadata == {"method": "native", "sheets": 2, "cells": 6}
    T = 'xmlns:text="t" xmlns:table="b"'
    made = x.odt_text(zipped(**{"content.xml": f'<o {T}><text:p>a<text:s text:c="2"/>b<text:tab/>c</text:p><text:p>d</text:p></o>'}))
    assert made.text == "a  b\tc\nd" and made.metadata["paragraphs"] == 2
    made = x.ods_text(zipped(**{"content.xml": f'<o {T}><table:table table:name="N"><table:table-row><table:table-cell><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell/></table:table-row></table:table></o>'}))
    assert made.text == "# N\na b" and made.metadata["cells"] == 1


def test_archive_limits():
    bomb = x.Archive(zipped(**{"ppt__media__a.png": b"0" * 10_000_000, "ppt__media__b.png": bytes(range(256))}))
    first, second = bomb.named("ppt/media/")
    assert "expands" in bomb.refused(first) and bomb.refused(second) is None
    texts, told = x.embedded_images(zipped(**{f"word__media__{i:02}.png": bytes([i]) * 3 for i in range(23)}), "word/media/", lambda b: {0: " "}.get(b[0]) or 1 / (b[0] - 1) and "t", 20)
    assert [t["status"] for t in told[:3]] == ["done", "failed", "done"] and told[-1] == {"truncated": True, "total_embedded_images": 23, "processed": 20} and len(texts) == 18
    assert x.embedded_images(b"no zip", "", str) == ([], [])


def test_embedded_image_rows(spark):
    good = zipped(**{f"word__media__{i}.png": bytes([i + 1]) for i in range(3)})
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no zip")), (3, None)], "id long, content binary")
    got = x.embedded_image_rows(df, "id", lambda b: "text", most=2).collect()
    assert [(r.id, r.status, r.chars) for r in got] == [(1, "done", 4), (1, "done", 4), (1, "truncated", None)]


def test_pages_and_skew():
    assert x.pages_result(["a" * 60] * 3).metadata["sufficient_text"] and x.pages_result([]).metadata["scanned"]
    assert x.pages_result(["", ""], lambda: ["o", "p"]).text == "o\np"
    page = np.full((300, 300), 255.0)
    y, xx = np.mgrid[:300, :300]
    page[(np.round(y * np.cos(np.deg2rad(8)) - xx * np.sin(np.deg2rad(8))).astype(int) % 20) < 4] = 0
    assert abs(x.skew(page) - 8) <= 1 and x.skew(np.zeros((5, 5))) == 0


def test_dispatch_and_attempts(spark):
    rows = [(1, "text/plain", ".pdf"), (2, None, ".htm"), (3, "application/pdf", ""), (4, None, ".png"), (5, None, None), (6, "image/png", ".txt"), (7, None, ".ppsx")]
    df = spark.createDataFrame(rows, "id long, m string, e string")
    got = {r.id: (r.a, r.b) for r in df.select("id", x.extractor("m", "e").alias("a"), x.extractor("m", "e", True).alias("b")).collect()}
    assert got == {1: ("plain_text",) * 2, 2: ("html_text",) * 2, 3: ("pdf_hybrid",) * 2, 4: ("unsupported", "image_ocr"), 5: ("unsupported",) * 2, 6: ("plain_text",) * 2, 7: ("pptx",) * 2}
    docs = spark.createDataFrame([(1, bytearray(b"hi"), "plain_text"), (2, bytearray(b"\xff"), "plain_text"), (3, None, "html_text"), (4, bytearray(b"x"), "unsupported"), (5, bytearray(b"x"), "pdf_hybrid"), (6, bytearray(b"x"), "docx")], "id long, content binary, extractor_name string")
    got = {r.id: r for r in x.extract(docs).collect()}
    assert got[1].status == "done" and json.loads(got[1].metadata) == {"char_count": 2}
    assert [got[i].status for i in range(2, 7)] == ["failed"] * 5
    assert got[2].error_reason.startswith("UnicodeDecodeError: ") and got[3].extractor_name == "none" and got[4].extractor_name == "unsupported" and got[6].error_reason.startswith("BadZipFile")
    assert [r.t for r in spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xff"),)], "b binary").select(x.decoded("b").alias("t")).collect()] == ["é", None]


# --- legacy workbooks --------------------------------------------------------------------------------


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def compound(stream, name="Workbook"):
    """A compound file of 512-byte sectors: the table of sectors first, then the directory, then one stream."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = legacy_sheets.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)

    def entry(title, kind, start, size):
        raw = title.encode("utf-16-le")
        return (raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<II", start, size)).ljust(128, b"\0")

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream))
    return head + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + stream


def workbook(*extra):
    words = ["Nombre", "Año", "naïve 日本", "cut here"]
    shared = struct.pack("<II", 5, 4)
    for w in words[:3]:
        wide = any(ord(c) > 255 for c in w)
        shared += struct.pack("<HB", len(w), wide) + w.encode("utf-16-le" if wide else "latin-1")
    shared += struct.pack("<HB", 8, 0) + b"cut "
    strings = record(0xFC, shared) + record(0x3C, b"\x01" + "here".encode("utf-16-le"))  # cut, and wide from there on
    globals_ = lambda at: record(0x809, bytes(16)) + b"".join(extra) + record(0x85, struct.pack("<IBBBB", at, 0, 0, 5, 0) + b"Hoja1") + strings + record(0x0A)
    cells = [
        record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), record(0x203, struct.pack("<HHHd", 1, 1, 0, 95.0)), record(0xFD, struct.pack("<HHHI", 1, 0, 0, 2)),
        record(0x27E, struct.pack("<HHHI", 3, 0, 0, (7 << 2) | 2)), record(0xBD, struct.pack("<HHHIHIH", 4, 0, 0, (1234 << 2) | 3, 0, (0xFFFFFFFE << 2 & 0xFFFFFFFF) | 2, 1)), record(0x205, struct.pack("<HHHBB", 5, 0, 0, 1, 0)),
        record(0x06, struct.pack("<HHHd", 5, 1, 0, 2.5) + bytes(8)), record(0x06, struct.pack("<HHH", 5, 2, 0) + b"\0" * 6 + b"\xff\xff" + bytes(8)), record(0x207, struct.pack("<HB", 3, 0) + b"sum"), record(0xFD, struct.pack("<HHHI", 6, 0, 0, 3)),
        record(0x809, bytes(16)) + record(0x203, struct.pack("<HHHd", 9, 9, 0, 1.0)) + record(0x0A),
    ]
    sheet = record(0x809, bytes(16)) + b"".join(cells) + record(0x0A)
    return compound(globals_(len(globals_(0))) + sheet)


def test_legacy_workbook():
    made = x.xls_text(workbook())
    assert made.text == "# Hoja1\nNombre | Año\nnaïve 日本 | 95.0\n7.0\n12.34 | -2.0\n1 | 2.5 | sum\ncut here" and made.metadata == {"method": "native", "sheets": 1, "cells": 11}
    for bad in (b"", b"PK", workbook()[:700], compound(b"\x09\x08", "Other"), workbook(record(0x2F, bytes(6)))):
        with pytest.raises(ValueError):
            x.xls_text(bad)
    rng, whole = np.random.default_rng(1), workbook()
    for _ in range(400):  # broken files end in an error, not in a loop
        data = bytearray(whole)
        for _ in range(3):
            data[rng.integers(0, len(data))] = rng.integers(0, 256)
        try:
            x.xls_text(bytes(data))
        except ValueError:
            pass


def test_dates_of_workbooks():
    def book(more="", cells='<c s="1"><v>45292</v></c><c s="2"><v>45292.75</v></c><c s="1"><v>0.5</v></c><c s="3"><v>45292</v></c><c><v>45292</v></c><c s="1"><v>1</v></c>'):
        return zipped(**{
            "xl__workbook.xml": f'<workbook xmlns:r="r">{more}<sheets><sheet name="S" r:id="a"/></sheets></workbook>',
            "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/></Relationships>',
            "xl__styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="[$-409]yyyy\\-mm;@"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;[Red]"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
            "xl__worksheets__s1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>",
        })

    assert x.xlsx_text(book()).text == "# S\n2024-01-01 00:00:00 | 2024-01-01 18:00:00 | 12:00:00 | 45292 | 45292 | 1900-01-01 00:00:00"
    assert x.xlsx_text(book('<workbookPr date1904="1"/>', '<c s="1"><v>0</v></c><c s="1"><v>366</v></c>')).text == "# S\n00:00:00 | 1905-01-01 00:00:00"


def test_pictures_are_read_when_someone_is_registered_for_them(spark, monkeypatch):
    """Pictures, and those inside office files; what reads them is made once for each worker; one that can't be read stops nothing."""
    monkeypatch.setattr(x, "PARSERS", dict(x.PARSERS))

    def make():
        def read(picture):
            if picture == b"bad":
                raise ValueError("no picture")
            return x.Extracted("read " + picture.decode(), {"method": "ocr"})

        return read

    x.register("image_ocr", x.per_worker("test", make))
    docx = zipped(**{"word__document.xml": f"<w:document {W}><w:body>{P.format('one')}</w:body></w:document>", "word__media__1.png": b"p1", "word__media__2.png": b"bad"})
    pptx = zipped(**{"ppt__slides__slide1.xml": "<s><t>A</t></s>", "ppt__media__1.png": b"p2"})
    docs = spark.createDataFrame([(1, bytearray(b"p0"), "image_ocr"), (2, bytearray(docx), "docx"), (3, bytearray(pptx), "pptx"), (4, bytearray(b"bad"), "image_ocr")], "id long, content binary, extractor_name string")
    got = {r.id: r for r in x.extract(docs).collect()}
    assert got[1].extracted_text == "read p0" and got[4].error_reason == "ValueError: no picture"
    assert got[2].extracted_text == "one\n\n[word/media/1.png]\nread p1" and [t["status"] for t in json.loads(got[2].metadata)["embedded_images_ocr"]] == ["done", "failed"]
    assert got[3].extracted_text == "A\n\n[ppt/media/1.png]\nread p2"
    assert x.docx_text(docx).metadata["embedded_images_ocr"] is None and x.supports("image_ocr", None, ".png") and not x.supports("xls", None, ".xlsx")
