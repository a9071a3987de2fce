"""Small DOCX and PDF files made from paragraphs and lines, for queries and tests that need files as input."""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run_xml(text: str, props: str = "") -> str:
    # characters that XML can't hold are left out
    text = "".join(c for c in text if c in "\t\n" or ord(c) >= 32 and c not in "￾￿")
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph_xml(*runs: str) -> str:
    return f"<w:p>{''.join(runs)}</w:p>"


def docx_bytes(body: str, headers: dict[str, str] | None = None, folder: str = "") -> bytes:
    """A file with this body XML; headers: part name to paragraphs, related by the ids rId1, rId2, ... under their names in `folder`."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        rels = ""
        for k, (name, xml) in enumerate((headers or {}).items(), 1):
            rels += f'<Relationship Id="rId{k}" Target="{folder}{name}"/>'
            z.writestr(f"word/{name}", f"<w:hdr {_NS}>{xml}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
    return out.getvalue()


def _stream(info: bytes, raw: bytes, flate: bool) -> bytes:
    packed = zlib.compress(raw) if flate else raw
    return b"<< %s /Length %d%s >>\nstream\n%s\nendstream" % (info, len(packed), b" /Filter /FlateDecode" if flate else b"", packed)


def pdf_file(objects: list[bytes], packed: bool = False, trailer: bytes = b"") -> bytes:
    """A file of these objects, numbered from 1; the first is the catalog. packed: all but the streams lie in an object stream, with a
    cross-reference stream, as files have it since version 1.5."""
    if not packed:
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Size %d %s >>\n%%%%EOF\n" % (len(objects) + 1, trailer)
    out, entries = b"%PDF-1.5\n", {0: (0, 0, 0)}
    inner = [(k, o) for k, o in enumerate(objects, 1) if b"stream" not in o]
    n = len(objects)
    for k, o in enumerate(objects, 1):
        if b"stream" in o:
            entries[k] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    heads, body = b"", b""
    for place, (k, o) in enumerate(inner):
        heads += b"%d %d " % (k, len(body))
        entries[k] = (2, n + 1, place)
        body += o + b"\n"
    entries[n + 1] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (n + 1, _stream(b"/Type /ObjStm /N %d /First %d" % (len(inner), len(heads)), heads + body, True))
    entries[n + 2] = (1, len(out), 0)
    table = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (entries[k] for k in range(n + 3)))
    out += b"%d 0 obj\n%s\nendobj\n" % (n + 2, _stream(b"/Type /XRef /Root 1 0 R /W [1 4 2] /Size %d %s" % (n + 3, trailer), table, True))
    return out + b"startxref\n%d\n%%%%EOF\n" % entries[n + 2][1]


def pdf_bytes(pages: list[str], flate: bool = True, packed: bool = False, resources: bytes = b"", more: list[bytes] = [], trailer: bytes = b"") -> bytes:
    """A file with these content streams, a page each. more: further objects, numbered from 3, which `resources` may refer to."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", *more]
    kids = []
    for content in pages:
        objects.append(_stream(b"", content.encode("cp1252", "replace"), flate))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /MediaBox [0 0 612 792] /Resources << %s >> /Kids [%s] /Count %d >>" % (resources, b" ".join(kids), len(kids))
    return pdf_file(objects, packed, trailer)


def unicode_font(text: str) -> tuple[dict[str, int], bytes, list[bytes]]:
    """Codes for a text's characters, and the resources and objects of a font of two-byte codes with a table of their characters."""
    codes = {c: k for k, c in enumerate(sorted(set(text)), 1)}
    lines = "".join(f"<{k:04x}> <{ord(c):04x}>\n" if c < "\ud800" else f"<{k:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, k in codes.items())
    table = f"1 begincodespacerange <0000> <ffff> endcodespacerange {len(codes)} beginbfchar\n{lines}endbfchar".encode()
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [<< /Subtype /CIDFontType2 /DW 500 >>] >>"
    return codes, b"/Font << /F1 3 0 R >>", [font, _stream(b"", table, True)]


def _digits(lines: list[str], codes: dict[str, int]) -> list[str]:
    """Strings of a page in a font's codes."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    known = np.array([ord(c) for c in codes], np.uint32)
    numbers = np.zeros(int(known.max(initial=0)) + 1, np.uint16)
    numbers[known] = list(codes.values())
    shown = numbers[points].astype(">u2").tobytes().hex()
    ends = list(itertools.accumulate(len(x) * 4 for x in lines))
    return [f"<{shown[a:b]}>" for a, b in zip([0, *ends], ends)]


def pdf_page(lines: list[str], codes: dict[str, int] | None = None, before: str = "0 g", size: float = 12.0, after: str = "", top: float = 720.0, step: float = 14.0) -> str:
    """The operators that show lines, in a font's codes or as plain strings."""
    plain = lambda x: "(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    shown = [plain(x) for x in lines] if codes is None else _digits(lines, codes)
    return f"BT /F1 {size:g} Tf {before} 72 {top:g} Td " + f" 0 -{step:g} Td ".join(f"{x} Tj" for x in shown) + f" ET {after}"


def docx_of(text: str, props: str = "") -> bytes:
    """A paragraph a line."""
    return docx_bytes("".join(paragraph_xml(run_xml(x, props)) for x in text.split("\n")))


def pdf_of(text: str, packed: bool = False, **page) -> bytes:
    """40 lines a page, whatever their characters."""
    lines = text.split("\n")
    codes, resources, more = unicode_font(text)
    return pdf_bytes([pdf_page(lines[k : k + 40], codes, **page) for k in range(0, len(lines), 40)], packed=packed, resources=resources, more=more)


def picture_pdf(text: str = "") -> bytes:
    """A page that a picture covers, with some text."""
    picture = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length 1 >>\nstream\n\x80\nendstream"
    return pdf_bytes(["q 612 0 0 792 0 0 cm /I1 Do Q " + pdf_page([text])], resources=b"/XObject << /I1 3 0 R >>", more=[picture])


def files_of(documents: DataFrame, made: Callable[[int, str], bytes]) -> DataFrame:
    """doc_id, content: the file that `made` makes of each document's id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                content = [made(i, t or "") for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")
