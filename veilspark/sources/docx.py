"""DOCX files to spans: runs of body, tables, headers, footers and text boxes, with pages and lines counted as read.

Order: body in document order, then each section's header and footer, then text boxes (the whole body is searched once a
section, so a document with n sections yields each box n times). Lines and pages are counted on through all of these. A page
ends with a paragraph that holds a page break, or after 40 lines of body paragraphs; tables, headers and boxes
never end one.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from .extraction import Info, extract, info_of, native_spans

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LINES, LINE_HEIGHT, LINE_WIDTH = 40, 14.0, 500.0
#: Bytes that the parts of a file may unpack to, all together: a small file may claim, or hide, any number.
MOST_UNPACKED = 128 << 20
BLACK, WHITE = (0, 0, 0), (255, 255, 255)

# Colours of highlight names.
HIGHLIGHTS = {
    "yellow": (255, 255, 0),
    "bright_green": (0, 255, 0),
    "turquoise": (0, 255, 255),
    "pink": (255, 192, 203),
    "blue": (0, 0, 255),
    "red": (255, 0, 0),
    "dark_blue": (0, 0, 139),
    "teal": (0, 128, 128),
    "green": (0, 128, 0),
    "violet": (238, 130, 238),
    "dark_red": (139, 0, 0),
    "dark_yellow": (204, 204, 0),
    "gray_50": (128, 128, 128),
    "gray_25": (192, 192, 192),
}
# Names that the file format gives highlights, where they differ from the names above.
XML_NAMES = {"green": "bright_green", "cyan": "turquoise", "magenta": "pink", "darkBlue": "dark_blue", "darkCyan": "teal", "darkGreen": "green", "darkMagenta": "violet", "darkRed": "dark_red", "darkYellow": "dark_yellow", "darkGray": "gray_50", "lightGray": "gray_25"}


class _Walk:
    def __init__(self, highlight_mode: str) -> None:
        self.mode, self.page, self.line, self.spans = highlight_mode, 1, 0, []

    def paragraph(self, p) -> None:
        top = LINE_HEIGHT * self.line
        for run in p.findall(f"{_W}r"):
            text = run_text(run)
            if text.strip():
                size, fg, bg = run_format(run, self.mode)
                self.spans.append((len(self.spans), text, self.page, (0.0, top, LINE_WIDTH, top + LINE_HEIGHT), size, fg, bg))
        self.line += 1

    def body_paragraph(self, p) -> None:
        self.paragraph(p)
        broken = any(b.get(f"{_W}type") == "page" for b in p.iter(f"{_W}br"))
        if broken or self.line >= LINES:
            self.page, self.line = self.page + 1, 0

    def table(self, t) -> None:
        for row in t.findall(f"{_W}tr"):
            for cell in row.findall(f"{_W}tc"):
                for p in cell.findall(f"{_W}p"):
                    self.paragraph(p)


def run_text(run) -> str:
    out = []
    for x in run:
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr") and x.get(f"{_W}type") in (None, "textWrapping"):
            out.append("\n")
    return "".join(out)


def run_format(run, highlight_mode: str) -> tuple:
    props = run.find(f"{_W}rPr")
    value = lambda tag: None if props is None or (x := props.find(f"{_W}{tag}")) is None else x.get(f"{_W}val")
    size, color, light = value("sz"), value("color"), value("highlight")
    fg = tuple(int(color[k : k + 2], 16) for k in (0, 2, 4)) if color and len(color) == 6 else BLACK
    bg = HIGHLIGHTS.get(XML_NAMES.get(light, light), WHITE) if highlight_mode == "literal" and light else WHITE
    return (float(size) / 2 if size else None), fg, bg


class _Parts:
    """The parts of a file, unpacked within MOST_UNPACKED bytes whatever their headers say."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.zip, self.names, self.left = z, set(z.namelist()), MOST_UNPACKED

    def read(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > self.left:
            raise ValueError(f"{name} unpacks to too many bytes")
        with self.zip.open(name) as part:
            found = part.read(self.left + 1)
        self.left -= len(found)
        if self.left < 0:
            raise ValueError(f"{name} unpacks to too many bytes")
        return found


def read_docx(content: bytes, highlight_mode: str = "white") -> list[tuple]:
    """(span_seq, text, page, (x0, y0, x1, y1), size, fg, bg) of a file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        z = _Parts(archive)
        root = ElementTree.fromstring(z.read("word/document.xml"))
        rels = {}
        if "word/_rels/document.xml.rels" in z.names:
            # targets are relative to the document's folder, or absolute
            rels = {r.get("Id"): posixpath.normpath(posixpath.join("/word", r.get("Target") or "")).lstrip("/") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        body, walk = root.find(f"{_W}body"), _Walk(highlight_mode)
        for x in body:
            if x.tag == f"{_W}p":
                walk.body_paragraph(x)
            elif x.tag == f"{_W}tbl":
                walk.table(x)
        sections = list(body.iter(f"{_W}sectPr"))
        parts: dict[str, str] = {}
        for section in sections:
            for kind in ("header", "footer"):
                for ref in section.findall(f"{_W}{kind}Reference"):
                    if ref.get(f"{_W}type", "default") == "default":
                        parts[kind] = rels.get(ref.get(f"{_R}id"))  # a section without its own keeps the one before
                if parts.get(kind) in z.names:
                    for p in ElementTree.fromstring(z.read(parts[kind])).findall(f"{_W}p"):
                        walk.paragraph(p)
        for _ in sections:
            for box in body.iter(f"{_W}txbxContent"):
                for p in box.iter(f"{_W}p"):
                    walk.paragraph(p)
        return walk.spans


def read_file(content: bytes, highlight_mode: str = "white") -> tuple[list[tuple], Info]:
    spans = read_docx(content, highlight_mode)
    return spans, info_of(spans)


def docx_spans(files: DataFrame, c: Config = DEFAULT) -> DataFrame:
    mode = c.highlight_mode
    return native_spans(extract(files, lambda content: read_file(content, mode)))
