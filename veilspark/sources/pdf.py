"""PDF files to word spans, from the operators that paint their pages.

Text comes from the fonts' ToUnicode tables, else from their encodings; a character that neither tells is shown as (cid:n).
Characters are joined to words as they stand on the page: a word ends at white space, at a gap of over GAP points, on another
line, and where font, size or colour change. Words are ordered by lines within runs of one font and size.

Colours come from the graphics state: the fill colour (blended, if it is not opaque), and as background the last rectangle
filled below the word's middle, else white. Text that is painted in no colour (rendering modes 3 and 7), or that a later
rectangle covers, has its background's colour. Pictures are not looked at. Widths that a font doesn't tell are taken as half an em.

For the choice between native text and OCR, each file's page area and picture area are told as well.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from binascii import unhexlify
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .extraction import Columns, Info, extract, native_spans
from .pdf_objects import Document, Name, Reader, Stream, Word

GAP, SAME_LINE, EM, ASCENT = 3.0, 3.0, 0.5, 0.8
#: Coordinates up to which characters that follow each other are told at once, as rounding is far below GAP.
FAR = 1e9
#: Characters that are parted into pieces together.
CHARS = 1 << 16
#: Whether a character is white space, by its number; the last entry stands for all others.
_SPACES = np.array([chr(k).isspace() for k in range(0x3001)] + [False])
#: In a table of characters by code: a code that was not looked up yet, and one that isn't one character.
_UNKNOWN, _SEVERAL = 0xFFFFFFFF, 0xFFFFFFFE
_BIG_ENDIAN = np.dtype(">u2")
#: Levels of forms within forms.
FORMS = 20
LETTER = (0.0, 0.0, 612.0, 792.0)
WHITE, BLACK = (255, 255, 255), (0, 0, 0)
#: Entries of a ToUnicode stream from a code to its text, in whole bytes.
_PAIR = re.compile(rb"<([0-9A-Fa-f]*+)>\s*+<([0-9A-Fa-f]*+)>")
_PAIRS = re.compile(rb"\s*+(?:<(?:[0-9A-Fa-f]{2})*+>\s*+<(?:[0-9A-Fa-f]{2})*+>\s*+)*+(?=endbfchar\b)")
_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

# Names of glyphs that are not spelled like their characters' Unicode names.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{",
    "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚",
    "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "fi": "fi", "fl": "fl",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "lslash": "ł",
    "Lslash": "Ł", "dotlessi": "ı", "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®",
    "trademark": "™", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "exclamdown": "¡", "questiondown": "¿", "guillemotleft": "«",
    "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "minus": "−", "mu": "µ", "periodcentered": "·", "nbspace": "\xa0",
}
# Accents that a letter's glyph name may end with.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}


# ---- fonts


def glyph_text(name: str) -> str | None:
    """The characters of a glyph's name."""
    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"(?:uni((?:[0-9A-Fa-f]{4})+)|u([0-9A-Fa-f]{4,6}))", name):
        digits = m[1] or m[2]
        return "".join(chr(int(digits[k : k + 4], 16)) for k in range(0, len(digits), 4)) if m[1] else chr(int(digits, 16))
    for accent, mark in ACCENTS.items():
        if name[1:] == accent:
            return unicodedata.normalize("NFC", name[0] + mark)
    return None


def unicode_table(data: bytes) -> tuple[dict[bytes, str], set[int]]:
    """A ToUnicode stream: codes to text, and the codes' lengths."""
    reader, operands = Reader(data), []
    table: dict[bytes, str] = {}
    sizes: set[int] = set()
    text = lambda raw: raw.decode("utf-16-be", "replace")
    while True:
        x = reader.read(False)
        if not isinstance(x, Word):
            if x is None and reader.at >= len(data):
                return table, sizes
            operands.append(x)
            continue
        codes = [o for o in operands if isinstance(o, (bytes, list))]
        if x == b"endcodespacerange":
            sizes |= {len(c) for c in codes}
        elif x == b"endbfchar":
            for code, to in zip(codes[::2], codes[1::2]):
                table[code] = text(to)
        elif x == b"beginbfchar" and (m := _PAIRS.match(data, reader.at)):
            pairs = _PAIR.findall(m[0])
            at_once = text(unhexlify(b"".join(to for _, to in pairs)))
            if len(at_once) == len(pairs) and "\ufffd" not in at_once and all(len(to) == 4 for _, to in pairs):
                table.update(zip([unhexlify(code) for code, _ in pairs], at_once))
            else:
                table.update((unhexlify(code), text(unhexlify(to))) for code, to in pairs)
            reader.at = m.end()
        elif x == b"endbfrange":
            for low, high, to in zip(codes[::3], codes[1::3], codes[2::3]):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(first, min(last, first + 0xFFFF) + 1):
                    code = k.to_bytes(len(low), "big")
                    if isinstance(to, list):
                        if k - first < len(to):
                            table[code] = text(to[k - first])
                    elif to:
                        end = int.from_bytes(to[-2:], "big") + k - first
                        table[code] = text(to[:-2] + (end & 0xFFFF).to_bytes(min(2, len(to)), "big"))
        operands = []


class Font:
    """Codes of strings to characters and widths in ems."""

    def __init__(self, doc: Document, info: dict) -> None:
        self.name = str(doc.value(info.get("BaseFont")) or "")
        self.composite = doc.value(info.get("Subtype")) == "Type0"
        to = doc.of(info.get("ToUnicode"), Stream)
        self.table, sizes = unicode_table(doc.bytes_of(to)) if to else ({}, set())
        self.size = max(sizes or {2}) if self.composite else 1
        self.points = np.empty(0, np.uint32)
        """Characters by code, as line() has them."""
        self.wide: np.ndarray | None = None
        """Widths by code, if they differ."""
        self.widths: dict[int, float] = {}
        self.width = EM
        self.scale = 0.001
        if self.composite:
            inner = doc.of((doc.of(info.get("DescendantFonts"), list) or [None])[0], dict, {})
            self.width = float(doc.value(inner.get("DW")) or 1000) * self.scale
            self._composite_widths([doc.value(x) for x in doc.of(inner.get("W"), list, [])], doc)
            self.encoding: dict[int, str] = {}
            return
        if doc.value(info.get("Subtype")) == "Type3" and (matrix := doc.of(info.get("FontMatrix"), list)):
            self.scale = abs(float(doc.value(matrix[0]))) or self.scale
        first, about = doc.value(info.get("FirstChar")) or 0, doc.of(info.get("FontDescriptor"), dict, {})
        if listed := doc.of(info.get("Widths"), list):
            self.width = float(doc.value(about.get("MissingWidth")) or 0) * self.scale or EM
            self.widths = {int(first) + k: float(doc.value(w) or 0) * self.scale for k, w in enumerate(listed)}
        encoding = doc.value(info.get("Encoding"))
        base = doc.value(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.encoding = {k: bytes([k]).decode(codec, "replace") for k in range(32, 256)}
        if isinstance(encoding, dict):
            code = 0
            for x in doc.of(encoding.get("Differences"), list, []):
                x = doc.value(x)
                if isinstance(x, Name):
                    self.encoding[code] = glyph_text(x) or f"(cid:{code})"
                    code += 1
                elif x is not None:
                    code = int(x)

    def _composite_widths(self, listed: list, doc: Document) -> None:
        k = 0
        while k + 1 < len(listed):
            if isinstance(listed[k + 1], list):
                self.widths |= {int(listed[k]) + i: float(doc.value(w) or 0) * self.scale for i, w in enumerate(listed[k + 1])}
                k += 2
            elif k + 2 < len(listed):
                for code in range(int(listed[k]), min(int(listed[k + 1]), int(listed[k]) + 0xFFFF) + 1):
                    self.widths[code] = float(listed[k + 2]) * self.scale
                k += 3
            else:
                break

    def text_of(self, code: bytes) -> str:
        number = int.from_bytes(code, "big")
        return self.table.get(code) or self.encoding.get(number) or f"(cid:{number})"

    def read(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(text, width, whether it is the one-byte space that word spacing widens) of every code."""
        out = []
        for k in range(0, len(raw), self.size):
            code = raw[k : k + self.size]
            out.append((self.text_of(code), self.widths.get(int.from_bytes(code, "big"), self.width), code == b" "))
        return out

    def line(self, raw: bytes) -> tuple[np.ndarray, float | np.ndarray] | None:
        """read() at once: the numbers and the width, or widths, of its characters. None where a code isn't whole or isn't one character."""
        if self.size > 2 or len(raw) % self.size:
            return None
        codes = np.frombuffer(raw, _BIG_ENDIAN if self.size == 2 else np.uint8).astype(np.intp)
        try:
            found = self.points[codes]
        except IndexError:
            self.points = np.full(256 if codes.max() < 256 else 65536, _UNKNOWN, np.uint32)
            if self.widths:
                self.wide = np.full(len(self.points), self.width)
                for code, width in self.widths.items():
                    if 0 <= code < len(self.wide):
                        self.wide[code] = width
            found = self.points[codes]
        most = found.max()
        if most == _UNKNOWN:
            for code in set(codes[found == _UNKNOWN].tolist()):
                text = self.text_of(code.to_bytes(self.size, "big"))
                self.points[code] = ord(text) if len(text) == 1 else _SEVERAL
            found = self.points[codes]
            most = found.max()
        if most == _SEVERAL:
            return None
        return found, self.width if self.wide is None else self.wide[codes]


_PLAIN: Callable[[bytes], list[tuple[str, float, bool]]] = lambda raw: [(bytes([c]).decode("cp1252", "replace"), EM, c == 32) for c in raw]
_PLAIN_POINTS = np.array([ord(bytes([c]).decode("cp1252", "replace")) for c in range(256)], np.uint32)


# ---- pages


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def _box(m: tuple, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    corners = [_at(m, a, b) for a in (x, x + w) for b in (y, y + h)]
    return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)


def _level(v: float) -> int:
    return round(255 * min(1.0, max(0.0, v)))


def color_of(values: list[float]) -> tuple[int, int, int] | None:
    """A colour of one, three or four components, each held within 0 to 1; None of others."""
    if len(values) == 1:
        return (_level(values[0]),) * 3
    if len(values) == 3:
        return tuple(map(_level, values))
    if len(values) == 4:
        return tuple(_level((1 - min(1.0, max(0.0, v))) * (1 - min(1.0, max(0.0, values[3])))) for v in values[:3])
    return None


class State(NamedTuple):
    ctm: tuple = _ONE
    fill: tuple | None = BLACK
    space: str = "DeviceGray"
    alpha: float = 1.0
    font: Font | None = None
    size: float = 12.0
    leading: float = 0.0
    char_gap: float = 0.0
    word_gap: float = 0.0
    stretch: float = 1.0
    rise: float = 0.0
    mode: int = 0


class Look(NamedTuple):
    """What characters that were shown at once have in common."""

    top: float
    bottom: float
    size: float
    font: int
    fill: tuple | None
    alpha: float
    mode: int
    order: int
    """How many rectangles were filled before."""


class Pieces(NamedTuple):
    """Characters painted one beside the other, by columns: a piece is a character of white space, or some others."""

    look: np.ndarray
    """The number of its look on the page."""
    is_space: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    """Where its text is in the page's."""
    x0: np.ndarray
    """Where the first one begins."""
    last_x0: np.ndarray
    last_x1: np.ndarray
    """Where the last one begins and ends."""
    x1: np.ndarray
    """Where the one that reaches furthest ends."""


class Words(NamedTuple):
    """Words of a page by columns. Colours are numbers in the file's palette."""

    text: list[str]
    x0: np.ndarray
    top: np.ndarray
    x1: np.ndarray
    bottom: np.ndarray
    size: np.ndarray
    fg: np.ndarray
    bg: np.ndarray


class Page:
    """Runs a page's operators and gathers pieces of text, filled rectangles and picture area."""

    def __init__(self, doc: Document, page: dict, fonts: dict | None = None, palette: dict | None = None) -> None:
        """fonts, palette: fonts and colours of the file's pages before."""
        box = [doc.value(v) for v in doc.of(page.get("MediaBox"), list, [])]
        x0, y0, x1, y1 = map(float, box) if len(box) == 4 and all(isinstance(v, (int, float)) for v in box) else LETTER
        x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        turn = int(doc.of(page.get("Rotate"), (int, float), 0)) % 360
        start = {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(turn, (1, 0, 0, 1, -x0, -y0))
        self.doc, self.height = doc, x1 - x0 if turn in (90, 270) else y1 - y0
        self.area = (x1 - x0) * (y1 - y0)
        self.image_area = 0.0
        self.looks: list[Look] = []
        self.pieces: list[Pieces] = []
        self.texts: list[str] = []
        self.length = 0
        self.strings_held: list[tuple] = []
        self.chars_held = 0
        self.loose: list[tuple] = []
        self.even: tuple | None = None
        self.even_at: tuple[np.ndarray, ...] = ()
        self.fills: list[tuple] = []
        self.palette: dict[tuple | None, int] = {} if palette is None else palette
        self.path: list[tuple] = []
        self.pen: list[tuple[float, float]] = []
        self.state, self.saved = State(ctm=tuple(map(float, start))), []
        self.text = self.line = _ONE
        self.fonts: dict[int, tuple[dict, Font]] = {} if fonts is None else fonts
        self.run(doc.content_of(page), doc.of(page.get("Resources"), dict, {}), 0)

    # -- text

    def move(self, x: float, y: float) -> None:
        self.line = self.text = _times((1, 0, 0, 1, x, y), self.line)

    def show(self, raw: bytes) -> None:
        if self.show_line(raw):
            return
        s = self.state
        self.part_strings()
        for text, width, is_space in s.font.read(raw) if s.font else _PLAIN(raw):
            m = _times((s.size * s.stretch, 0, 0, s.size, 0, s.rise), _times(self.text, s.ctm))
            x0, y0, x1, y1 = _box(m, 0, ASCENT - 1, width, 1)
            if text:
                self.loose.append((len(self.looks), text.isspace(), text, x0, x0, x1, x1))
                self.looks.append(self.look(m, y0, y1))
            ahead = (width * s.size + s.char_gap + (s.word_gap if is_space else 0)) * s.stretch
            self.text = _times((1, 0, 0, 1, ahead, 0), self.text)

    def look(self, m: tuple, y0: float, y1: float) -> Look:
        s = self.state
        return Look(self.height - y1, self.height - y0, (m[2] ** 2 + m[3] ** 2) ** 0.5, id(s.font), s.fill, s.alpha, s.mode, len(self.fills))

    def show_line(self, raw: bytes) -> bool:
        """show() for the usual string at once: upright, left to right, without gaps of its own, a character a code. Whether it is one."""
        s, t = self.state, self.text
        if not raw or s.char_gap or s.word_gap or t[1] or t[2] or s.ctm[1] or s.ctm[2]:
            return False
        m = _times((s.size * s.stretch, 0, 0, s.size, 0, s.rise), _times(t, s.ctm))
        found = s.font.line(raw) if s.font else (_PLAIN_POINTS[np.frombuffer(raw, "u1")], EM)
        if not m[0] > 0 or found is None:
            return False
        points, width = found
        n = len(points)
        if not (width if isinstance(width, float) else width.min()) >= 0:
            return False
        # where all are of one width, strings that begin at one place have their characters at the same ones
        even = (width, t[0], t[4], s.size, s.stretch, s.ctm) if isinstance(width, float) else None
        if even is None or even != self.even or n >= len(self.even_at[0]):
            steps = np.empty(n + 1 if even is None else 2 * n + 1)
            steps[0], steps[1:] = t[4], width * s.size * s.stretch * t[0]
            at = np.add.accumulate(steps)
            x0 = at * s.ctm[0] + s.ctm[4]
            x1 = width * m[0] + (x0[:-1] if even is None else x0)
            if even is not None:
                self.even, self.even_at = even, (at, x0, x1)
        else:
            at, x0, x1 = self.even_at
        if not max(abs(x0.item(0)), abs(x1.item(n - 1))) < FAR:
            return False
        self.text = (*t[:4], at.item(n), t[5])
        ys = (ASCENT - 1) * m[3] + m[5], (ASCENT - 1 + 1) * m[3] + m[5]
        self.part_loose()
        self.strings_held.append((len(self.looks), points, x0[:n], x1[:n]))
        self.looks.append(self.look(m, min(ys), max(ys)))
        self.chars_held += n
        if self.chars_held >= CHARS:
            self.part_strings()
        return True

    def part_strings(self) -> None:
        """Pieces of the strings that were shown at once."""
        if not self.strings_held:
            return
        looks, points, x0, x1 = zip(*self.strings_held)
        sizes = np.array([len(p) for p in points])
        points, x0, x1 = (np.concatenate(c) for c in (points, x0, x1))
        space = np.take(_SPACES, points, mode="clip")
        starts = space.copy()
        starts[1:] |= space[:-1]
        begins = np.cumsum(sizes) - sizes
        starts[begins] = True
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(points)) - 1
        whole = points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")
        look = np.array(looks)[np.searchsorted(begins, first, "right") - 1]
        self.pieces.append(Pieces(look, space[first], first + self.length, last + (self.length + 1), x0[first], x0[last], x1[last], np.maximum.reduceat(x1, first)))
        self.strings_held, self.chars_held = [], 0
        self.hold(whole)

    def hold(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)

    def part_loose(self) -> None:
        """Pieces of the characters that were shown one by one."""
        if self.loose:
            look, space, text, *places = zip(*self.loose)
            ends = np.cumsum([len(t) for t in text]) + self.length
            self.pieces.append(Pieces(np.array(look), np.array(space), np.append(self.length, ends[:-1]), ends, *[np.array(p, float) for p in places]))
            self.loose = []
            self.hold("".join(text))

    # -- operators

    def run(self, content: bytes, resources: dict, depth: int) -> None:
        if depth > FORMS:
            raise ValueError("forms nested too deeply")
        reader, stack = Reader(content), []
        while True:
            x = reader.read(False)
            if not isinstance(x, Word):
                if x is None and reader.at >= len(content):
                    return
                stack.append(x)
                continue
            if x == b"BI":
                self.inline_image(reader)
            else:
                self.apply(bytes(x), stack, resources, depth)
            stack = []

    def inline_image(self, reader: Reader) -> None:
        while (x := reader.read(False)) is not None and x != b"ID":
            pass
        end = re.compile(rb"\sEI(?=\s|$)").search(reader.data, reader.at + 1)
        if end is None:
            raise ValueError("an inline image without an end")
        reader.at = end.end()
        self.picture()

    def picture(self) -> None:
        x0, y0, x1, y1 = _box(self.state.ctm, 0, 0, 1, 1)
        self.image_area += (x1 - x0) * (y1 - y0)

    def fill_path(self) -> None:
        if len(self.pen) >= 4:
            xs, ys = {round(p[0], 2) for p in self.pen}, {round(p[1], 2) for p in self.pen}
            if len(xs) == len(ys) == 2:
                self.path.append((min(xs), min(ys), max(xs), max(ys)))
        if self.state.alpha >= 0.5:
            self.fills += [(*box, self.state.fill) for box in self.path]
        self.path, self.pen = [], []

    def entry(self, resources: dict, kind: str, name) -> object:
        return self.doc.value(self.doc.of(resources.get(kind), dict, {}).get(name))

    def font_of(self, info) -> Font | None:
        if not isinstance(info, dict):
            return None
        if id(info) not in self.fonts:
            self.fonts[id(info)] = info, Font(self.doc, info)  # held, as the id is that of a living object only
        return self.fonts[id(info)][1]

    def set_space(self, name, resources: dict) -> None:
        found = name if str(name).startswith("Device") else self.entry(resources, "ColorSpace", name) or name
        kind = str(self.doc.value(found[0])) if isinstance(found, list) and found else str(found)
        self.state = self.state._replace(space=kind, fill=BLACK)

    def set_color(self, n: list[float]) -> None:
        kind = self.state.space
        if kind in ("Separation", "DeviceN"):  # amounts of ink
            fill = color_of([1 - max(n, default=0.0)])
        elif kind in ("Pattern", "Indexed"):
            fill = None
        elif kind == "Lab":
            fill = color_of([n[0] / 100]) if n else None
        else:
            fill = color_of(n)
        self.state = self.state._replace(fill=fill)

    def apply(self, op: bytes, stack: list, resources: dict, depth: int) -> None:
        if op == b"Tj":
            self.strings(stack[-1:])
            return
        n = [float(x) for x in stack if isinstance(x, (int, float)) and not isinstance(x, bool)]
        s = self.state
        if op == b"q":
            self.saved.append(s)
        elif op == b"Q":
            self.state = self.saved.pop() if self.saved else s
        elif op == b"cm" and len(n) == 6:
            self.state = s._replace(ctm=_times(tuple(n), s.ctm))
        elif op in (b"g", b"rg", b"k"):
            self.state = s._replace(space="Device", fill=color_of(n))
        elif op == b"cs" and stack:
            self.set_space(stack[-1], resources)
        elif op in (b"sc", b"scn"):
            self.set_color(n)
        elif op == b"gs" and stack:
            about = self.entry(resources, "ExtGState", stack[-1])
            if isinstance(about, dict):
                alpha = self.doc.of(about.get("ca"), (int, float), s.alpha)
                font = self.doc.of(about.get("Font"), list)
                self.state = s._replace(alpha=min(1.0, max(0.0, float(alpha))))
                if font:
                    self.state = self.state._replace(font=self.font_of(self.doc.value(font[0])), size=float(self.doc.value(font[1])))
        elif op == b"re" and len(n) == 4:
            self.path.append(_box(s.ctm, *n))
        elif op in (b"m", b"l") and len(n) == 2:
            self.pen.append(_at(s.ctm, *n))
        elif op in (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            self.fill_path()
        elif op in (b"n", b"S", b"s"):
            self.path, self.pen = [], []
        elif op == b"Do" and stack:
            self.do(self.entry(resources, "XObject", stack[-1]), resources, depth)
        elif op == b"BT":
            self.text = self.line = _ONE
        elif op == b"Tf" and n:
            self.state = s._replace(font=self.font_of(self.entry(resources, "Font", stack[0])), size=n[-1])
        elif op in (b"TL", b"Tc", b"Tw", b"Ts", b"Tr", b"Tz") and n:
            field, value = {b"TL": ("leading", n[0]), b"Tc": ("char_gap", n[0]), b"Tw": ("word_gap", n[0]), b"Ts": ("rise", n[0]), b"Tr": ("mode", int(n[0])), b"Tz": ("stretch", n[0] / 100)}[op]
            self.state = s._replace(**{field: value})
        elif op in (b"Td", b"TD") and len(n) == 2:
            if op == b"TD":
                self.state = s._replace(leading=-n[1])
            self.move(*n)
        elif op == b"Tm" and len(n) == 6:
            self.text = self.line = tuple(n)
        elif op == b"T*":
            self.move(0, -s.leading)
        elif op == b"TJ" and stack and isinstance(stack[-1], list):
            self.strings(stack[-1])
        elif op in (b"'", b'"'):
            if op == b'"' and len(n) >= 2:
                self.state = s._replace(word_gap=n[0], char_gap=n[1])
            self.move(0, -s.leading)
            self.strings(stack[-1:])

    def strings(self, parts: list) -> None:
        for x in parts:
            if isinstance(x, bytes):
                self.show(x)
            elif isinstance(x, (int, float)):
                self.text = _times((1, 0, 0, 1, -x / 1000 * self.state.size * self.state.stretch, 0), self.text)

    def do(self, thing, resources: dict, depth: int) -> None:
        if not isinstance(thing, Stream):
            return
        kind = self.doc.value(thing.info.get("Subtype"))
        if kind == "Image":
            self.picture()
        elif kind == "Form":
            kept, saved, self.saved = self.state, self.saved, []
            matrix = [self.doc.value(v) for v in self.doc.of(thing.info.get("Matrix"), list, [])]
            if len(matrix) == 6:
                self.state = kept._replace(ctm=_times(tuple(map(float, matrix)), kept.ctm))
            self.run(self.doc.bytes_of(thing), self.doc.of(thing.info.get("Resources"), dict, resources), depth + 1)
            self.state, self.saved = kept, saved

    # -- words

    def below(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The numbers of the last rectangles that hold places (y counted up), -1 where none does."""
        out = np.full(len(x), -1)
        if not self.fills:
            return out
        boxes = np.array([f[:4] for f in self.fills], float)
        if len(boxes) <= len(x):
            for k, (x0, y0, x1, y1) in enumerate(boxes.tolist()):
                out[(x0 <= x) & (x <= x1) & (y0 <= y) & (y <= y1)] = k
            return out
        x0, y0, x1, y1 = boxes.T
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
            holds = np.flatnonzero((x0 <= a) & (a <= x1) & (y0 <= b) & (b <= y1))
            if len(holds):
                out[i] = holds[-1]
        return out

    def colors(self, c: Look, k: int) -> tuple[tuple | None, tuple | None]:
        """The colours of a word in whose middle rectangle k is the last one: below it lies one that was filled before it, and a later one
        hides it."""
        if k >= c.order:
            covers = self.fills[k][4]
            return covers, covers
        below = self.fills[k][4] if k >= 0 else WHITE
        if c.mode in (3, 7):
            return below, below
        if c.alpha < 1 and c.fill and below:
            return tuple(round(c.alpha * f + (1 - c.alpha) * b) for f, b in zip(c.fill, below)), below
        return c.fill, below

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Of each look: the number of its run of one font and size, of its line within the run, of what it shares with those that may
        meet it in a word (run, line and colours), and of its colours."""
        runs: list[int] = []
        for k, c in enumerate(self.looks):
            runs.append(runs[-1] + ((c.font, c.size) != (self.looks[k - 1].font, self.looks[k - 1].size)) if k else 0)
        lines: list[int] = []
        for _, run in itertools.groupby(zip(runs, self.looks), lambda x: x[0]):
            found = [c.top for _, c in run]
            tops = sorted(set(found))
            line_of, line = {}, 0
            for k, top in enumerate(tops):
                line += k > 0 and top - tops[k - 1] > SAME_LINE
                line_of[top] = line
            lines += [line_of[top] for top in found]
        styles: dict[tuple, int] = {}
        style = [styles.setdefault((c.fill, c.alpha, c.mode), len(styles)) for c in self.looks]
        keys: dict[tuple, int] = {}
        key = [keys.setdefault(x, len(keys)) for x in zip(runs, lines, style)]
        return np.array(runs), np.array(lines), np.array(key), style

    def words(self) -> Words | None:
        """Pieces that meet on a line make a word. None of a page without text."""
        self.part_strings()
        self.part_loose()
        if not self.pieces:
            return None
        look, space, begin, end, x0, last_x0, last_x1, x1 = self.pieces[0] if len(self.pieces) == 1 else map(np.concatenate, zip(*self.pieces))
        whole = "".join(self.texts)
        runs, lines, keys, styles = self.lines()
        key = keys[look]
        # pieces that follow each other, up to white space
        starts = np.ones(len(look), bool)
        starts[1:] = space[:-1] | space[1:] | (key[1:] != key[:-1]) | ~((last_x0[:-1] <= x0[1:]) & (x0[1:] <= last_x1[:-1] + GAP))
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(look)) - 1
        # by lines within runs, those that meet in turn
        order = np.lexsort((x0[first], lines[look[first]], runs[look[first]]))
        first, last = first[order], last[order]
        gap = x0[first[1:]] - last_x1[last[:-1]]
        begins = np.ones(len(first), bool)
        begins[1:] = space[first[:-1]] | (key[first[1:]] != key[last[:-1]]) | ~((-1 <= gap) & (gap <= GAP))
        kept = ~space[first]
        first, last, begins = first[kept], last[kept], begins[kept]
        if not len(first):
            return None
        sizes = last - first + 1
        places = np.cumsum(sizes) - sizes
        piece = np.repeat(first - places, sizes) + np.arange(sizes.sum())
        word = places[begins]
        head = look[piece[word]]
        text = [whole[a:b] for a, b in zip(begin[piece].tolist(), end[piece].tolist())]
        tops, bottoms, points = np.array([(c.top, c.bottom, c.size) for c in self.looks], float).T
        top, bottom = tops[head], bottoms[head]
        left, right = x0[piece], x1[piece]
        if len(word) < len(piece):
            ends = [*word.tolist()[1:], len(piece)]
            text = [text[a] if b - a == 1 else "".join(text[a:b]) for a, b in zip(word.tolist(), ends)]
            left, right = np.minimum.reduceat(left, word), np.maximum.reduceat(right, word)
            top, bottom = np.minimum.reduceat(tops[look[piece]], word), np.maximum.reduceat(bottoms[look[piece]], word)
        return Words(text, left, top, right, bottom, points[head], *self.colored(head, styles, self.below((left + right) / 2, self.height - (top + bottom) / 2)))

    def colored(self, head: np.ndarray, styles: list[int], below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Palette numbers of the colours of words that begin in these looks; what is alike in look and rectangle is told once."""
        number = lambda c: self.palette.setdefault(c, len(self.palette))
        if not self.fills and not any(styles):
            return tuple(np.full(len(head), number(c)) for c in self.colors(self.looks[0], -1))
        orders = np.array([c.order for c in self.looks])
        alike = (np.array(styles)[head] * (len(self.fills) + 1) + below + 1) * 2 + (below >= orders[head])
        _, where, which = np.unique(alike, return_index=True, return_inverse=True)
        pairs = [self.colors(self.looks[head[k]], int(below[k])) for k in where.tolist()]
        return np.array([number(fg) for fg, _ in pairs])[which], np.array([number(bg) for _, bg in pairs])[which]


def _columns(data: bytes) -> tuple[Words, np.ndarray, list[tuple | None], Info]:
    """A file's words, the numbers of their pages, its palette, and what the choice of OCR rests on."""
    doc = Document(data)
    page_area = image_area = 0.0
    fonts: dict[int, tuple[dict, Font]] = {}
    palette: dict[tuple | None, int] = {}
    found: list[tuple[int, Words]] = []
    for number, info in enumerate(doc.pages(), 1):
        page = Page(doc, info, fonts, palette)
        page_area, image_area = page_area + page.area, image_area + page.image_area
        if words := page.words():
            found.append((number, words))
    if found:
        pages = np.repeat([n for n, _ in found], [len(w.text) for _, w in found])
        text, *rest = zip(*[w for _, w in found])
        words = Words(list(itertools.chain(*text)), *[np.concatenate(c) for c in rest])
    else:
        pages, words = np.empty(0, int), Words([], *[np.empty(0)] * 5, *[np.empty(0, int)] * 2)
    return words, pages, list(palette), Info(len("".join(words.text).strip()), page_area, image_area)


def read_file(data: bytes) -> tuple[list[tuple], Info]:
    """(span_seq, text, page, (x0, y0, x1, y1), size, fg, bg) of a file's words, and what the choice of OCR rests on."""
    words, pages, palette, info = _columns(data)
    text, *rest = words
    x0, top, x1, bottom, size, fg, bg = (c.tolist() for c in rest)
    return list(zip(range(len(text)), text, pages.tolist(), zip(x0, top, x1, bottom), size, map(palette.__getitem__, fg), map(palette.__getitem__, bg))), info


def read_columns(data: bytes) -> tuple[Columns, Info]:
    """read_file() by columns."""
    (text, x0, top, x1, bottom, size, fg, bg), pages, palette, info = _columns(data)
    return Columns(text, pages, (x0, top, x1, bottom), size, fg, bg, palette), info


def read_pdf(data: bytes) -> list[tuple]:
    return read_file(data)[0]


def pdf_words(files: DataFrame) -> DataFrame:
    """Native words of files; those without any, or that can't be read, have no rows (files.extracted tells them apart)."""
    return native_spans(extract(files, read_columns))
