"""Baseline JPEG media columns (operator 5).

Reading: markers are parsed by their declared lengths, entropy-coded segments are cut at restart markers and freed of stuffed
bytes, and all segments of a batch are Huffman-decoded side by side in numpy, a symbol of each at a time. AC
coefficients are skipped over; DC coefficients of the luminance component give a thumbnail of one sample for each 8x8
block. Any baseline file is read: several components, any sampling factors, with or without restart intervals.

Writing: a payload becomes an image whose 8x8 blocks each hold one byte: DC coefficient byte - 128 under a
quantizer of 8, no AC coefficients. The block's samples all equal the byte, so the 8-bit samples, and the DC-only
thumbnail, are the payload without loss. A row has 64 blocks and is a restart interval. A payload of over
FRAME bytes becomes several images one after another (motion JPEG).

Defined cases: a null or empty text is a payload of 64 zero bytes; rows with equal texts get equal values; rows that share a
doc_id, or are equal in all columns, are stored one by one; a very long text is coded and decoded BATCH bytes at a time, with about six times
its bytes held; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

UNIT = 64
#: Bytes of one image: 64 blocks a row and 8064 rows of blocks, 64512 of the 65535 lines that a frame may have.
FRAME = UNIT * 8064
#: Bytes of payload that are coded side by side.
BATCH = 2 << 20

# The standard's luminance DC code (numbers of codes by length, then values), and a one-bit AC code for
# the end of a block.
DC_BITS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_BITS, AC_VALUES = (1,) + (0,) * 15, (0,)


def huffman_codes(bits: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """value: (code, length), codes counted up within and across lengths."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for value in values[at : at + n]:
            out[value] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def huffman_lookup(bits: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit prefix: length * 256 + value, 0 where no code begins."""
    out = np.zeros(1 << 16, np.int64)
    for value, (code, length) in huffman_codes(bits, values).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return out


# ---- writing


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of a whole block (category, magnitude, end of block) and how many they are."""
    codes = huffman_codes(DC_BITS, DC_VALUES)
    eob, eob_len = huffman_codes(AC_BITS, AC_VALUES)[0]
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = codes[size]
        magnitude = diff if diff >= 0 else diff + (1 << size) - 1
        value[diff + 255] = ((code << size | magnitude) << eob_len) | eob
        length[diff + 255] = n + size + eob_len
    return value, length


_VALUE, _LENGTH = _symbol_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * UNIT).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES))
        + _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES))
        + _segment(0xDD, UNIT.to_bytes(2, "big"))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _pack_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 64) bytes to each row's coded bytes (padded with ones), as a matrix, and their numbers."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0)) + 255
    words = np.zeros((n, 32), ">u4")
    acc, held = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    used = np.zeros(n, np.int64)
    low = np.uint64(32)
    for k in range(UNIT):
        d = diff[:, k]
        size = _LENGTH[d]
        acc = (acc << size) | _VALUE[d]
        held += size
        full = np.flatnonzero(held >= low)
        if len(full):
            rest = held[full] - low
            words[full, used[full]] = acc[full] >> rest
            acc[full] &= (np.uint64(1) << rest) - np.uint64(1)
            held[full] = rest
            used[full] += 1
    tail = low - held
    words[np.arange(n), used] = (acc << tail) | ((np.uint64(1) << tail) - np.uint64(1))
    return words.view(np.uint8).reshape(n, -1), 4 * used + (held.astype(np.int64) + 7) // 8


def encode(payloads: list[bytes]) -> list[bytes]:
    """The images of payloads whose lengths are positive multiples of 64; about BATCH bytes are coded side by side."""
    images: list[list[bytes]] = [[] for _ in payloads]
    places, group, size = [], [], 0
    for k, p in enumerate(payloads):
        for at in range(0, len(p), FRAME):
            frame = p[at : at + FRAME] if len(p) > FRAME else p
            if group and size + len(frame) > BATCH:
                for place, image in zip(places, _images(group)):
                    images[place].append(image)
                places, group, size = [], [], 0
            places.append(k)
            group.append(frame)
            size += len(frame)
    for place, image in zip(places, _images(group) if group else []):
        images[place].append(image)
    return [x[0] if len(x) == 1 else b"".join(x) for x in images]


def _images(frames: list[bytes]) -> list[bytes]:
    """One image for each frame."""
    rows = [len(f) // UNIT for f in frames]
    matrix, sizes = _pack_rows(np.frombuffer(b"".join(frames), np.uint8).reshape(-1, UNIT))
    flat = matrix[np.arange(matrix.shape[1]) < sizes[:, None]]
    stuffed = flat == 0xFF
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.cumsum(stuffed) - stuffed
    out = np.zeros(len(flat) + int(stuffed.sum()) + 2 * len(sizes), np.uint8)
    out[np.arange(len(flat)) + shift + 2 * row_of] = flat
    row_end = np.cumsum(sizes)
    ends = row_end + np.concatenate([[0], np.cumsum(stuffed)])[row_end] + 2 * np.arange(1, len(sizes) + 1)
    last = np.cumsum(rows) - 1
    number = np.arange(len(sizes)) - np.repeat(np.concatenate([[0], last[:-1] + 1]), rows)
    out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + number % 8
    out[ends[last] - 1] = 0xD9
    data, images, at = out.tobytes(), [], 0
    for r, e in zip(rows, ends[last].tolist()):
        images.append(_header(r) + data[at:e])
        at = e
    return images


# ---- reading


class Component(NamedTuple):
    ident: int
    h: int
    v: int
    quantizer: int


class Image(NamedTuple):
    width: int
    height: int
    components: tuple[Component, ...]
    scanned: tuple[tuple[int, bytes, bytes], ...]
    """Of each component of the scan: its place in `components`, its DC and AC table as declared."""
    dc_step: int
    """The DC quantizer of the first component."""
    interval: int
    """MCUs of a restart interval."""
    segments: list[bytes]
    """Entropy-coded data between restart markers, without stuffed bytes."""


def parse(data: bytes) -> list[Image]:
    """All baseline images of data."""
    return list(images_of(data))


def images_of(data: bytes) -> Iterator[Image]:
    """The baseline images of data, one after another, each parsed when it is asked for."""
    steps: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    size, components, interval, at = (0, 0), (), 0, 0
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        at += 1 if marker == 0xFF else 2
        if marker == 0xD8:
            steps, tables, interval = {}, {}, 0
        if marker in (0xFF, 0x01, 0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + length]
        at += length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                steps[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are baseline")
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
            components = tuple(Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3))
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDA:
            idents = [c.ident for c in components]
            scanned = tuple((idents.index(body[k]), tables[body[k + 1] >> 4], tables[16 | body[k + 1] & 15]) for k in range(1, 1 + 2 * body[0], 2))
            segments, at = _entropy_coded(data, at)
            if scanned[0][0] == 0:  # scans of other components alone hold no luminance
                yield Image(*size, components, scanned, steps[components[0].quantizer], interval, segments)


def _entropy_coded(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The segments from `at` to the next marker that isn't a restart, and that marker's place."""
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            end = len(data)
            break
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
            continue
        break
    raw = np.frombuffer(data, np.uint8, end - at, at)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    marks = ff[raw[ff + 1] != 0]
    segments, k = [], 0
    for m in [*marks.tolist(), len(raw)]:
        segments.append(data[at + k : at + m].replace(b"\xff\x00", b"\xff"))
        k = m + 2
    return segments, end


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image; images with the same tables and layout are decoded side by side."""
    kinds: dict[tuple, list[int]] = {}
    for k, im in enumerate(images):
        kinds.setdefault((im.components, im.scanned), []).append(k)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for places in kinds.values():
        for k, thumb in zip(places, _decode([images[k] for k in places])):
            out[k] = thumb
    return out


def _layout(im: Image) -> tuple[int, int, list[tuple[int, int, int]]]:
    """MCUs across and down, and the blocks of an MCU: (component of the scan, column, row)."""
    if len(im.scanned) == 1:  # not interleaved: an MCU is one block
        c = im.components[im.scanned[0][0]]
        most_h, most_v = max(x.h for x in im.components), max(x.v for x in im.components)
        return -(-im.width * c.h // (8 * most_h)), -(-im.height * c.v // (8 * most_v)), [(0, 0, 0)]
    most_h, most_v = max(c.h for c in im.components), max(c.v for c in im.components)
    blocks = [(k, x, y) for k, (place, _, _) in enumerate(im.scanned) for y in range(im.components[place].v) for x in range(im.components[place].h)]
    return -(-im.width // (8 * most_h)), -(-im.height // (8 * most_v)), blocks


def _decode(images: list[Image]) -> list[np.ndarray]:
    first = images[0]
    luts = np.stack([huffman_lookup(tuple(t[:16]), tuple(t[16:])) for _, dc, ac in first.scanned for t in (dc, ac)])
    layouts = [_layout(im) for im in images]
    blocks = layouts[0][2]
    turn = np.array([b[0] for b in blocks])
    # segments side by side
    mcus, owner, data = [], [], []
    for k, (im, (across, down, _)) in enumerate(zip(images, layouts)):
        left = across * down
        for seg in im.segments:
            n = min(im.interval or left, left)
            left -= n
            mcus.append(n)
            owner.append(k)
            data.append(seg)
        if left:
            raise ValueError("the image ends before its last block")
    sizes = np.array([len(x) + 8 for x in data])
    flat = np.frombuffer(b"".join(x + b"\xff" * 8 for x in data) + b"\xff" * 8, np.uint8)
    eight = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    pos = 8 * np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    stop = pos + 8 * (sizes - 8)
    todo = np.array(mcus, np.int64) * len(blocks)
    most = int(todo.max(initial=0))
    dc = np.zeros((len(data), most), np.int16)
    pred = np.zeros((len(data), len(first.scanned)), np.int64)
    coef, done = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    live = np.flatnonzero(todo > 0)
    sh = np.uint64
    while len(live):
        p = pos[live]
        window = np.ascontiguousarray(eight[p >> 3]).view(">u8").ravel().astype(np.uint64) << (p & 7).astype(np.uint64)
        comp = turn[done[live] % len(blocks)]
        at_dc = coef[live] == 0
        if at_dc.any():
            some = slice(None) if at_dc.all() else np.flatnonzero(at_dc)
            rows, w, c = live[some], window[some], comp[some]
            hit = luts[2 * c, (w >> sh(48)).astype(np.int64)]
            length, size = hit >> 8, hit & 15
            if (length == 0).any():
                raise ValueError("a code that the DC table doesn't have")
            bits = ((w << length.astype(np.uint64)) >> sh(48)).astype(np.int64) >> (16 - size)
            diff = np.where((size > 0) & (bits < (1 << size >> 1)), bits - (1 << size) + 1, bits)
            value = pred[rows, c] + diff
            pred[rows, c] = value
            dc[rows, done[rows]] = value
            used = length + size
            pos[rows] += used
            window[some] = w << used.astype(np.uint64)
            coef[rows] = 1
        hit = luts[2 * comp + 1, (window >> sh(48)).astype(np.int64)]
        length, symbol = hit >> 8, hit & 255
        if (length == 0).any():
            raise ValueError("a code that the AC table doesn't have")
        pos[live] += length + (symbol & 15)
        k = coef[live] + np.where(symbol == 0, 64, (symbol >> 4) + 1)
        over = k > 63
        coef[live] = np.where(over, 0, k)
        done[live] += over
        if (pos[live] > stop[live]).any():
            raise ValueError("the segment ends before its last block")
        live = live[done[live] < todo[live]]
    # the luminance blocks of every segment, in the order of the thumbnail
    luma = np.flatnonzero(turn == 0)
    out, seg = [], 0
    for k, (im, (across, down, _)) in enumerate(zip(images, layouts)):
        n = len(im.segments)
        if (todo[seg : seg + n] == most).all():
            own = dc[seg : seg + n].ravel()
        else:
            own = np.concatenate([dc[s, : todo[s]] for s in range(seg, seg + n)])
        seg += n
        v = max(blocks[b][2] for b in luma) + 1
        h = max(blocks[b][1] for b in luma) + 1
        grid = own.reshape(down, across, len(blocks))[:, :, luma].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        samples = np.clip((grid.astype(np.int64) * im.dc_step + 4) // 8 + 128, 0, 255).astype(np.uint8)
        c = im.components[0]
        wide, high = -(-im.width * c.h // (8 * max(x.h for x in im.components))), -(-im.height * c.v // (8 * max(x.v for x in im.components)))
        out.append(samples[:high, :wide])
    return out


def thumbnail_hash(thumbs: list[np.ndarray]) -> str:
    """64 bits: which cells of an 8x8 grid over thumbnails of one width, one below the other, are brighter than their mean."""
    high, wide = sum(len(t) for t in thumbs), thumbs[0].shape[1]
    at = [np.arange(8) * n // 8 for n in (high, wide)]
    to = [np.maximum(a + 1, (np.arange(8) + 1) * n // 8) for a, n in zip(at, (high, wide))]
    cells = np.zeros((8, 8), np.int64)
    for k, (begin, end) in enumerate(zip(at[0].tolist(), to[0].tolist())):
        above, columns = 0, np.zeros(wide, np.int64)
        for t in thumbs:
            columns += t[max(0, begin - above) : max(0, end - above)].sum(axis=0, dtype=np.int64)
            above += len(t)
        total = np.concatenate([[0], columns.cumsum()])
        cells[k] = total[to[1]] - total[at[1]]
    area = (to[0] - at[0])[:, None] * (to[1] - at[1])
    return np.packbits(cells * area.sum() > cells.sum() * area).tobytes().hex()


# ---- media columns


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_bytes, media)."""
    for batch in batches:
        at = 0
        for part in _parts([x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]):
            media = encode([padded(t) for t in part])
            yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])
            at += len(part)


def _grouped(media: Iterable[bytes]) -> Iterator[list[tuple[int, Image]]]:
    """The images of media with the media's places, in groups of about BATCH coded bytes that are decoded side by side."""
    group, size = [], 0
    for k, data in enumerate(media):
        for image in images_of(data):
            group.append((k, image))
            size += sum(map(len, image.segments))
            if size > BATCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, media) to what is computed from the stored bytes."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        at = 0
        for part in _parts([x.as_py() for x in batch.column(2)]):
            sizes: list[list[int]] = [[] for _ in part]
            thumbs: list[list[np.ndarray]] = [[] for _ in part]
            sums, tails = [hashlib.sha256() for _ in part], [b""] * len(part)
            for group in _grouped(part):
                for (k, image), thumb in zip(group, thumbnails([image for _, image in group])):
                    data = thumb.tobytes()
                    sums[k].update(data)
                    tails[k] = data[-UNIT:]
                    thumbs[k].append(thumb)
                    sizes[k] = [image.width, image.height + (sizes[k][1] if sizes[k] else 0)]
            out: list[list] = [[] for _ in names]
            for k, media in enumerate(part):
                feature = f"{sizes[k][0]}x{sizes[k][1]}:{len(thumbs[k])}:{thumbnail_hash(thumbs[k])}"
                row = (sum(t.size for t in thumbs[k]), sums[k].hexdigest(), zlib.crc32(tails[k]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.record_batch([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["id", "n_bytes", *names])
            at += len(part)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the media column (JPEG bytes) of every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(store), "id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and digests of a media column (id, n_bytes, media)."""
    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("id", "n_bytes", "media").mapInArrow(trimmed(features), kinds).withColumnRenamed("id", "doc_id")
