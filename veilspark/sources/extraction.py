"""Files to span rows by a reader function, one row of its own for every file that can't be read or has no spans."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SPAN

#: Span rows that are handed over together.
ROWS = 4096


class Info(NamedTuple):
    """What the choice between native text and OCR rests on; the areas are 0 for files without pages of their own."""

    native_chars: int
    page_area: float = 0.0
    image_area: float = 0.0


def info_of(spans: list[tuple], page_area: float = 0.0, image_area: float = 0.0) -> Info:
    return Info(len("".join(s[1] for s in spans).strip()), page_area, image_area)


class Columns(NamedTuple):
    """Spans of a file, numbered from 0, by columns. Colours are numbers in a palette."""

    text: list[str]
    page: np.ndarray
    box: tuple[np.ndarray, ...]
    size: np.ndarray
    fg: np.ndarray
    bg: np.ndarray
    palette: list[tuple | None]


Read = Callable[[bytes], tuple[list[tuple] | Columns, Info]]


def as_struct(span: tuple) -> dict:
    seq, text, page, box, size, fg, bg = span
    color = lambda c: None if c is None else dict(zip("rgb", c))
    return {"span_seq": seq, "text": text, "page_number": page, "bbox": dict(zip(("x0", "y0", "x1", "y1"), box)), "font_size": size, "font_color": color(fg), "background_color": color(bg)}


SPAN_ARROW = pa.struct(
    [
        ("span_seq", pa.int64()),
        ("text", pa.string()),
        ("page_number", pa.int32()),
        ("bbox", pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])),
        ("font_size", pa.float64()),
        ("font_color", pa.struct([(k, pa.int32()) for k in "rgb"])),
        ("background_color", pa.struct([(k, pa.int32()) for k in "rgb"])),
    ]
)


def span_array(spans: list[tuple | None]) -> pa.Array:
    """Spans of readers as Arrow structs, column by column; None as null."""
    kept = [s for s in spans if s is not None]
    seq, text, page, box, size, fg, bg = zip(*kept) if kept else [()] * 7

    def struct(values: tuple, kind: pa.StructType) -> pa.Array:
        whole = [v for v in values if v is not None]
        columns = zip(*whole) if whole else [()] * kind.num_fields
        # null colours have no values: the places of the others are taken from a struct without nulls
        made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
        return made if len(whole) == len(values) else made.take(_ranks(values))

    kinds = [f.type for f in SPAN_ARROW]
    columns = [pa.array(seq, kinds[0]), pa.array(text, kinds[1]), pa.array(page, kinds[2]), struct(box, kinds[3]), pa.array(size, kinds[4]), struct(fg, kinds[5]), struct(bg, kinds[6])]
    made = pa.StructArray.from_arrays(columns, fields=list(SPAN_ARROW))
    return made if len(kept) == len(spans) else made.take(_ranks(spans))


_KINDS = [f.type for f in SPAN_ARROW]
_FIELDS, _BOX = list(SPAN_ARROW), list(_KINDS[3])


def column_array(files: list[Columns]) -> pa.StructArray:
    """Spans of files as Arrow structs, one file after the other."""
    text, page, box, size, fg, bg, palette = zip(*files)
    sizes = [len(t) for t in text]
    first = list(itertools.accumulate(map(len, palette), initial=0))[:-1]
    colors = pa.array([c and dict(zip("rgb", c)) for c in itertools.chain(*palette)], _KINDS[5])
    color = lambda numbers: colors.take(pa.array(np.concatenate(numbers) + np.repeat(first, sizes)))
    double = lambda parts: pa.array(np.concatenate(parts), pa.float64())
    seq = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    boxes = pa.StructArray.from_arrays([double(c) for c in zip(*box)], fields=_BOX)
    columns = [pa.array(seq), pa.array(list(itertools.chain(*text)), pa.string()), pa.array(np.concatenate(page).astype(np.int32)), boxes, double(size), color(fg), color(bg)]
    return pa.StructArray.from_arrays(columns, fields=_FIELDS)


def _ranks(values: Sequence) -> pa.Array:
    """The number of each value among those that aren't None."""
    ranks = itertools.count()
    return pa.array([None if v is None else next(ranks) for v in values], pa.int64())


def attempt(read: Read, content: bytes) -> tuple[list[tuple] | Columns, Info, str | None]:
    """What a reader makes of a file; its error in place of an exception. Want of memory is the machine's error and not the file's: the task fails
    and is run again."""
    try:
        return *read(content), None
    except MemoryError:
        raise
    except RecursionError:
        return [], Info(0), "RecursionError: nested too deeply"
    except Exception as e:
        return [], Info(0), f"{type(e).__name__}: {e}"


def extract(files: DataFrame, read: Read) -> DataFrame:
    """doc_id, span columns, error, native_chars, page_area and image_area of files (doc_id, content). A file without spans gives one
    row with a null span_seq, with its error if it can't be read."""
    about = [("error", pa.string()), ("native_chars", pa.int64()), ("page_area", pa.float64()), ("image_area", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            """What is held, a row a span."""
            docs, spans, *rest = zip(*held)
            parts, sizes = [], []
            for whole, some in itertools.groupby(spans, lambda s: isinstance(s, Columns)):
                if whole:
                    some = list(some)
                    parts.append(column_array(some))
                    sizes += [len(s.text) for s in some]
                else:
                    for s in some:
                        parts.append(span_array(s or [None]))
                        sizes.append(len(parts[-1]))
            file = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            found = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
            columns = [pa.array(docs, pa.int64()).take(file), *found.flatten(), *[pa.array(c, k).take(file) for c, (_, k) in zip(rest, about)]]
            made = pa.record_batch(columns, names=["doc_id", *[f.name for f in SPAN_ARROW], *[name for name, _ in about]])
            for at in range(0, made.num_rows, ROWS):
                yield made.slice(at, ROWS)

        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans, info, error = attempt(read, content.as_py() or b"")
                count = len(spans.text) if isinstance(spans, Columns) else len(spans)
                held.append((doc, spans if count else [], error, *info))
                n += max(1, count)
                if n >= ROWS:
                    yield from rows()
                    held, n = [], 0
        if held:
            yield from rows()

    schema = f"doc_id long, {SPAN[len('struct<'):-1]}, error string, native_chars long, page_area double, image_area double"
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, schema)


def native_spans(extracted: DataFrame) -> DataFrame:
    """The spans alone."""
    return extracted.where("span_seq IS NOT NULL").drop("error", "native_chars", "page_area", "image_area")
