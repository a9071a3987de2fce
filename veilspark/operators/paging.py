"""Pages and lines of paragraphs, as a parallel prefix over what paragraphs do to a line counter.

A paragraph takes a line. One of the body ends its page when it holds a page break or when its line is the LINES-th or beyond; paragraphs of
tables, headers, footers and boxes take lines but never end a page, so the counter may run past LINES. Where a paragraph stands depends on
all before it, but what a run of paragraphs does to the counter is a function of the line it begins on: until its first page end it just
counts, and after that the beginning no longer matters. Such a function is a table of LINES entries, as all lines from the last on act alike.

So parts of PART paragraphs are turned into tables side by side, a pass over one small row a part composes them and finds the line
and page on which each part begins, and the parts are then paged side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a page; a part has 2**PART_BITS paragraphs at most.
LINES, PART_BITS = 40, 12

#: Kinds of paragraphs: outside the body, of the body, of the body with a page break.
OUTSIDE, BODY, BREAK = 0, 1, 2


def page_ends(kinds: np.ndarray) -> np.ndarray:
    """For each paragraph, the one that ends the page if this one stands on line 0; len(kinds) if none does. One more entry for the end."""
    n = len(kinds)
    body, broken = np.flatnonzero(kinds != OUTSIDE), np.flatnonzero(kinds == BREAK)
    following = lambda found, at: np.append(found, n)[np.searchsorted(found, at)]
    at = np.arange(n + 1)
    return np.minimum(following(body, at + LINES - 1), following(broken, at))


def first_end(kinds: np.ndarray, line: int) -> int:
    """The paragraph that ends the first page if the first one stands on this line."""
    n = len(kinds)
    full = np.flatnonzero(kinds[max(0, LINES - 1 - line) :] != OUTSIDE)
    broken = np.flatnonzero(kinds == BREAK)
    return min(full[0] + max(0, LINES - 1 - line) if len(full) else n, broken[0] if len(broken) else n)


def transition(kinds: np.ndarray) -> tuple[list[int], list[int]]:
    """For each line to begin on: how many pages end, and the line after the last paragraph (counted from the beginning if no page ends)."""
    n, ends = len(kinds), page_ends(kinds)
    after: dict[int, tuple[int, int]] = {}

    def from_top(at: int) -> tuple[int, int]:
        path = []
        while at not in after and ends[at] < n:
            path.append(at)
            at = int(ends[at]) + 1
        pages, line = after.setdefault(at, (0, n - at))
        for k, p in enumerate(reversed(path), 1):
            after[p] = (pages + k, line)
        return pages + len(path), line

    out = []
    for line in range(LINES):
        end = int(first_end(kinds, line))
        pages, last = from_top(end + 1) if end < n else (-1, n)
        out.append((pages + 1, last))
    return [p for p, _ in out], [x for _, x in out]


def places(kinds: np.ndarray, page: int, line: int) -> tuple[np.ndarray, np.ndarray]:
    """Page and line of every paragraph."""
    n, ends = len(kinds), page_ends(kinds)
    starts, at = [], int(first_end(kinds, line)) + 1
    while at <= n:
        starts.append(at)
        at = int(ends[at]) + 1 if at < n else n + 1
    number = np.searchsorted(starts, np.arange(n), side="right")
    begins = np.array([-line, *starts])
    return page + number, np.arange(n) - begins[number]


# ---- tasks


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, seqs, kinds) to (doc_id, part, n, pages, lines)."""
    for batch in batches:
        found = [transition(np.array(kinds)) for kinds in batch.column("kinds").to_pylist()]
        n = pa.array([len(k) for k in batch.column("kinds")], pa.int64())
        yield pa.record_batch([batch.column("doc_id"), batch.column("part"), n, pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "part", "n", "pages", "lines"])


def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables in order to (doc_id, part, page, line): where each part begins. All that is held is one place."""
    now, page, line, first = None, 1, 0, True
    for batch in batches:
        out = []
        for doc, part, n, pages, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if first or doc != now:
                now, page, line, first = doc, 1, 0, False
            out.append((doc, part, page, line))
            at = min(line, LINES - 1)
            page, line = page + pages[at], lines[at] if pages[at] else line + n
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "part", "page", "line"])


def paged_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, seqs, kinds, page, line) to (doc_id, para_seq, page_number, line)."""
    for batch in batches:
        for doc, seqs, kinds, page, line in zip(*(c.to_pylist() for c in batch.columns)):
            pages, lines = places(np.array(kinds), page, line)
            yield pa.record_batch([pa.array([doc] * len(seqs), pa.int64()), pa.array(seqs, pa.int64()), pa.array(pages, pa.int32()), pa.array(lines, pa.int64())], names=["doc_id", "para_seq", "page_number", "line"])


def paged(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_seq, page_number (from 1) and line (from 0) of paragraphs (doc_id, para_seq, in_body, breaks), which follow one
    another by para_seq. A null flag counts as false; a document has its paragraphs' numbers once each."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    kind = F.when(~flag("in_body"), OUTSIDE).when(flag("breaks"), BREAK).otherwise(BODY)
    rows = paragraphs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("para_seq").cast("long").alias("para_seq"), kind.alias("kind"))
    parts = rows.groupBy("doc_id", F.shiftright("para_seq", PART_BITS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("para_seq", "kind"))).alias("items"))
    parts = parts.select("doc_id", "part", F.col("items.para_seq").alias("seqs"), F.col("items.kind").alias("kinds"))
    found = parts.mapInArrow(tables, "doc_id long, part long, n long, pages array<long>, lines array<long>")
    begun = found.repartition("doc_id").sortWithinPartitions("doc_id", "part").mapInArrow(starts, "doc_id long, part long, page long, line long")
    placed = parts.join(begun.withColumnRenamed("doc_id", "_doc").withColumnRenamed("part", "_at"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_at")))
    return placed.select("doc_id", "seqs", "kinds", "page", "line").mapInArrow(paged_parts, "doc_id long, para_seq long, page_number int, line long")
