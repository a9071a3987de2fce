"""Vector code compression by segment-mean lower bounds (operator 11).

Every vector is cut into PARTS equal parts, and each part position has a codebook of up to ENTRIES integer entries, refined in ROUNDS rounds of
nearest-entry assignment and floored means. The nearest entry is found coarse to fine: a part and an entry are first compared by the means of
whole blocks and by the norms of what the means leave (their residuals), which bound the distance from below; each level has smaller blocks and
looks at the entries that the level above left. Entries whose bound is above the exact distance of one entry are out; the
others get exact integer distances, so no rounding decides and ties go to the lower index.

A round is one pass of tasks that hold the codebooks (they are bounded: PARTS * ENTRIES entries a length, HELD bytes at a time) and return one
sum a used entry and position; only these sums meet, and only the codebooks return to the driver. The table is read once a round, once for
the entries to begin with and once for the result, so a costly input should be written first.

Defined cases: vectors that are null or hold null or non-finite components are dropped; integers are held within 2**30 / length; vectors
of each length have codebooks of their own; a length that four doesn't divide is filled up with zeros, an empty vector has code 00000000
and error 0; fewer than ENTRIES vectors make as many entries; equal rows get equal codes, and rows that share a vec_id are ordered by their
vectors; a null vec_id sorts last and stays null; labels may have any type and are equal when they print alike; a sum of errors beyond 64 bits is
null; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, from_id, hot_join, to_id, trimmed, written
from .integers import doubles, integer_rows, usable

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024.0
#: Bytes of codebooks that a pass hands to every task; lengths beyond take passes of their own.
HELD = 64 << 20
#: Integers that the comparison of a block of parts with a codebook holds at once.
_CELLS = 1 << 21
#: A level compares with all entries at once while more than this share of them is left.
DENSE = 0.25

#: Codebooks (parts, entries, width) by the length of their vectors.
Books = dict[int, np.ndarray]


# ---- bounds


def block_widths(width: int) -> list[int]:
    """Widths of blocks from coarse to fine: the whole part, a quarter, an eighth."""
    found = [width, -(-width // 4), -(-width // 8)]
    return [w for k, w in enumerate(found) if w > 1 and w not in found[:k]] or [width]


def summary(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) to the sums of their blocks and the norms of their residuals. A last block that is narrower counts as filled up with zeros."""
    sums = np.add.reduceat(rows, np.arange(0, rows.shape[1], block), axis=1)
    # exact integers up to the root: the residual's square is |x|^2 - sum(s^2) / block
    rest = block * (rows * rows).sum(axis=1) - (sums * sums).sum(axis=1)
    return sums, np.sqrt(rest / block)


class Level(NamedTuple):
    """Blocks of one width: their sums and residual norms for all entries, and the entries' side of the bounds as one matrix."""

    block: int
    sums: np.ndarray
    rest: np.ndarray
    side: np.ndarray


#: What rounding may add to a bound, as a share of both squares.
SLACK = 1e-12


class Entries:
    """The entries of a codebook for one part, with what each level of the search needs of them."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.squares = (entries * entries).sum(axis=1) * (1 - SLACK)
        self.levels = []
        for block in block_widths(entries.shape[1]) if entries.shape[1] else []:
            sums, rest = summary(entries, block)
            self.levels.append(Level(block, sums, rest, np.column_stack([sums, rest, np.ones(len(entries)), self.squares]).T.copy()))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row, and its squared distance."""
        if not self.levels:
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        step = max(1, _CELLS // self.entries.size)
        done = [self._nearest(rows[k : k + step]) for k in range(0, len(rows), step)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = (rows * rows).sum(axis=1) * (1 - SLACK)
        every, near, best = np.arange(len(rows)), None, np.full(len(rows), 2**62)
        for level in self.levels:
            own, left = summary(rows, level.block)
            if near is None or near.mean() > DENSE:
                # sum((a - b)^2) / block + (r - s)^2 for all pairs; finer bounds are never below coarser ones
                bound = np.column_stack([own * (-2 / level.block), -2 * left, squares, np.ones(len(rows))]) @ level.side
            else:
                i, j = np.nonzero(near)
                bound = np.full(near.shape, np.inf)
                bound[i, j] = ((own[i] - level.sums[j]) ** 2).sum(axis=1) / level.block + (left[i] - level.rest[j]) ** 2 - SLACK * (squares[i] + self.squares[j])
            # the entry that looks nearest gives a distance that all others must stay below
            best = np.minimum(best, self._exact(rows, every, bound.argmin(axis=1)))
            near = bound <= best[:, None]
        i, j = np.nonzero(near)
        exact = self._exact(rows, i, j)
        best = np.minimum.reduceat(exact, np.searchsorted(i, every))
        at = np.flatnonzero(exact == best[i])
        _, first = np.unique(i[at], return_index=True)
        return j[at[first]], best

    def _exact(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The integer distances of pairs of a row and an entry."""
        off = rows.take(i, axis=0)
        off -= self.entries.take(j, axis=0)
        return np.einsum("ij,ij->i", off, off)


def parts_of(vectors: np.ndarray) -> np.ndarray:
    """(rows, length) to (parts, rows, width)."""
    width = -(-vectors.shape[1] // PARTS)
    full = np.pad(vectors, ((0, 0), (0, PARTS * width - vectors.shape[1])))
    return full.reshape(len(full), PARTS, width).transpose(1, 0, 2)


# ---- passes


def add_up(books: Books):
    """(id, label, vec) to (length, slot, pos, total) of each used entry: the sums of its parts, and how many there are at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = {n: [Entries(e) for e in book] for n, book in books.items()}
        totals = {n: np.zeros((book.shape[0], book.shape[1], book.shape[2] + 1), np.int64) for n, book in books.items()}
        for batch in batches:
            for _, x in integer_rows(batch.column(2), FACTOR):
                if x.shape[1] in books:
                    for k, part in enumerate(parts_of(x)):
                        index, _ = entries[x.shape[1]][k].nearest(part)
                        np.add.at(totals[x.shape[1]][k], index, np.pad(part, ((0, 0), (1, 0)), constant_values=1))
        for n, total in totals.items():
            total = total.reshape(-1, total.shape[2])
            slot, pos = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
            yield pa.record_batch([pa.array(np.full(len(slot), n)), pa.array(slot), pa.array(pos - 1), pa.array(total[slot, pos])], names=["length", "slot", "pos", "total"])

    return run


def encode(books: Books):
    """(id, label, vec) to (id, label, code, error, codebooks_sha256)."""
    digest = {n: sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() for n, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = {n: [Entries(e) for e in book] for n, book in books.items()}
        for batch in batches:
            for rows, x in integer_rows(batch.column(2), FACTOR):
                if x.shape[1] in books:
                    found = [e.nearest(part) for e, part in zip(entries[x.shape[1]], parts_of(x))]
                    codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                    error = sum(d for _, d in found)
                    own = [batch.column(k).take(pa.array(rows)) for k in range(2)]
                    yield pa.record_batch([*own, pa.array([c.tobytes().hex() for c in codes]), pa.array(error), pa.array([digest[x.shape[1]]] * len(rows))], names=["id", "label", "code", "error", "codebooks_sha256"])

    return run


def first_books(rows: DataFrame) -> Books:
    """For each length the parts of the vectors with the smallest ids. There are few lengths: rows of every length up to n hold n * n / 2 numbers."""
    books: Books = {}
    for n, *_ in rows.groupBy(F.size("vec")).count().collect():
        first = rows.where(F.size("vec") == n).orderBy("id", "vec").limit(ENTRIES).select("vec").toArrow().column(0).combine_chunks()
        for _, x in integer_rows(first, FACTOR):
            books[n] = np.ascontiguousarray(parts_of(x))
    return books


def refined(rows: DataFrame, books: Books) -> Books:
    """The codebooks after one round."""
    sums = rows.mapInArrow(trimmed(add_up(books)), "length long, slot long, pos long, total long")
    sums = sums.groupBy("length", "slot", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = list(zip(*sums.toArrow().to_pydict().values()))
    counts = {(n, slot): int(total) for n, slot, pos, total in sums if pos < 0}
    out = {n: book.copy() for n, book in books.items()}
    for n, slot, pos, total in sums:
        if pos >= 0:
            part, entry = divmod(slot, out[n].shape[1])
            out[n][part, entry, pos] = int(total) // counts[n, slot]
    return out


def in_batches(books: Books) -> Iterator[Books]:
    """Codebooks of HELD bytes at most, or of one length."""
    now: Books = {}
    for n in sorted(books):
        if now and sum(b.nbytes for b in now.values()) + books[n].nbytes > HELD:
            yield now
            now = {}
        now[n] = books[n]
    yield now


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label")
    rows = vectors.select(to_id(id_col).alias("id"), label, doubles(vectors, vector_col).alias("vec")).where(usable(F.col("vec")))
    coded = None
    for books in in_batches(first_books(rows)):
        for _ in range(ROUNDS):
            books = refined(rows, books)
        some = rows.mapInArrow(trimmed(encode(books)), "id long, label string, code string, error long, codebooks_sha256 string")
        coded = some if coded is None else coded.union(some)
    coded = written(coded, "codes")
    labels = written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")), "labels")
    if labels.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        out = coded.join(F.broadcast(labels), "label")
    else:
        out = hot_join(coded, labels, "label", coded.count(), "n")
    return out.select(from_id("id").alias("vec_id"), "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"), "codebooks_sha256")
