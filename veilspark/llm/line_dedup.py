"""Line dedup by two Bloom filters and an exact confirmation (operator 6).

Pass 1 puts every line's hash into a once-seen filter and, when its bits were there already, into a
twice-seen filter. Tasks build the two for their own documents as sorted bit positions in segments of 2^16 bits;
merging two segments adds to the twice-seen bits those that both once-seen sides have. The twice-seen
filter has no false negatives, so a line that misses it occurs in one document alone.
Pass 2 keeps the lines whose bits are all in the twice-seen filter. Only their 128-bit digests are shuffled, to
count documents and choose the smallest doc_id. Pass 3 sends only the texts that lose a line to the join with their drop lists; which they
are is told by a third filter, over the rows' own digests, so no false alarm of the second moves a text.

The filter is broadcast. It takes 8 bits a line up to MOST_BITS (64 MB, 67 million lines), where about one unrepeated line in
1500 is suspected. Up to PASSES times as many lines are filtered by ranges of their hashes, a pass over the texts for each. Beyond
that a further reading of all texts would cost more than it saves, and more lines are suspected: 7 in 100 at 2 bits a line, all
in the end. The exact confirmation, 40 bytes a suspect to shuffle, decides in any case: results never depend on the filters.

Defined cases: a null or empty text is one empty line; a null doc_id is a document after all
others; rows with the same doc_id are one document, so a line they share isn't repeated by that, and the smallest doc_id's rows all
keep it; ties need no rule, as the smallest doc_id keeps a line; a very long text is held with its list of lines, about eleven times
its bytes; extra columns are left alone, or passed through under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, drop_written, from_id, hot_join, to_id, trimmed, unpacked, whole_row, written

LEAST_CHARS = 10
BITS_A_LINE, LEAST_BITS, MOST_BITS, PASSES = 8, 1 << 20, 1 << 29, 8
SEGMENT = 1 << 16
#: From so many positions on, a segment travels as a bitmap.
DENSE = 4096


def key_of(line: bytes) -> bytes | None:
    """The line's key, or None if it has under LEAST_CHARS code points."""
    key = line.strip(SPACE).lower()
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def keyed_lines(text: bytes) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    lines = text.split(b"\n")
    return lines, [(i, digest(k)) for i, x in enumerate(lines) if (k := key_of(x)) is not None]


def row_key(doc: int, text: bytes) -> bytes:
    """What names a row: equal ones lose the same lines."""
    return hashlib.blake2b(text, digest_size=16, salt=doc.to_bytes(8, "little", signed=True)).digest()


def in_range(digests: list[bytes], part: int, parts: int) -> list[bytes]:
    """Those that a pass looks at."""
    return digests if parts == 1 else [d for d in digests if d[15] % parts == part]


def positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """(n, 2) filter positions of an array of 16-byte digests; bits is a power of two."""
    return (digests.view("<u8").reshape(-1, 2) & np.uint64(bits - 1)).astype(np.int64)


def _packed(pos: np.ndarray) -> bytes:
    if len(pos) < DENSE:
        return pos.astype("<u2").tobytes()
    flags = np.zeros(SEGMENT, np.uint8)
    flags[pos] = 1
    return np.packbits(flags).tobytes()


def _flags(packed: bytes) -> np.ndarray:
    if len(packed) == SEGMENT // 8:
        return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    flags = np.zeros(SEGMENT, bool)
    flags[np.frombuffer(packed, "<u2")] = True
    return flags


def _segments(pos: np.ndarray) -> dict[int, np.ndarray]:
    seg = pos // SEGMENT
    cut = np.flatnonzero(np.diff(seg)) + 1
    return {int(x[0] // SEGMENT): x % SEGMENT for x in np.split(pos, cut) if len(x)}


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    ids = batch.column(0).to_pylist()
    for i, text in zip(ids, batch.column(1).cast(pa.binary())):
        yield i, text.as_py() or b""


def build_filters(bits: int, part: int = 0, parts: int = 1):
    """Task side of pass 1: (segment, once, twice) rows of this task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = [], []
        for batch in batches:
            # each line once a document: a document may not confirm its own line
            found = [b"".join(in_range(list({d for _, d in keyed_lines(text)[1]}), part, parts)) for _, text in _texts(batch)]
            uniq, n = np.unique(positions(np.frombuffer(b"".join(found), np.uint8), bits), return_counts=True)
            seen.append(uniq)
            twice.append(uniq[n > 1])
        if not seen:
            return
        uniq, n = np.unique(np.concatenate(seen), return_counts=True)
        yield from _segment_rows(uniq, np.union1d(uniq[n > 1], np.concatenate(twice)))

    return run


def _segment_rows(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = _segments(once), _segments(twice)
    none = np.zeros(0, np.int64)
    rows = [(s, _packed(a.get(s, none)), _packed(b.get(s, none))) for s in sorted(a.keys() | b.keys())]
    for k in range(0, len(rows), 256):
        s, x, y = zip(*rows[k : k + 256])
        yield pa.record_batch([pa.array(s, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["seg", "once", "twice"])


def build_members(bits: int):
    """(key) to segments of a filter that holds all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.unique(positions(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), bits)) for batch in batches]
        yield from _segment_rows(np.zeros(0, np.int64), np.unique(np.concatenate([np.zeros(0, np.int64), *found])))

    return run


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by segment and merges those of one segment; memory holds one segment."""
    at, once, twice = None, None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at], pa.int32()), pa.array([_packed(np.flatnonzero(twice))], pa.binary())], names=["seg", "twice"])

    for batch in batches:
        for seg, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            if seg != at:
                if at is not None and twice.any():
                    yield row()
                at, once, twice = seg, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            x = _flags(x)
            twice |= (once & x) | _flags(y)
            once |= x
    if at is not None and twice.any():
        yield row()


def merged_filter(parts: DataFrame, bits: int) -> bytes:
    """The twice side of segments (seg, once, twice) put together, bits / 8 bytes."""
    merged = parts.repartition("seg").sortWithinPartitions("seg").mapInArrow(trimmed(merge_filters), "seg int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for seg, packed in merged.collect():  # bits / 8 bytes at most
        out[seg * SEGMENT // 8 : (seg + 1) * SEGMENT // 8] = np.packbits(_flags(bytes(packed)))
    return out.tobytes()


def twice_seen(texts: DataFrame, bits: int, part: int = 0, parts: int = 1) -> bytes:
    """The merged twice-seen filter of a pass; texts has (id, text)."""
    return merged_filter(texts.mapInArrow(trimmed(build_filters(bits, part, parts)), "seg int, once binary, twice binary"), bits)


def bits_for(n: int) -> int:
    """Bits of a filter for n members: a power of two within the bounds."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_LINE * n):
        bits *= 2
    return bits


def _hits(filter_bytes: np.ndarray, digests: bytes, bits: int) -> np.ndarray:
    pos = positions(np.frombuffer(digests, np.uint8), bits)
    return ((filter_bytes[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)


def suspects(shared, bits: int, part: int = 0, parts: int = 1):
    """Pass 2: (key, id, digest) of each row's suspected lines, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys, ids, found = [], [], []
            for i, text in _texts(batch):
                own = in_range(list({d for _, d in keyed_lines(text)[1]}), part, parts)
                if own:
                    own = [own[k] for k in np.flatnonzero(_hits(bloom, b"".join(own), bits))]
                if own:
                    keys += [row_key(i, text)] * len(own)
                    ids += [i] * len(own)
                    found += own
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["key", "id", "digest"])

    return run


def classify(shared, bits: int):
    """Pass 3, before the join: every row gets its key, and its text if it may lose a line; only then is it looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            n_lines, keys, sha, texts = [], [], [], []
            for i, text in _texts(batch):
                keys.append(row_key(i, text))
                n_lines.append(text.count(b"\n") + 1)
                hit = bool(_hits(lost, keys[-1], bits)[0])
                sha.append(None if hit else hashlib.sha256(text).hexdigest())
                texts.append(text if hit else None)
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary())], names=["id", "key", "n_lines", "sha", "text"])

    return run


def kept_lines(text: bytes, drops: set[bytes]) -> tuple[int, int, bytes]:
    """Lines, dropped lines and what is left of a text."""
    lines = text.split(b"\n")
    if not drops:
        return len(lines), 0, text
    keep = [x for x in lines if (k := key_of(x)) is None or digest(k) not in drops]
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3, after the join: (id, n_lines, sha, text, drops) to the result."""
    for batch in batches:
        ids, n_lines, sha = (batch.column(k).to_pylist() for k in range(3))
        dropped = [0] * len(ids)
        for k, known in enumerate(sha):
            if known is None:
                _, dropped[k], kept = kept_lines(batch.column(3)[k].as_py(), set(batch.column(4)[k].as_py() or ()))
                sha[k] = hashlib.sha256(kept).hexdigest()
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_lines", "n_dropped", "kept_sha256"])


def marked(shared, bits: int, is_open: bool):
    """(id, text, row) to (key, row) of the rows that may lose a line, or of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys = [row_key(i, text) for i, text in _texts(batch)]
            hit = _hits(lost, b"".join(keys), bits) if keys else np.zeros(0, bool)
            out = pa.record_batch([pa.array(keys, pa.binary()), batch.column(2)], names=["key", "row"])
            yield out.filter(pa.array(hit == is_open))

    return run


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, drops) to (row, kept, n_lines, n_dropped)."""
    for batch in batches:
        kept, n, gone = [], [], []
        for text, drops in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            x = kept_lines(text.as_py() or b"", set(drops.as_py() or ()))
            n.append(x[0])
            gone.append(x[1])
            kept.append(x[2] if text.as_py() is not None else None)
        yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])


class Lost(NamedTuple):
    """What rows lose: (key, drops, n) rows, with n of the table's rows for a key; how many such rows there are; and the filter of their keys."""

    drops: DataFrame
    rows: int
    shared: Broadcast
    bits: int


def lost_lines(texts: DataFrame) -> Lost:
    """The lines that rows (id, text) lose."""
    spark = texts.sparkSession
    lines = texts.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    parts = min(PASSES, max(1, -(-BITS_A_LINE * lines // MOST_BITS)))
    bits, passes = bits_for(-(-lines // parts)), []
    for part in range(parts):
        shared = spark.sparkContext.broadcast(twice_seen(texts, bits, part, parts))
        passes.append(written(texts.mapInArrow(trimmed(suspects(shared, bits, part, parts)), "key binary, id long, digest binary"), "suspects"))
        shared.unpersist()
    found = functools.reduce(DataFrame.union, passes)
    confirmed = found.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("_last"), F.count("*").alias("n")).where("keeper <> _last").drop("_last")
    lost = hot_join(found, confirmed, "digest", found.count(), "n").where("id <> keeper")
    drops = lost.groupBy("key", "digest").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list("digest").alias("drops"), F.max("n").alias("n"))
    drops = written(drops, "drops")
    drop_written(*passes)
    keys, rows = drops.agg(F.count("*"), F.sum("n")).first()
    bits = bits_for(keys)
    members = drops.select("key").mapInArrow(trimmed(build_members(bits)), "seg int, once binary, twice binary")
    return Lost(drops, rows or 0, spark.sparkContext.broadcast(merged_filter(members, bits)), bits)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    texts = docs.select(to_id(id_col).alias("id"), F.col(text_col).alias("text"))
    lost = lost_lines(texts)
    looked = texts.mapInArrow(trimmed(classify(lost.shared, lost.bits)), "id long, key binary, n_lines long, sha string, text binary")
    out = hot_join(looked, lost.drops, "key", lost.rows, "n").select("id", "n_lines", "sha", "text", "drops")
    out = out.mapInArrow(trimmed(finish), "id long, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(from_id("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated lines taken out of their texts, the columns unchanged but for the text and its length."""
    lost = lost_lines(docs.select(to_id(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = docs.select(to_id(id_col).alias("id"), F.col(text_col).alias("text"), whole_row(docs).alias("row"))
    kind = rows.schema["row"].dataType
    # rows that lose nothing stay where they are: looking at texts twice costs less than moving them
    part = lambda is_open: rows.select("id", "text", "row").mapInArrow(trimmed(marked(lost.shared, lost.bits, is_open)), StructType().add("key", "binary").add("row", kind))
    out = hot_join(part(True), lost.drops, "key", lost.rows, "n").select("row", F.col(f"row.`{text_col}`").alias("text"), "drops")
    out = out.mapInArrow(trimmed(rewrite), StructType().add("row", kind).add("kept", "string").add("n_lines", "long").add("n_dropped", "long"))
    value = {text_col: F.col("kept")}
    if chars_col in docs.columns:
        value[chars_col] = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col(f"row.`{chars_col}`")).cast(docs.schema[chars_col].dataType)
    out = out.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return unpacked(part(False)).union(out)
