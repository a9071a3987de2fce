"""Byte-level BPE encoding by corpus-level merge replay, and decoding (operator 8).

Every distinct word of the corpus is merged once. Texts are split by the vocabulary's pattern in blocks of about BLOCK code points; a
block's texts are kept as numbers of its distinct words. The words of all blocks are dealt by their hash, so equal ones meet, and
about PART_BYTES of text share a part, however large the corpus. A part's distinct words are replayed together, and each block
gets the ids of its words back, from which its texts' ids are put together.

Replay: an inverted index holds, for every merge, the word positions where its pair of tokens stands. Merges are replayed in rank order,
each on all its positions at once; a merge touches only its own positions and their two neighbours, whose new pairs enter the index
under their own, later ranks. The index is kept in windows of ranks: what a window's merges add for later windows is dealt out once,
when the window is done.

A vocabulary may hold pairs that rank below the merge that makes them (if it was not trained by these very merges).
Words in which such a pair turns up, and long words, are replayed apart, one position at a time with a queue, so
every word is merged lowest rank first and leftmost first, as the tiktoken library does.

Moved are a block's distinct words, and its texts as packed word numbers, about a third of their bytes; no word is a hot key, as a
block names it once.

Defined cases: a null text is empty and has no ids; rows with equal texts or ids, and rows equal in all columns, are encoded one by one;
ties between merges of one rank go to the leftmost; a very long text is a block of its own, split a PIECE at a time, with about eight times its
bytes held, and a very long run without a place to cut is a word of about 40 times its bytes; a null doc_id stays null; extra columns are
ignored, or passed through under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import pack_numbers, trimmed, unpack_numbers, written

#: Bytes of a word that is replayed together with others.
WORD_BYTES = 64
#: Ranks of a window of the inverted index.
WINDOW = 256
#: Code points of a text that are split into words at once; the cut is moved to where the pattern cuts anyway.
PIECE = 1 << 20
#: Code points of the texts of a block, and bytes of text for each part of the words.
BLOCK, PART_BYTES = 8 << 20, 16 << 20
#: Words of texts that are packed together.
CHUNK = 1 << 18
#: Bytes of words that are replayed together.
TOGETHER = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """Which pairs of ids merge to which id: an open-addressed table that numpy probes for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.none = np.int32(self.size)
        self.byte_ids = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.none, np.int32)
        left = np.array(list(pairs), np.int64)
        value = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        self.probes = 0
        while len(left):  # each turn, one key of those that want a free slot takes it
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.keys[slot[take]], self.values[slot[take]] = left[take], value[take]
            left, value, slot = left[~take], value[~take], (slot[~take] + 1) & self.mask

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The table as a dictionary, for words that are replayed one position at a time."""
        held = self.keys >= 0
        return dict(zip(self.keys[held].tolist(), self.values[held].tolist()))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that a and b merge to, `none` where they don't."""
        keys = a.astype(np.int64) * self.size + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], self.none)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


def replay(word: bytes, merges: Merges) -> np.ndarray:
    """The ids of one word, by an index of its positions and a queue of ranks."""
    n, none, size, pairs = len(word), int(merges.none), merges.size, merges.pairs
    if not n:
        return np.zeros(0, np.int32)
    first = merges.byte_ids[np.frombuffer(word, np.uint8)]
    token, right, left = array("i", first.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    index: dict[int, array] = {}
    for k in range(0, n - 1, PIECE):
        got = merges.of(first[k : min(k + PIECE, n - 1)], first[k + 1 : k + PIECE + 1])
        for rank in np.unique(got[got < none]).tolist():
            index.setdefault(rank, array("i")).frombytes((np.flatnonzero(got == rank) + k).astype(np.int32).tobytes())
    queue = list(index)
    heapq.heapify(queue)

    def enter(at: int, rank: int) -> None:
        if rank not in index:
            index[rank] = array("i")
            heapq.heappush(queue, rank)
        index[rank].append(at)

    while queue:
        rank = heapq.heappop(queue)
        places = np.unique(np.frombuffer(index.pop(rank), np.int32))
        lower = False
        for k in range(0, len(places), 4096):
            for j, at in enumerate(places[k : k + 4096].tolist(), k):
                then = right[at]
                if token[at] < 0 or then >= n or pairs.get(token[at] * size + token[then]) != rank:
                    continue  # a merge at its left has taken it
                after = right[then]
                token[at], token[then], right[at] = rank, -1, after
                if after < n:
                    left[after] = at
                    if (r := pairs.get(rank * size + token[after])) is not None:
                        enter(at, r)
                        lower = lower or r < rank
                if (before := left[at]) >= 0 and (r := pairs.get(token[before] * size + rank)) is not None:
                    enter(before, r)
                    lower = lower or r < rank
                if lower:  # a lower pair goes before the places that are left
                    for x in places[j + 1 :].tolist():
                        enter(x, rank)
                    break
            if lower:
                break
    out = np.frombuffer(token, np.int32)
    return out[out >= 0]


def replay_corpus(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word), by the windowed index."""
    byte_ids = merges.byte_ids
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    flat = np.frombuffer(b"".join(words), np.uint8)
    token = byte_ids[flat]
    ends = np.cumsum(sizes)
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    # position n stands for no neighbour
    right[ends[sizes > 0] - 1] = n
    left[(ends - sizes)[sizes > 0]] = n
    token = np.append(token, np.int32(0))
    right, left = np.append(right, n), np.append(left, n)
    none = int(merges.none)
    pair = np.full(n + 1, none, np.int32)
    at = np.flatnonzero(right[:n] < n)
    pair[at] = merges.of(token[at], token[right[at]])
    odd: list[np.ndarray] = []
    pools: list[list[np.ndarray]] = [[] for _ in range(none // WINDOW + 1)]

    def deal(pos: np.ndarray) -> None:
        """Positions whose pairs can merge to the pools of their windows."""
        pos = pos[pair[pos] < none]
        if not len(pos):
            return
        window = pair[pos] // WINDOW
        order = np.argsort(window, kind="stable")
        pos, window = pos[order], window[order]
        cut = np.flatnonzero(np.diff(window)) + 1
        for part, w in zip(np.split(pos, cut), window[np.concatenate([[0], cut])].tolist()):
            pools[w].append(part)

    deal(at)
    for w, pool in enumerate(pools):
        if not pool:
            continue
        low, high = w * WINDOW, min((w + 1) * WINDOW, none)
        later: list[np.ndarray] = []
        queue: dict[int, list[np.ndarray]] = {}

        def file(pos: np.ndarray) -> None:
            """Positions with pairs of this window under their ranks."""
            order = np.argsort(pair[pos], kind="stable")
            pos = pos[order]
            own = pair[pos]
            cut = np.flatnonzero(np.diff(own)) + 1
            for part, r in zip(np.split(pos, cut), own[np.concatenate([[0], cut])].tolist()):
                if r in queue:
                    queue[r].append(part)
                else:
                    queue[r] = [part]
                    heapq.heappush(heap, r)

        heap: list[int] = []
        pos = np.concatenate(pool)
        pos = pos[(pair[pos] >= low) & (pair[pos] < high)]
        if len(pos):
            file(pos)
        while heap:
            rank = heapq.heappop(heap)
            parts = queue.pop(rank)
            p = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            p = p[pair[p] == rank]
            if len(p) > 1:
                p = p[np.append(True, p[1:] != p[:-1])]
                # of places that overlap, every other one merges, from the left
                over = right[p[:-1]] == p[1:]
                if over.any():
                    run = np.arange(len(p))
                    begin = np.maximum.accumulate(np.where(np.append(False, over), 0, run))
                    p = p[(run - begin) % 2 == 0]
            if not len(p):
                continue
            q = right[p]
            after = right[q]
            if len(p) > 1 and (meet := after[:-1] == p[1:]).any():
                # between two merges side by side, a pair of the first with the second's left token stands for a moment
                k = np.flatnonzero(meet)
                low_pair = merges.of(np.full(len(k), rank, np.int32), token[p[k + 1]]) <= rank
                odd.append(p[k[low_pair]])
            token[p] = rank
            right[p] = after
            left[after] = p
            pair[q] = none
            before = left[p]
            has = after < n
            pair[p] = none
            pair[p[has]] = merges.of(token[p[has]], token[after[has]])
            b = before[before < n]
            pair[b] = merges.of(token[b], token[right[b]])
            fresh = np.concatenate([p[has], b])
            got = pair[fresh]
            if (got <= rank).any():
                odd.append(fresh[got <= rank])
                fresh, got = fresh[got > rank], got[got > rank]
            near = got < high
            if near.any():
                file(np.unique(fresh[near]))
            later.append(fresh[~near])
        if later:
            deal(np.concatenate(later))
    live = np.zeros(n, bool)
    now = (ends - sizes)[sizes > 0]
    while len(now):  # a walk along the tokens that are left
        live[now] = True
        now = right[now]
        now = now[now < n]
    word = np.repeat(np.arange(len(words)), sizes)
    count = np.bincount(word[live], minlength=len(words))
    ids = token[:n][live]
    if odd and len(bad := np.unique(word[np.concatenate(odd)])):
        ids, count = _instead(ids, count, {k: replay(words[k], merges) for k in bad.tolist()})
    return ids, count


def _instead(ids: np.ndarray, count: np.ndarray, own: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts with those of some words put in their places."""
    ends = np.cumsum(count)
    parts, at = [], 0
    for k, x in sorted(own.items()):
        parts += [ids[at : ends[k] - count[k]], x]
        at = ends[k]
        count[k] = len(x)
    return np.concatenate([*parts, ids[at:]]), count


def replay_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """As replay_corpus(), for any number of words of any length: about TOGETHER bytes at once, long words apart."""
    ids, counts, at, size = [], [], 0, 0
    for k, w in enumerate(words, 1):
        size += len(w) if len(w) <= WORD_BYTES else 0
        if size >= TOGETHER or k == len(words):
            group = words[at:k]
            got, count = replay_corpus([w if len(w) <= WORD_BYTES else b"" for w in group], merges)
            long = {j: replay(w, merges) for j, w in enumerate(group) if len(w) > WORD_BYTES}
            got, count = _instead(got, count, long) if long else (got, count)
            ids.append(got)
            counts.append(count)
            at, size = k, 0
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *ids]), np.concatenate([none, *counts]).astype(np.int64)


def pieces(split: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The pattern's matches, some at a time. A piece ends before the last match that it shows whole."""
    if len(text) <= PIECE:
        yield split.findall(text)
        return
    at = 0
    while at < len(text):
        size = PIECE
        while True:
            part = [m.span() for m in split.finditer(text, at, min(len(text), at + size))]
            if at + size >= len(text) or len(part) > 2:
                break
            size *= 2
        # the last matches might go on, or end otherwise, when more text follows
        ends = part if at + size >= len(text) else part[:-2]
        yield [text[a:b] for a, b in ends]
        at = ends[-1][1] if ends else len(text)


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.split = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> list[int]:
        return [x for words in pieces(self.split, text) for x in replay_words([w.encode() for w in words], self.merges)[0].tolist()]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


# ---- tasks


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack_numbers(np.fromiter(map(len, words), np.uint32, len(words)))
    joined = b"".join(words)
    return len(sizes).to_bytes(8, "little") + sizes + len(joined).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(joined, asbytes=True)


def unpack_words(packed: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(packed[:8], "little")
    ends = np.cumsum(unpack_numbers(packed[8:at])).tolist()
    joined = pa.Codec("zstd").decompress(packed[at + 8 :], int.from_bytes(packed[at : at + 8], "little"), asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def split_texts(pattern: str, parts: int):
    """(row, text) to a block's texts (key, rows, sizes, numbers), many in one row, and its words (key, block, numbers, words), whose
    numbers are differences. The key of texts is their block, the key of words their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        block = -1 - (TaskContext.get().partitionId() << 32)  # below 0, where no part is
        known: dict[str, int] = {}
        size, kind = 0, None

        def record(keys: list, rows: pa.Array | None, sizes: list, numbers: list[bytes], words: list) -> pa.RecordBatch:
            n = len(numbers)
            blocks = [None if w is None else block for w in words]
            listed = pa.nulls(n, pa.list_(kind)) if rows is None else pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            columns = [pa.array(keys, pa.int64()), pa.array(blocks, pa.int64()), listed, pa.array(sizes, pa.binary()), pa.array(numbers, pa.binary()), pa.array(words, pa.binary())]
            return pa.record_batch(columns, names=["key", "block", "rows", "sizes", "numbers", "words"])

        def all_words() -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in known]
            part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
            begin = 0
            for k in range(0, len(ends), 4096):
                cut = ends[k : k + 4096].tolist()
                own = [order[a:b] for a, b in zip([begin, *cut[:-1]], cut)]
                begin = cut[-1]
                yield record([int(part[x[0]]) for x in own], None, [None] * len(own), [pack_numbers(np.diff(x, prepend=0)) for x in own], [pack_words([words[i] for i in x.tolist()]) for x in own])

        for batch in batches:
            kind = batch.column(0).type
            at, numbers, sizes, held = 0, [], [], 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                own = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words)) for words in pieces(split, text)]
                numbers += own
                sizes.append(sum(map(len, own)))
                held += sizes[-1]
                size += len(text)
                full = size > BLOCK
                if full or held > CHUNK or k + 1 == batch.num_rows:
                    packed = pack_numbers(np.concatenate([np.zeros(0, np.uint32), *numbers]))
                    yield record([block], batch.column(0).slice(at, len(sizes)), [pack_numbers(np.array(sizes))], [packed], [None])
                    at, numbers, sizes, held = k + 1, [], [], 0
                if full:
                    yield from all_words()
                    known.clear()
                    size, block = 0, block - 1
        if known:
            yield from all_words()

    return run


def encode_part(path: str, pattern: str):
    """The words of a part from all blocks to their ids: (key, numbers, ids, counts) by block, each distinct word being replayed once."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        lists = []
        for packed in rows["words"]:
            words = unpack_words(packed.as_py())
            lists.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        ids, count = replay_words(list(known), codec(path, pattern).merges)
        starts = np.cumsum(count) - count
        out_ids = [pack_numbers(gathered(ids, starts[at], count[at])) for at in lists]
        out_counts = [pack_numbers(count[at]) for at in lists]
        return pa.table([rows["block"], rows["numbers"], pa.array(out_ids, pa.binary()), pa.array(out_counts, pa.binary())], names=["key", "numbers", "ids", "counts"])

    return run


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    end = np.cumsum(counts)
    return flat[np.repeat(starts - (end - counts), counts) + np.arange(end[-1] if len(end) else 0)]


class Words:
    """The ids of a block's words by their numbers, the ids spelled as decimals, and what they decode to."""

    def __init__(self, own: Codec, rows: pa.Table) -> None:
        parts = [tuple(unpack_numbers(x.as_py()) for x in row) for row in zip(rows["numbers"], rows["ids"], rows["counts"])]
        n = sum(len(numbers) for numbers, _, _ in parts)
        self.starts, self.counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        base = 0
        for numbers, ids, count in parts:
            numbers = np.cumsum(numbers.astype(np.int64))
            count = count.astype(np.int64)
            self.counts[numbers], self.starts[numbers] = count, base + np.cumsum(count) - count
            base += len(ids)
        self.flat = np.concatenate([np.zeros(0, np.uint32), *[ids for _, ids, _ in parts]]).astype(np.int32)
        text, tokens = list(map(str, self.flat.tolist())), list(map(own.tokens.__getitem__, self.flat.tolist()))
        spans = list(zip(self.starts.tolist(), (self.starts + self.counts).tolist()))
        self.spelled = [text[a] if b == a + 1 else ",".join(text[a:b]) for a, b in spans]
        self.decoded = [tokens[a] if b == a + 1 else b"".join(tokens[a:b]) for a, b in spans]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.starts[numbers], self.counts[numbers])

    def digests(self, numbers: np.ndarray) -> tuple[int, str, str]:
        """How many ids a text has, and the digests of them spelled and decoded."""
        spelled, plain, mark = hashlib.sha256(), hashlib.sha256(), ""
        for k in range(0, len(numbers), PIECE):
            own = numbers[k : k + PIECE].tolist()
            spelled.update((mark + ",".join(map(self.spelled.__getitem__, own))).encode())
            plain.update(b"".join(map(self.decoded.__getitem__, own)))
            mark = ","
        return int(self.counts[numbers].sum()), spelled.hexdigest(), plain.hexdigest()


def assemble(path: str, pattern: str, with_ids: bool):
    """A block's texts and words to (row, n_tokens, ids_sha256, decoded_sha256), with the ids if they are wanted."""

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        known = Words(codec(path, pattern), words)
        out: list[list] = [[], [], []]
        lists = [np.zeros(0, np.int32)]
        for sizes, packed in zip(texts["sizes"], texts["numbers"]):
            numbers = unpack_numbers(packed.as_py())
            for own in np.split(numbers, np.cumsum(unpack_numbers(sizes.as_py()))[:-1]):
                for column, value in zip(out, known.digests(own)):
                    column.append(value)
                if with_ids:
                    lists.append(known.ids(own))
        columns = [texts["rows"].combine_chunks().flatten(), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string()))]]
        if with_ids:
            ends = np.cumsum([len(x) for x in lists]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
        return pa.table(columns, names=["row", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run


# ---- operators


def is_scan(df: DataFrame) -> bool:
    """Whether df's rows come in the same order and partitions each time: it reads files and does no more than choose rows and columns."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub("^[^A-Za-z]*", "", line).split(" ")[0] for line in plan.splitlines() if line.strip()]
    return all(n in ("Project", "Filter", "Relation") for n in nodes)


def encoded(docs: DataFrame, path: str, pattern: str, row: Column, text_col: str, with_ids: bool = False) -> DataFrame:
    """row, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids for every row of docs.

    One exchange deals both texts and words; both branches read it. A task that is run again must make the same blocks, so docs that are no
    plain scan are written first."""
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    rows = rows if is_scan(rows) else written(rows, "texts")
    kind = rows.schema["row"].dataType
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = StructType().add("key", "long").add("block", "long").add("rows", ArrayType(kind)).add("sizes", "binary").add("numbers", "binary").add("words", "binary")
    dealt = rows.mapInArrow(trimmed(split_texts(pattern, -(-size // PART_BYTES) or 1)), schema).repartition("key")
    # a condition that rests on where a row is can't be moved below the exchange, which is thus the same for both branches
    there = lambda condition: F.when(F.spark_partition_id() >= 0, condition)
    words = dealt.where(there(F.col("key") >= 0)).groupBy("key").applyInArrow(encode_part(path, pattern), "key long, numbers binary, ids binary, counts binary")
    schema = StructType().add("row", kind).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", ArrayType(IntegerType())) if with_ids else schema
    texts = dealt.where(there(F.col("key") < 0))
    return texts.groupBy("key").cogroup(words.groupBy("key")).applyInArrow(assemble(path, pattern, with_ids), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    return encoded(docs, path, pattern, F.col(id_col).cast("long"), text_col).withColumnRenamed("row", "doc_id")


def tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns `keep` of docs with n_tokens, ids (array) and the digest of the decoded text."""
    out = encoded(docs, path, pattern, F.struct(*keep), text_col, True)
    return out.select("row.*", "n_tokens", "ids", "decoded_sha256")
