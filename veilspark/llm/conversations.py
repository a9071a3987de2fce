"""Conversation structure repair by weighted finite-state composition (operator 13).

Three machines are composed lazily. The input acceptor reads the rows of a conversation in order. The edit transducer keeps a row, deletes
it, gives it another role or inserts a row, each with a cost and a label; blank and duplicate rows it can only delete. The grammar
acceptor takes the initials of the roles that result: (s?(ua)+)?. Weights are pairs (cost, labels) that are added part by part and
compared in order, so the shortest path is the cheapest repair, and among those the ASCII-least. Insertions between two rows never pay
beyond two (a third would come back to a state of the grammar at a higher cost), so the transducer counts them, the composition
has no cycle, and states can be settled in topological order, a row after another.

A row's arcs depend only on its fault and its initial, so there are few kinds of rows, and what a row does is a small table from state to state.
Such tables compose: a piece of a conversation is a table as well. Two paths of one cost between the same states are never prefixes of one
another (the longer one would hold a further, paid insertion), so minima of pieces can be taken before pieces are joined.

Rows are dealt by ranges of (conversation, turn, role, text, place), so that a conversation with any share of the rows spreads over tasks.
Conversations within a task are repaired there. Those that cross a task's edges, or have over PIECE rows or PIECE_BYTES bytes, are
written as pieces: their texts' digests find duplicates in earlier pieces, their tables are composed FAN at a time until each conversation has
one, and the edits found are replayed over its pieces in order. Only that replay is a stream in one task, as a digest of the whole
text must be; it holds a piece at a time.

Defined cases: a null role or text is one space, and so is a null in the damage's key; a null conv_id is a conversation like any other; rows
of a turn go by the first KEY characters of role and text, then by a hash of both, and equal rows stand together; roles count by their
first character as it is, so an empty or unknown role must be changed or its row deleted; a conversation whose rows are all dropped has
zeros, no edits and the digest of nothing; a difference of turns beyond 64 bits is held at the largest long; a very long text is held by one task;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b, sha256
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, drop_written, from_id, to_id, trimmed, written

#: Rows and bytes of a piece, and tables of pieces that are composed at once.
PIECE, PIECE_BYTES, FAN = 1024, 4 << 20, 32
#: Results that a task holds before it hands them on; characters of role and text that deal rows of a turn.
RESULTS, KEY = 1000, 32

# What each edit costs, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
MOST_INSERTED = 2

#: The grammar acceptor: from state and initial to state. START and PAIR (after an assistant) accept.
START, SYSTEM, USER, PAIR = range(4)
GRAMMAR = {(START, b"s"): SYSTEM, (START, b"u"): USER, (SYSTEM, b"u"): USER, (USER, b"a"): PAIR, (PAIR, b"u"): USER}
FINAL = (START, PAIR)
LEGAL = (b"su", b"ua", b"au")
NAMES = {b"u": b"user", b"a": b"assistant"}
#: Stands for all initials that the grammar doesn't know.
OTHER = b"?"

#: (cost, labels)
Weight = tuple[int, str]
#: Weights from state to state.
Table = dict[tuple[int, int], Weight]
ONE: Table = {(s, s): (0, "") for s in range(4)}

BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"


# ---- machines


def edits(fault: str | None, initial: bytes) -> Iterator[tuple[str, int, bytes | None]]:
    """Arcs of the edit transducer that read one row: label, cost, and the initial that goes on to the grammar (None: none)."""
    yield "D", DELETE, None
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        yield "K", KEEP + more, initial
        for name in NAMES:
            yield "R", REROLE + more, name


def better(table: Table, arc: tuple[int, int], weight: Weight) -> None:
    if arc not in table or weight < table[arc]:
        table[arc] = weight


def inserted(table: Table) -> Table:
    """table, followed by up to MOST_INSERTED insertions; states are (insertions so far, grammar state), settled in that order."""
    out, layer = dict(table), table
    for _ in range(MOST_INSERTED):
        after: Table = {}
        for (i, j), (cost, labels) in layer.items():
            for name in NAMES:
                if (to := GRAMMAR.get((j, name))) is not None:
                    better(after, (i, to), (cost + INSERT, labels + "I"))
        for arc, weight in after.items():
            better(out, arc, weight)
        layer = after
    return out


@lru_cache(maxsize=64)
def row_table(fault: str | None, initial: bytes) -> Table:
    """What one row and the insertions behind it do."""
    out: Table = {}
    for i in range(4):
        for label, cost, name in edits(fault, initial):
            to = i if name is None else GRAMMAR.get((i, name))
            if to is not None:
                better(out, (i, to), (cost, label))
    return inserted(out)


def composed(a: Table, b: Table) -> Table:
    out: Table = {}
    for (i, j), (cost, labels) in a.items():
        for k in range(4):
            if (more := b.get((j, k))) is not None:
                better(out, (i, k), (cost + more[0], labels + more[1]))
    return out


def first_table() -> Table:
    """Insertions in front of all rows."""
    return inserted({(START, START): (0, "")})


def shortest(table: Table) -> Weight:
    return min(table[START, j] for j in FINAL if (START, j) in table)


# ---- pieces


class Row(NamedTuple):
    turn: int | None
    role: bytes
    text: bytes


class Mark(NamedTuple):
    """What a row's edits depend on; the fault is known but for repetition, and initials without an arc are all alike."""

    turn: int | None
    initial: bytes
    fault: str | None
    digest: bytes


class Summary(NamedTuple):
    """A piece of a conversation. Turns are null or ascending, nulls first."""

    n: int
    least: int | None
    most: int | None
    turns: int
    first: bytes
    last: bytes
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    table: Table

    def then(self, other: Summary) -> Summary:
        if not (self.n and other.n):
            return self if self.n else other
        same = self.most is not None and self.most == other.least
        blank, duplicate, truncated, illegal = (a + b for a, b in zip(self[6:10], other[6:10]))
        return Summary(
            self.n + other.n, other.least if self.least is None else self.least, self.most if other.most is None else other.most, self.turns + other.turns - same,
            self.first, other.last, blank, duplicate, truncated, illegal + (self.last + other.first not in LEGAL), composed(self.table, other.table),
        )


NOTHING = Summary(0, None, None, 0, b"", b"", 0, 0, 0, 0, ONE)


def mark(row: Row) -> Mark:
    bare = row.text.rstrip(SPACE)
    fault = BLANK if not bare else CUT if bare[-1:] not in (b".", b"!", b"?") else None
    initial = row.role[:1]
    digest = blake2b(len(row.role).to_bytes(8, "little") + row.role + row.text, digest_size=16).digest()
    return Mark(row.turn, initial if initial in (b"s", b"u", b"a") else OTHER, fault, digest)


def summary(marks: list[Mark], earlier: set[bytes], table: Table = ONE) -> Summary:
    """Of rows in order; earlier: digests of rows before them; table: what goes before them."""
    if not marks:
        return NOTHING
    seen, counts, illegal, turns = set(earlier), {BLANK: 0, DUPLICATE: 0, CUT: 0}, 0, 0
    last, before = b"", None
    for turn, initial, fault, digest in marks:
        if fault != BLANK and digest in seen:
            fault = DUPLICATE
        seen.add(digest)
        if fault:
            counts[fault] += 1
        illegal += bool(last) and last + initial not in LEGAL
        turns += turn is not None and turn != before
        last, before = initial, turn
        table = composed(table, row_table(fault, initial))
    known = [m.turn for m in marks if m.turn is not None]
    return Summary(len(marks), known[0] if known else None, known[-1] if known else None, turns, marks[0].initial, last, *counts.values(), illegal, table)


class Replay:
    """Edits applied to rows as they come, and the digest of what they make."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.made, self.hash = audit, 0, START, 0, sha256()

    def _put(self, role: bytes | None, text: bytes) -> None:
        if role is None:
            role = NAMES[b"a" if self.state == USER else b"u"]
        self.state = GRAMMAR[self.state, role[:1]]
        self.hash.update(b"\n" * (self.made > 0) + role + b":")
        self.hash.update(text)
        self.made += 1

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(None, b"")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self._insertions()
        label = self.audit[self.at]
        self.at += 1
        if label != "D":
            self._put(role if label == "K" else None, text)

    def ended(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def figures(s: Summary, table: Table) -> tuple:
    """The counts, cost and edits of a whole conversation; table: all that its rows do, from START."""
    cost, audit = shortest(table)
    gaps = 0 if s.least is None else min(s.most - s.least + 1 - s.turns, 2**63 - 1)
    return gaps, s.blank, s.duplicate, s.truncated, s.illegal, cost, audit


def repaired(rows: list[Row]) -> tuple:
    """The result of a conversation that is at hand."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", sha256().hexdigest()
    s = summary([mark(r) for r in rows], set(), first_table())
    found = figures(s, s.table)
    replay = Replay(found[-1])
    for r in rows:
        replay.row(r.role, r.text)
    return *found, replay.ended()


# ---- tasks

ARCS = "array<struct<i:long,j:long,cost:long,labels:string>>"
# Columns and their types by name.
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
FIGURES = {"conv": "long"} | dict.fromkeys(COUNTS, "long") | {"audit": "string"}
RESULT = FIGURES | {"repaired_sha256": "string"}
MARKS = {"turns": "array<long>", "initials": "binary", "faults": "array<string>", "digests": "array<binary>"}
PASSED = RESULT | {"task": "long", "seq": "long"} | MARKS | {"roles": "array<binary>", "texts": "array<binary>"}
SUMMARIES = dict.fromkeys(["conv", "idx", "n", "least", "most", "turns"], "long") | {"first": "binary", "last": "binary"} | dict.fromkeys(["blank", "duplicate", "truncated", "illegal"], "long") | {"arcs": ARCS}

ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
ARROW[ARCS] = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("cost", pa.int64()), ("labels", pa.string())]))


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def emitted(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = [ARROW[kind] for kind in columns.values()]
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=list(columns))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, copies (0 to 2) of every row; those with none stay, as their conversation does."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    rows = conversations.select(to_id(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows dealt by ranges and sorted. The last key tells equal rows apart, so that they needn't stay together."""
    start = lambda c: F.substring(c, 1, KEY)
    keyed = rows.withColumn("place", F.monotonically_increasing_id())
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), start("role"), start("text"), F.xxhash64("role", "text"), F.col("place")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.select("conv", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "copies")


def cut(rows: Iterator[tuple], most: int) -> Iterator[list[Row]]:
    """The rows of a conversation, as often as they are there after the damage, in pieces; one at least, which may be empty."""
    now, size = [], 0
    for _, turn, role, text, copies in rows:
        for _ in range(copies):
            if now and (len(now) >= most or size + len(role) + len(text) > PIECE_BYTES):
                yield now
                now, size = [], 0
            now.append(Row(turn, role, text))
            size += len(role) + len(text)
    yield now


def first_pass(most: int):
    """Sorted rows to results of the conversations that lie within the task and a piece of up to `most` rows, and to pieces of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        results: list[tuple] = []

        def pieces(conv: int, parts: Iterable[list[Row]]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for rows in parts:
                marks = [mark(r) for r in rows]
                found = [m.turn for m in marks], b"".join(m.initial for m in marks), [m.fault for m in marks], [m.digest for m in marks], [r.role for r in rows], [r.text for r in rows]
                yield emitted([(conv, *[None] * 8, task, seq, *found)], PASSED)
                seq += 1

        held: tuple[int, list[Row]] | None = None
        for conv, rows in groupby(streamed(batches), key=itemgetter(0)):
            if held:
                results.append((held[0], *repaired(held[1]), *[None] * 8))
            # the first of the task may have begun in the task before
            parts, begins = cut(rows, most), held is None and not results and not seq
            first, more = next(parts), next(parts, None)
            if begins or more is not None:
                yield from pieces(conv, chain([first], [] if more is None else [more], parts))
                held = None
            else:
                held = conv, first
            if len(results) >= RESULTS:
                yield emitted(results, PASSED)
                results = []
        if held:
            yield from pieces(held[0], [held[1]])  # may go on in the task after
        if results:
            yield emitted(results, PASSED)

    return run


def arcs_of(table: Table) -> list[dict]:
    return [{"i": i, "j": j, "cost": cost, "labels": labels} for (i, j), (cost, labels) in table.items()]


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, idx, marks, earlier) to summaries."""
    for conv, idx, turns, initials, faults, digests, earlier in streamed(batches):
        marks = [Mark(turn, initials[k : k + 1], fault, digest) for k, (turn, fault, digest) in enumerate(zip(turns, faults, digests))]
        s = summary(marks, set(earlier or ()))
        yield emitted([(conv, idx, *s[:-1], arcs_of(s.table))], SUMMARIES)


def read_summary(r: dict) -> Summary:
    return Summary(*[r[f] for f in Summary._fields[:-1]], {(a["i"], a["j"]): (a["cost"], a["labels"]) for a in r["arcs"]})


def joined(key: tuple, rows: pa.Table) -> pa.Table:
    """Up to FAN summaries that follow one another to one."""
    out = reduce(Summary.then, map(read_summary, rows.sort_by("idx").to_pylist()))
    return pa.Table.from_batches([emitted([(key[0].as_py(), key[1].as_py(), *out[:-1], arcs_of(out.table))], SUMMARIES)])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of whole conversations to their figures."""
    for batch in batches:
        for r in batch.to_pylist():
            s = read_summary(r)
            found = figures(s, composed(first_table(), s.table)) if s.n else (0,) * 6 + ("",)
            yield emitted([(r["conv"], *found)], FIGURES)


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of conversations, each followed by its pieces in order, to results."""
    now: tuple | None = None
    replay = Replay("")
    for conv, *found, roles, texts in streamed(batches):
        if roles is None:
            if now:
                yield emitted([(*now, replay.ended())], RESULT)
            now, replay = (conv, *found), Replay(found[-1])
        else:
            for role, text in zip(roles, texts):
                replay.row(role, text)
    if now:
        yield emitted([(*now, replay.ended())], RESULT)


# ---- operator


def found_earlier(numbered: DataFrame) -> DataFrame:
    """task, seq, earlier: which digests of a piece an earlier piece of its conversation has."""
    # a piece holds a digest once here, so what meets under one is a row a piece
    each = numbered.where("pieces > 1").select("conv", "idx", "task", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    first = F.min("idx").over(Window.partitionBy("conv", "digest"))
    return each.withColumn("_first", first).where("idx > _first").groupBy("task", "seq").agg(F.collect_list("digest").alias("earlier"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    rows = in_order(damaged(conversations, conv_col, turn_col, role_col, text_col))
    passed = written(rows.mapInArrow(trimmed(first_pass(PIECE)), ddl(PASSED)), "conversations")
    pieces = passed.where("task IS NOT NULL")
    # pieces are numbered without what they hold
    by_conv = Window.partitionBy("conv")
    order = pieces.select("conv", "task", "seq").withColumn("idx", (F.row_number().over(by_conv.orderBy("task", "seq")) - 1).cast("long")).withColumn("pieces", F.count("*").over(by_conv))
    marks = list(MARKS)
    numbered = written(pieces.select("task", "seq", *marks).join(order, ["task", "seq"]), "pieces")
    parts = numbered.join(found_earlier(numbered), ["task", "seq"], "left").select("conv", "idx", *marks, "earlier")
    whole = written(parts.mapInArrow(trimmed(summaries), ddl(SUMMARIES)), "summaries")
    most = numbered.agg(F.max("pieces")).first()[0] or 0
    while most > 1:
        fewer = written(whole.groupBy("conv", F.floor(F.col("idx") / FAN).alias("part")).applyInArrow(joined, ddl(SUMMARIES)), "summaries")
        drop_written(whole)
        whole, most = fewer, -(-most // FAN)
    names, kind = [*COUNTS, "audit"], "array<binary>"
    heads = whole.mapInArrow(trimmed(judged), ddl(FIGURES)).select("*", F.lit(-1).cast("long").alias("task"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast(kind).alias("roles"), F.lit(None).cast(kind).alias("texts"))
    both = heads.unionByName(pieces.select("conv", "task", "seq", "roles", "texts"), allowMissingColumns=True)
    stream = both.repartition("conv").sortWithinPartitions("conv", "task", "seq").select("conv", *names, "roles", "texts")
    out = passed.where("task IS NULL").select("conv", *names, "repaired_sha256").unionByName(stream.mapInArrow(trimmed(replayed), ddl(RESULT)))
    return out.select(from_id("conv").alias("conv_id"), *names, "repaired_sha256")
