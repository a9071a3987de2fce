"""Balanced label propagation over shards (operator 1).

Documents of a group (equal texts) are linked. Large groups (over a LARGE-th of a shard, so at most LARGE for each shard, and over FEWEST members) get their
places first, largest first: the fullest shard that has room for all of it, else as few shards as can hold it. Members of other
groups start in shards by a hash order. Each round names a group's home, the shard with most members, and members
elsewhere ask to move there. Shards exchange rows: requests are let in along cycles of shards, so that a move takes the place of a row that
leaves in the same round, or a free place; whole groups come first, in order of their hash. Rounds end when
under a SETTLED-th of the rows moves, or after ROUNDS. Groups that are still split are then dealt, group after group, to the room that whole groups
leave, which cuts at most one group for each shard but the last; those are packed like large groups. Unlinked documents
have no say: they fill what room is left at the end, which keeps all counts at their quotas.

Law `rows`: shard sizes differ by one row at most. No group meets in one task: a group's row holds at most a
count for each shard, and members of large groups are numbered in buckets.

Defined cases: a null text has 16 bytes, crc32 0 and no links; the empty text links like any other; rows that share a doc_id, or
are equal in all columns, are placed one by one; between shards with as many members of a group a hash decides, which is the same on every
run; a very long text is read once for its size and hashes, and no copy of it moves; a null doc_id is null in the result; extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, from_id, hot_join, small, to_id, written

SHARDS, ROUNDS, LARGE, SETTLED = 40, 6, 16, 100
#: Groups of up to so many members are never large: in small tables, too, labels are propagated.
FEWEST = 8
#: Rows that one window ranks together.
RANKED = 1 << 16


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[str | Column], out: str) -> DataFrame:
    """df with gapless numbers from 0 within `by`. Rows are numbered within buckets, and the buckets' sizes
    are summed up in a small table; bucket numbers must grow with the wanted order only if that order matters."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "offsets")
    at = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return df.withColumn("_at", at).join(small(offsets), [*by, "_b"]).withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_b", "_at", "_before")


def exchanges(want: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the want[s, t] rows may go from s to t at once, so that no shard t takes more than leave it and free[t]."""
    n = len(free)
    # what is left of each way; node n stands for free places, which a row may take and another leave
    left: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for (s, t), c in want.items():
        left[s][t] = c
    for s in range(n):
        left[n][s] = sum(want.values())
        if free[s] > 0:
            left[s][n] = free[s]
    let: dict[tuple[int, int], int] = {}

    def back(s: int, t: int) -> list[int] | None:
        """The shortest way from t to s."""
        came, queue = {t: t}, deque([t])
        while queue:
            at = queue.popleft()
            if at == s:
                way = [s]
                while way[-1] != t:
                    way.append(came[way[-1]])
                return way[::-1]
            for x in left[at]:
                if x not in came:
                    came[x] = at
                    queue.append(x)
        return None

    for s, t in sorted(want):
        while t in left[s] and (way := back(s, t)):
            steps = list(zip([s, *way], way))
            c = min(left[x][y] for x, y in steps)
            for x, y in steps:
                left[x][y] -= c
                if not left[x][y]:
                    del left[x][y]
                if n not in (x, y):
                    let[x, y] = let.get((x, y), 0) + c
    return let


def pack(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(g, lo, hi, shard): which members of each group go where, largest group first; takes them from room. A group is cut
    only if no shard has room for all of it."""
    out = []
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        lo = 0
        while lo < n:
            fits = [s for s, r in enumerate(room) if r >= n - lo]
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            hi = min(n, lo + room[s])
            if hi == lo:
                raise ValueError("more rows than room")
            out.append((g, lo, hi, s))
            room[s] -= hi - lo
            lo = hi
    return out


def seat(members: DataFrame, plan: list[tuple[bytes, int, int, int]]) -> DataFrame:
    """(r, g, shard) for members (r, g) of the groups of a plan of pack()."""
    known = members.sparkSession.createDataFrame([(bytes(g), *x) for g, *x in plan], "_g binary, lo long, hi long, shard int")
    own = members.select("r", "g").join(F.broadcast(known.select("_g").distinct()), F.col("g") == F.col("_g")).drop("_g")
    at = ranked(own, ["g"], F.floor(F.col("r") / RANKED), ["r"], "at")
    return at.join(F.broadcast(known), (F.col("g") == F.col("_g")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("r", "g", "shard")


def _in_turn(rooms: list[int], at: str) -> Column:
    """The shard of the place numbered `at` when shards follow each other with so much room."""
    ends, sum_ = [], 0
    for r in rooms:
        sum_ += r
        ends.append(sum_)
    # the number of shards that end at or before this place
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col(at))).cast("int")


def _counts(df: DataFrame, shards: int) -> list[int]:
    found = dict(df.groupBy("shard").count().collect())  # a row a shard
    return [found.get(s, 0) for s in range(shards)]


def _by_group(n: int) -> tuple[Column, list[Column | str]]:
    """Buckets and order for ranked() that keep a group's members together."""
    return F.pmod(F.xxhash64("g"), F.lit(n // RANKED + 1)), [F.xxhash64("g", F.lit(1)), "g", "r"]


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(r, g, shard) with unique r: shards after propagation. No shard ends with more rows than its quota (if none began so)."""
    spark = linked.sparkSession
    now = linked
    total = now.count()
    bucket, order = _by_group(total)
    for turn in range(rounds if total else 0):
        free = [q - c for q, c in zip(quotas, _counts(now, len(quotas)))]
        held = now.groupBy("g", "shard").agg(F.count("*").alias("c"))
        most = F.max_by("shard", F.struct("c", F.xxhash64("g", "shard", F.lit(turn)))).alias("wanted")
        homes = written(held.groupBy("g").agg(most, F.sum("c").alias("n")), "homes")
        asked = written(hot_join(now, homes, "g", total, "n").select("r", "g", "shard", "wanted"), "asked")
        asks = asked.where("wanted <> shard")
        want = {(s, t): c for s, t, c in asks.groupBy("shard", "wanted").count().collect()}  # a row a pair of shards
        let = [(s, t, c) for (s, t), c in exchanges(want, free).items()]
        if not let:
            drop_written(asked, homes)
            break
        let_in = F.broadcast(spark.createDataFrame(let, "shard int, wanted int, most long"))
        moved = ranked(asks, ["shard", "wanted"], bucket, order, "at").join(let_in, ["shard", "wanted"]).where("at < most")
        moved = written(moved.select("r", F.col("wanted").alias("to")), "moved")
        after = written(asked.join(moved, "r", "left").select("r", "g", F.coalesce("to", "shard").alias("shard")), "placed")
        drop_written(asked, homes, now, moved)
        now = after
        if SETTLED * sum(c for *_, c in let) < total:
            break
    return now.select("r", "g", "shard")


def settle(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """linked (r, g, shard) with the groups that are split put together; fewer groups than shards stay split, and only those that no shard has
    room for."""
    shards = len(quotas)
    groups = linked.groupBy("g").agg(F.count("*").alias("n"), (F.min("shard") != F.max("shard")).alias("cut"))
    total = linked.count()
    marked = written(hot_join(linked, groups, "g", total, "n"), "cut")
    whole, open_ = marked.where("NOT cut").select("r", "g", "shard"), marked.where("cut").select("r", "g")
    n = open_.count()
    if not n:
        return whole
    room = [q - c for q, c in zip(quotas, _counts(whole, shards))]
    dealt = written(ranked(open_, [], *_by_group(n), "at").select("r", "g", _in_turn(room, "at").alias("shard")), "dealt")
    cut = dealt.groupBy("g").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("g", "n").collect()  # under a row a shard
    if not cut:
        return whole.union(dealt)
    names = dealt.sparkSession.createDataFrame([(bytes(r.g),) for r in cut], "g binary")
    kept = dealt.join(F.broadcast(names), "g", "left_anti").select("r", "g", "shard")
    room = [q - c for q, c in zip(room, _counts(kept, shards))]
    return whole.union(kept).union(seat(dealt, pack([(bytes(r.g), r.n) for r in cut], room)))


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.col(text_col)
    rows = docs.select(
        to_id(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"),
    )
    rows = written(rows, "rows")
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = F.pmod(F.xxhash64("id"), F.lit(n // RANKED + 1))
    rows = written(ranked(rows, [], buckets, [F.xxhash64("id", F.lit(1)), "id", "g", "size"], "r"), "ranked")
    groups = rows.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    least = max(FEWEST, n // shards // LARGE)
    groups = written(groups.select("g", "n", F.lit(True).alias("many"), (F.col("n") > least).alias("large")), "groups")
    marked = written(hot_join(rows, groups, "g", n, "n"), "marked")
    large = groups.where("large").select("g", "n").collect()  # about LARGE * shards rows at most
    room = list(quotas)
    linked = seat(marked.where("large"), pack([(bytes(g), c) for g, c in large], room)) if large else None
    small_ones = marked.where("many AND NOT large").select("r", "g")
    m, all_room = small_ones.count(), sum(room)
    if m:
        ends = [sum(room[: s + 1]) * m // all_room for s in range(shards)]
        shares = [b - a for a, b in zip([0, *ends], ends)]
        start = ranked(small_ones, [], F.floor(F.col("r") / RANKED), ["r"], "at").select("r", "g", _in_turn(shares, "at").alias("shard"))
        other = settle(propagate(written(start, "start"), room), room)
        linked = other if linked is None else linked.union(other)
    free = ranked(marked.where("many IS NULL"), [], F.floor(F.col("r") / RANKED), ["r"], "free")
    if linked is None:
        left = quotas
    else:
        linked = written(linked, "linked")
        left = [q - c for q, c in zip(quotas, _counts(linked, shards))]
    placed = free.select("r", "id", "size", "crc", _in_turn(left, "free").alias("shard"))
    if linked is not None:
        placed = placed.union(marked.where("many").join(linked.select("r", "shard"), "r").select("r", "id", "size", "crc", "shard"))
    placed = written(placed, "placed")
    out = ranked(placed, ["shard"], F.floor(F.col("r") / (RANKED * shards)), ["r"], "slot")
    return out.select(from_id("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
