"""Vector codes, exact top-k and conversation repair against brute force, with the defined odd cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import codes, conversations, integers, topk

SF = "/root/testdata/sf0.001"
CLASH = ["1 AS id", "2 AS label_", "3 AS code", "4 AS error", "5 AS vec", "6 AS length", "7 AS ids", "8 AS y", "9 AS q", "10 AS score", "11 AS total", "12 AS n"]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whole(v, factor):
    most = 2**30 // max(1, len(v))
    return [int(max(-most, min(most, np.floor(factor * x)))) for x in v]


# ---- codes


def plain_codes(rows):
    """(vec_id, code, error, label_error, codebooks digest) by comparing every part with every entry."""
    big = 2**63
    kept = sorted(((big if i is None else i), tuple(v), label, whole(v, 1024.0)) for i, v, label in [(r[0], r[1], r[2]) for r in rows] if usable(v))
    out = []
    for d in {len(v) for _, v, _, _ in kept}:
        own = [k for k in kept if len(k[1]) == d]
        w = -(-d // 4)
        x = np.array([k[3] + [0] * (4 * w - d) for k in own], np.int64).reshape(len(own), 4, w)
        books = x[:256].transpose(1, 0, 2).copy()

        def nearest(p):
            dist = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
            return dist.argmin(axis=1), dist.min(axis=1)

        for _ in range(4):
            found = [nearest(p)[0] for p in range(4)]
            for p in range(4):
                for e in set(found[p].tolist()):
                    mine = x[found[p] == e, p]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
        last = [nearest(p) for p in range(4)]
        digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
        for k, (i, _, label, _) in enumerate(own):
            out.append([None if i == big else i, "".join(f"{last[p][0][k]:02x}" for p in range(4)), sum(int(last[p][1][k]) for p in range(4)), label, digest])
    total = defaultdict(int)
    for _, _, error, label, _ in out:
        total[label] += error
    return sorted([(i, code, error, total[label], digest) for i, code, error, label, digest in out], key=repr)


def got_codes(df):
    return sorted(map(tuple, codes.compress(df).collect()), key=repr)


VEC = "vec_id long, embedding array<double>, label string"


def test_codes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = got_codes(df.repartition(5).selectExpr("*", *[c for c in CLASH if "label_" not in c]))
    assert got == plain_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert codes.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def odd_vectors(rng):
    rows = [(None, [0.5, 0.25], "a"), (None, None, "a"), (1, [1.0, None], "a"), (2, [float("nan"), 1.0], None), (3, [float("inf"), 1.0], "b"), (4, [], "a"), (5, [], None)]
    rows += [(10 + k, [float(rng.integers(-3, 4)) / 7 for _ in range(6)], "abc"[k % 3] if k % 4 else None) for k in range(400)]
    rows += [(7, [0.0] * 6, "z")] * 3 + [(7, [1e30, -1e30, 1e-30, 0.0, 1.0, -1.0], "z"), (8, [0.1] * 5, "five"), (50, [0.1] * 6, "a"), (100, [-0.0] * 6, "a")]
    return rows


def test_codes_of_odd_vectors(spark, monkeypatch):
    rows = odd_vectors(np.random.default_rng(3))
    for held, few in ((codes.HELD, codes.FEW_ROWS), (1, 2)):
        monkeypatch.setattr(codes, "HELD", held)
        monkeypatch.setattr(codes, "FEW_ROWS", few)
        assert got_codes(spark.createDataFrame(rows, VEC).repartition(3)) == plain_codes(rows)
    assert codes.compress(spark.createDataFrame([], VEC)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, "a")], VEC)).count() == 0


@pytest.mark.parametrize("kind", ["int", "double", "boolean", "array<int>"])
def test_labels_of_any_type(spark, kind):
    values = {"int": (1, 2), "double": (0.5, 1.5), "boolean": (True, False), "array<int>": ([1], [1, 2])}[kind]
    rows = [(k, [k / 7, (k * k % 5) / 3], values[k % 2] if k % 3 else None) for k in range(30)]
    got = got_codes(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}"))
    assert len({r[3] for r in got}) <= 3 and len(got) == 30


def test_bounds_lose_no_nearest_entry():
    rng = np.random.default_rng(5)
    for width, n, spread in [(16, 256, 300), (16, 256, 2), (1, 5, 9), (3, 7, 2), (2, 9, 3), (40, 30, 1000), (1000, 20, 10**6 // 100)]:
        entries = rng.integers(-spread, spread + 1, (n, width))
        rows = np.concatenate([rng.integers(-spread, spread + 1, (300, width)), entries[:3], (entries[:4] + entries[1:5]) // 2])
        index, dist = codes.Entries(entries).nearest(rows)
        every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
        for block, sums, rest, _ in codes.Entries(entries).levels:
            own, left = codes.summary(rows, block)
            bound = ((own[:, None] - sums[None]) ** 2).sum(axis=2) / block + (left[:, None] - rest[None]) ** 2
            assert (bound <= every * (1 + 1e-9) + 1e-6).all()


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=20_000)], "a") for k in range(12)] + [(99, [1e300] * 20_000, "a")]
    df = spark.createDataFrame(rows, VEC)
    assert got_codes(df) == plain_codes(rows)
    assert got_topk(df) == plain_topk(rows)


# ---- top-k


def plain_topk(rows, k=5, every=50):
    last = 2**63 - 1
    v = [(last if r[0] is None else r[0], whole(r[1], 256.0)) for r in rows if usable(r[1])]
    out = []
    for i, q in {(i, tuple(x)) for i, x in v if i != last and i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in v if j != i and len(x) == len(q))
        out += [(i, rank, None if j == last else j, -score) for rank, (score, j) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def got_topk(df):
    return sorted(map(tuple, topk.top_scores(df).collect()), key=repr)


def test_topk_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got_topk(df.repartition(5).selectExpr("*", *[c for c in CLASH if "label_" not in c])) == plain_topk([(r.vec_id, r.embedding) for r in df.collect()])


def test_topk_in_many_blocks_and_waves(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=12)], "") for k in range(900)] + [(k * 50, [1.0] * 12, "") for k in range(40, 60)]
    rows += [(5000 + k, [1.0] * 12, "") for k in range(100)]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    for name, value in (("QUERIES", 4), ("CANDIDATES", 16), ("HELD", 500)):
        monkeypatch.setattr(topk, name, value)
    blocks = []
    monkeypatch.setattr(topk, "waves", lambda b, own=topk.waves: blocks.append(own(b)) or own(b))
    assert got_topk(df) == plain_topk(rows)
    assert len(blocks[0]) > 3


def test_topk_of_odd_vectors(spark):
    rows = odd_vectors(np.random.default_rng(4)) + [(0, [1.0, 2.0], ""), (0, [1.0, 2.0], ""), (0, [3.0, 2.0], ""), (150, [], "")]
    assert got_topk(spark.createDataFrame(rows, VEC)) == plain_topk(rows)
    assert topk.top_scores(spark.createDataFrame([], VEC)).count() == 0
    assert topk.top_scores(spark.createDataFrame([(1, [1.0], "a"), (50, None, "a")], VEC)).count() == 0
    assert got_topk(spark.createDataFrame([(0, [1.0], "a")], VEC)) == []


def test_cutoffs_hold_back_no_answer():
    """Phases 2 and 3 keep whatever reaches the cutoff, also where scores are negative or nothing is collected in most lists."""
    rng = np.random.default_rng(9)
    for shift in (-40, 0, 40):
        q, v = rng.integers(-9, 10, (30, 10)), rng.integers(-9, 10, (200, 10)) + shift
        lists = topk.partial_scores(q, v)
        total = q @ v.T
        assert (lists.sum(axis=0) == total).all()
        cut = np.sort(total, axis=1)[:, -5][:, None]
        share = -(-cut // len(lists))
        collected = lists >= share
        remains = collected.any(axis=0) & (np.where(collected, lists, share).sum(axis=0) >= cut)
        assert (remains >= (total >= cut)).all()


def test_scores_beyond_double_precision():
    big = integers.most(64)
    a, b = np.full((1, 64), big), np.full((1, 64), big - 1)
    assert int(topk.partial_scores(a, b).sum()) == 64 * big * (big - 1)


# ---- conversations

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by trying every edit from the last row backwards, with whole strings."""
    after = None
    for p in range(len(rows), -1, -1):
        now = {}
        for state in range(4):
            ways = [(0, "", ())] if p == len(rows) and state in (0, 3) else []
            if p < len(rows):
                role, text = rows[p][1:]
                arcs = [(3, "D", state, ())]
                if faults[p] not in ("blank", "duplicate"):
                    more = int(faults[p] == "truncated")
                    arcs += [(more, "K", STEP.get((state, role[:1])), ((role, text),))]
                    arcs += [(2 + more, "R", STEP.get((state, r[0])), ((r, text),)) for r in ("user", "assistant")]
                ways += [(c + after[to][0], label + after[to][1], item + after[to][2]) for c, label, to, item in arcs if to is not None and after[to]]
            now[state] = min(ways, key=lambda w: w[:2], default=None)
        for _ in range(6):
            for state in range(4):
                for r in ("user", "assistant"):
                    to = STEP.get((state, r[0]))
                    if to is not None and now[to]:
                        way = (now[to][0] + 2, "I" + now[to][1], ((r, ""), *now[to][2]))
                        if now[state] is None or way[:2] < now[state][:2]:
                            now[state] = way
        after = now
    return after[0]


def plain_repair(rows):
    shown = lambda x: " " if x is None else str(x)
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv]
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else shown(role), "" if kind == 1 else shown(text)
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        found[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in own if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string"


def got_repair(df):
    return sorted(map(tuple, conversations.repair(df).collect()), key=repr)


def random_rows(rng, n, convs):
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None, "su", "u", "ärger"], [None, "", " \t", "Hi.", "Hi!", "hello", "a\n.", "x? ", "é!", "."]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    extra = [f"{k} AS {c}" for k, c in enumerate(["conv", "copies", "place", "task", "seq", "idx", "audit", "cost", "kind"])]
    got = conversations.repair(df.repartition(3).selectExpr("*", *extra))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_repair([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("piece,fan", [(1024, 32), (3, 2)])
def test_repair_of_odd_rows(spark, monkeypatch, piece, fan):
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "FAN", fan)
    rng = random.Random(11)
    rows = random_rows(rng, 1500, 200) + random_rows(rng, 300, 3)
    assert got_repair(spark.createDataFrame(rows, CONV).repartition(4)) == plain_repair(rows)
    assert conversations.repair(spark.createDataFrame([], CONV)).count() == 0


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of many pieces beside short ones, with rows that repeat far apart and rows that are all alike."""
    monkeypatch.setattr(conversations, "PIECE", 50)
    monkeypatch.setattr(conversations, "FAN", 3)
    rng = random.Random(12)
    rows = [(7, k // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", f"{k}.", f"{k % 90}?"])) for k in range(2500)]
    rows += [(8, 1, "user", "same.")] * 700 + [(k, t, r, f"{k} {t}.") for k in range(100, 160) for t, r in enumerate(["system", "user", "assistant"])]
    assert got_repair(spark.createDataFrame(rows, CONV).repartition(4)) == plain_repair(rows)


def test_no_rows_after_damage_and_extreme_turns(spark):
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*dropped, "user", "x."), (99, -(2**63), "user", "a."), (99, 2**63 - 1, "assistant", "b.")]
    got = {r[0]: r[1:] for r in got_repair(spark.createDataFrame(rows, CONV))}
    assert got[dropped[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[99][0] == 2**63 - 1


def test_long_texts(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}" + "long text " * 900_000 + ".") for k in range(4)] + [(1, 9, "user", "x" * 20_000_000)]
    assert got_repair(spark.createDataFrame(rows, CONV)) == plain_repair(rows)


def test_tables_compose(monkeypatch):
    """Composing pieces in any grouping gives what a row at a time gives."""
    rng = random.Random(13)
    for _ in range(200):
        rows = [conversations.row_table(rng.choice([None, "blank", "duplicate", "truncated"]), rng.choice([b"s", b"u", b"a", b"?"])) for _ in range(rng.randint(1, 12))]
        one = conversations.ONE
        for r in rows:
            one = conversations.composed(one, r)
        while len(rows) > 1:
            k = rng.randrange(len(rows) - 1)
            rows[k : k + 2] = [conversations.composed(rows[k], rows[k + 1])]
        assert rows[0] == one
