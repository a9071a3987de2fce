"""SimHash, line dedup, vectors and components against brute force, with the defined odd cases."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilspark.llm import common, line_dedup, simhash, vectors

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "one two"), (None, "one two"), (6, "é" * 9), (7, "x\n" * 3), (1, None)]


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- components and hot joins


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(50)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_join_equals_a_join(spark):
    rows = [(k, 7 if k % 3 else k) for k in range(3000)]
    left = spark.createDataFrame(rows, "id long, k long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", common.F.col("k") * 2).where("k <> 9")
    got = {(r.id, r.v) for r in common.hot_join(left, right, "k", len(rows), "n").collect()}
    assert got == {(i, None if k == 9 else 2 * k) for i, k in rows}


# ---- SimHash


def plain_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps):
    x = np.array(fps, np.uint64)
    return [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= simhash.LIMIT) if i < j]


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = roots([r.doc_id for r in rows], [(rows[i].doc_id, rows[j].doc_id) for i, j in near(fps)])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(rows, fps)}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(want.values())


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "c") for r in ODD], DOC + ", fp string")).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(1, "0" * 16)] == by[(2, "0" * 16)] == by[(3, "0" * 16)] == 1
    assert {c for (i, _), c in by.items() if i in (4, 5, None)} == {4}
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a b")], DOC)).collect()
    assert alone[0].component_id is None
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def planted_fingerprints(n, rng):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = list(base)
    for b in base[: n // 2]:
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            out.append(b ^ np.uint64(sum(1 << int(f) for f in flips)))
    return np.array(out, np.uint64)


@pytest.mark.parametrize("run", [2048, 3])
def test_every_linked_pair_shares_a_key_and_long_runs_lose_none(monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    fps = planted_fingerprints(300, np.random.default_rng(2))
    one = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.concatenate([fps, [one ^ np.uint64(1 << a | 1 << b) for a in range(12) for b in range(12)]]))
    keys = simhash.chain_keys(fps)
    flat_k, flat_f = keys.ravel(), np.repeat(fps.view(np.int64), keys.shape[1])
    order = np.argsort(flat_k, kind="stable")
    batches = [pa.record_batch([pa.array(flat_k[order][k : k + 5000]), pa.array(flat_f[order][k : k + 5000])], names=["key", "fp"]) for k in range(0, len(order), 5000)]
    found = pa.Table.from_batches(list(simhash.match(iter(batches)))).to_pandas()
    edges = [(r.a, r.b) for r in found[found.kind == 0].itertuples()]
    held = found[found.kind == 1]
    assert (len(held) > 0) == (run == 3)
    for key, group in held.groupby("a"):
        for x in sorted(set(group.c)):
            for y in sorted(set(group.c)):
                if x <= y:
                    part = group[group.c.isin([x, y])]
                    table = pa.table({"fp": part.b.to_numpy(), "block": part.c.to_numpy()})
                    out = simhash.match_blocks((pa.scalar(key), pa.scalar(x), pa.scalar(y)), table)
                    edges += list(zip(out["u"].to_pylist(), out["v"].to_pylist()))
    signed = fps.view(np.int64).tolist()
    assert roots(signed, edges) == roots(signed, [(signed[i], signed[j]) for i, j in near(fps)])


def test_hot_keys_are_dealt_to_blocks(spark, monkeypatch):
    """A third of the fingerprints share two segments; runs and blocks are small, on the driver's side at least."""
    monkeypatch.setattr(simhash, "RUN", 40)
    rng = np.random.default_rng(5)
    one = np.uint64(0x0123456789ABCDEF)
    near_one = [one ^ np.uint64(1 << a | 1 << b) for a in range(30, 60) for b in range(a, 60)]
    fps = np.unique(np.concatenate([planted_fingerprints(200, rng), near_one])).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    hot = simhash.hot_keys(df, len(fps))
    keys = simhash.chain_keys(np.array(fps, np.int64).view(np.uint64)).ravel()
    names, n = np.unique(keys, return_counts=True)
    assert hot == {int(k): -(-int(c) // 40) for k, c in zip(names, n) if c > 40} and hot
    edges = [(r.u, r.v) for r in simhash.links(df).collect()]
    assert roots(fps, edges) == roots(fps, [(fps[i], fps[j]) for i, j in near(np.array(fps, np.int64).view(np.uint64))])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "\n".join(" ".join(f"w{(k * j) % 97}" for k in range(40)) for j in range(60)) + "\tlast"
    whole = plain_fingerprint(text)
    for size in (1, 5, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) == whole == simhash.fingerprint(("  " + text + "\n").upper().encode())
    for few in ("", " ", "One", "a b\nc", "a b c d"):
        assert simhash.fingerprint(few.encode()) == plain_fingerprint(few)


def test_one_of_each_with_clashing_names(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words are here", "z"), (None, "last of all these", "n")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("doc_id", "text", "row", "1 AS id", "2 AS _kept_id", "3 AS fp", "4 AS `a.b`"))
    assert got.columns == ["doc_id", "text", "row", "id", "_kept_id", "fp", "a.b"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a b c d", "x", 1, 2, 3, 4), (3, "other words are here", "z", 1, 2, 3, 4), (None, "last of all these", "n", 1, 2, 3, 4)], key=repr)


def test_one_of_each_goes_by_rows(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "something else is here"), (5, "words of its own again"), (5, "words of its own again"), (5, "and a further one of five"), (9, "and a further one of five")]
    rows += [(None, "the same row all over")] * 300 + [(7, "the same row all over")] * 3 + [(8, None), (8, ""), (None, None)]
    got = sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()), key=repr)
    assert [r for r in got if r[1]] == sorted([(1, "a b c d"), (None, "something else is here"), (5, "words of its own again"), (5, "and a further one of five"), (7, "the same row all over")], key=repr)
    assert [r[0] for r in got if not r[1]] == [8]


# ---- line dedup


def plain_lines(rows):
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(common.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        me = common.NO_ID if i is None else i
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != me)]
        out.append((i, len(lines), len(lines) - len(keep), sha256("\n".join(keep).encode()).hexdigest()))
    return out


LINES = ODD + [(10, "A shared line here\nown\nA shared line here"), (11, " a SHARED line here \nÉ other line\n"), (None, "a shared line here\nlast"), (12, "ééééééééé é\nééééééééé é"), (13, "ÉÉÉÉÉÉÉÉÉ É\nééééééééé é\t"), (10, "a shared line here"), (14, " not stripped line"), (15, "not stripped line")]


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in LINES], DOC + ", n_lines string")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == sorted(plain_lines(LINES), key=repr)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def test_line_dedup_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_lines(rows)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == sorted(want)
    kept = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect()}
    assert kept[rows[0][0]].__fields__ == docs.columns
    assert all(sha256(kept[i].text.encode()).hexdigest() == h and (not n or kept[i].n_chars == len(kept[i].text)) for i, _, n, h in want)


def test_line_dedup_in_several_passes(spark, monkeypatch):
    for name, value in (("LEAST_BITS", 1 << 16), ("MOST_BITS", 1 << 16), ("BITS_A_LINE", 128)):
        monkeypatch.setattr(line_dedup, name, value)
    calls = []
    build = line_dedup.twice_seen
    monkeypatch.setattr(line_dedup, "twice_seen", lambda *a: calls.append(a[2:]) or build(*a))
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(i, t, None, None, 0) for i, t in LINES], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr) == sorted(plain_lines(rows), key=repr)
    assert len(calls) > 1 and calls == [(k, len(calls)) for k in range(len(calls))]


def test_without_repeats_with_odd_rows_and_clashing_names(spark):
    more = [(i, t, 1, "k", b"d", 7, None) for i, t in LINES]
    df = spark.createDataFrame(more, "doc_id long, text string, id long, key string, drops binary, n int, `row` string").withColumn("a.b", common.F.lit(3))
    got = line_dedup.without_repeats(df)
    assert got.columns == df.columns
    rows = got.collect()
    want = {(i, h) for i, _, _, h in plain_lines(LINES)}
    assert len(rows) == len(LINES) and {(r.doc_id, sha256((r.text or "").encode()).hexdigest()) for r in rows} == want
    assert {(r.id, r.key, bytes(r.drops), r.n, r.row, r["a.b"]) for r in rows} == {(1, "k", b"d", 7, None, 3)}
    assert sum(r.text is None for r in rows) == sum(t is None for _, t in LINES)


def test_many_rows_without_an_id(spark):
    rows = [(None, f"a line that is shared\nrow number {k // 2} is here") for k in range(300)] + [(1, "a line that is shared")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_lines(rows), key=repr)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == sorted(plain_lines([(r.doc_id, r.text) for r in docs.collect()]))


def test_filters_have_no_false_negatives():
    bits = 1 << 16
    texts = [[f"line number {k} of many" for k in range(s, s + 400)] for s in (0, 300, 900)]
    parts = []
    for part in texts:
        batch = pa.record_batch([pa.array([1]), pa.array(["\n".join(part)])], names=["id", "text"])
        parts += list(line_dedup.build_filters(bits)(iter([batch])))
    rows = pa.Table.from_batches(parts).sort_by("seg")
    merged = {r["seg"]: line_dedup._flags(r["twice"]) for b in line_dedup.merge_filters(iter(rows.to_batches())) for r in b.to_pylist()}
    digests = [line_dedup.digest(line_dedup.key_of(x.encode())) for x in texts[0][300:]]
    pos = line_dedup.positions(np.frombuffer(b"".join(digests), np.uint8), bits)
    assert all(merged[int(p) // line_dedup.SEGMENT][int(p) % line_dedup.SEGMENT] for p in pos.ravel())


# ---- vectors


def plain_links(rows, limit=vectors.LIMIT):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i + 1, n):
            (a, la), (b, lb) = rows[i][1:], rows[j][1:]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, np.float64), np.array(b, np.float64)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= limit:
                    links.append((i, j))
    return links


VEC = "vec_id long, embedding array<float>, label int"


def check_vectors(spark, rows, recall=1.0):
    got = vectors.near_vectors(spark.createDataFrame(rows, VEC)).collect()
    assert len(got) == len(rows) and len({r.recall for r in got}) <= 1
    links = plain_links(rows)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows)) if links else np.zeros(len(rows))
    assert sum(r.n_links for r in got) >= recall * count.sum() and sum(r.n_links for r in got) <= count.sum()
    if recall == 1.0:
        ids = [common.NO_ID if r[0] is None else r[0] for r in rows]
        at = roots(range(len(rows)), links)
        least = {}
        for k, r in at.items():
            least[r] = min(least.get(r, common.NO_ID), ids[k])
        same = roots(set(least.values()) | set(ids), [])
        want = sorted(((i, int(c), least[at[k]]) for k, (i, c) in enumerate(zip(ids, count))), key=repr)
        have = sorted(((common.NO_ID if r.vec_id is None else r.vec_id, r.n_links, common.NO_ID if r.component_id is None else r.component_id) for r in got), key=repr)
        assert have == want and same
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [2.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e30, 1e29], 1), (None, [0.0, 5.0], 1), (2, [0.0, 1.0], 1)]
    check_vectors(spark, rows)
    assert vectors.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_vectors_planted(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = []
    for b in base:
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows), [float(x) for x in (b + rng.normal(size=16) * 0.12).astype(np.float32)], int(len(rows) % 3 == 0)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(20)]
    check_vectors(spark, rows)


def test_vectors_shards(spark, monkeypatch):
    """Small shards on the driver's side; the functions of tasks read no such setting."""
    monkeypatch.setattr(vectors, "SHARD", 60)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(x) for x in (base[k % 60] + rng.normal(size=16) * 0.1).astype(np.float32)], 1) for k in range(400)]
    check_vectors(spark, rows, recall=0.95)


def as_rows(near):
    return [(k, [float(x) for x in v.astype(np.float32)], 1) for k, v in enumerate(near)]


def test_large_shards_are_split_again(spark, monkeypatch):
    """Levels of pivots, and a group of near copies that no pivot may split, which is compared in blocks."""
    for name, value in (("SHARD", 40), ("SAMPLE", 16), ("REFINE", 90), ("CHUNK", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 24))
    near = [base[k % 120] + rng.normal(size=24) * 0.1 for k in range(500)] + [base[0] + rng.normal(size=24) * 0.03 for _ in range(150)]
    calls = []
    split, blocks = vectors.written, vectors.compare_blocks
    monkeypatch.setattr(vectors, "written", lambda df, name: calls.append(name) or split(df, name))
    monkeypatch.setattr(vectors, "compare_blocks", lambda *a: calls.append("in full") or blocks(*a))
    check_vectors(spark, as_rows(near), recall=0.95)
    assert "finer" in calls and "in full" in calls


def spread_out(rng, center, n, angle):
    """Unit vectors up to this angle from a centre."""
    center = center / np.sqrt(center @ center)
    out = rng.normal(size=(n, len(center)))
    out -= np.outer(out @ center, center)
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    at = rng.uniform(0, angle, (n, 1))
    return np.cos(at) * center + np.sin(at) * out


def test_near_copies_are_folded_without_a_loss(spark, monkeypatch):
    """Two classes at an angle at which some of their members link, single vectors all around, repeated and shared ids."""
    for name, value in (("SHARD", 50), ("FOLD_LEAST", 30), ("REFINE", 60)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(13)
    a = rng.normal(size=12)
    a /= np.sqrt(a @ a)
    b = rng.normal(size=12)
    b -= (b @ a) * a
    b /= np.sqrt(b @ b)
    turned = np.cos(0.45) * a + np.sin(0.45) * b
    near = np.concatenate([spread_out(rng, a, 130, 0.17), spread_out(rng, turned, 110, 0.17), spread_out(rng, a, 60, 0.8), spread_out(rng, turned, 60, 0.6), rng.normal(size=(60, 12))])
    rows = as_rows(near)
    rows += [(1000 + k, rows[k][1], 1) for k in (0, 0, 5, 140, 250, 400)] + [(3, rows[200][1], 1), (None, rows[150][1], 1), (None, [1.0] * 12, 1)]
    calls = []
    fold = vectors.fold
    monkeypatch.setattr(vectors, "fold", lambda *x: calls.append(fold(*x)) or calls[-1])
    # what classes settle is exact; only single vectors are searched by graphs
    monkeypatch.setattr(vectors, "LEAST_RECALL", 1.0)
    check_vectors(spark, rows)
    (settled,) = calls
    assert sum(c.kept.sum() for c in settled.classes.values()) >= 2 and settled.members.count() > 150


def test_folding_is_linear(spark):
    """20,000 near copies in one label: the pairs are 200 million, the rows that move a few for each vector."""
    rng = np.random.default_rng(14)
    near = spread_out(rng, rng.normal(size=16), 20_000, 0.17)
    df = spark.createDataFrame(as_rows(near), VEC)
    calls = []
    search = vectors.search_links
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vectors, "search_links", lambda nodes, own, folded, *rest: calls.append(sum(int(c.mult.sum()) for c in folded.values())) or search(nodes, own, folded, *rest))
        got = vectors.near_vectors(df).collect()
    assert calls and calls[0] > 19_900
    assert {r.n_links for r in got} == {19_999} and {r.component_id for r in got} == {0} and {r.recall for r in got} == {1.0}


def test_audit_takes_all_ids_divisible(spark, monkeypatch):
    rows = planted_pairs()
    df = spark.createDataFrame(rows, VEC).selectExpr("vec_id AS id", "vec_id AS node", "CAST(label AS LONG) AS label", "24 AS dim", "1L AS mult", "vec_id % 20 = 0 AS asked", "embedding AS vec")
    truth = np.bincount(np.array(plain_links(rows)).ravel(), minlength=len(rows))
    links = [(k, int(c)) for k, c in enumerate(truth) if k % 40]
    some = spark.createDataFrame(links, "node long, n_links long")
    asked = [k for k in range(len(rows)) if k % 20 == 0]
    have = [k for k in asked if k % 40]
    want = min(sum(truth[have]) / sum(truth[asked]), np.mean([k in have for k in asked if truth[k]]))
    for most in (1000, 3):
        monkeypatch.setattr(vectors, "ASKED", most)
        assert abs(vectors.audit(df, some, every=20) - want) < 1e-9


def test_recall_is_measured_or_null(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(2 * k + 1, [1.0, k / 1e4], "a") for k in range(300)]
    kind = "vec_id long, embedding array<double>, label string"
    monkeypatch.setattr(vectors, "EVERY", 10)
    got = vectors.near_vectors(spark.createDataFrame(rows, kind)).collect()
    assert {r.recall for r in got} == {1.0} and {r.n_links for r in got} == {299}
    alone = [(k, [float(x) for x in rng.normal(size=40)], "b") for k in range(60)]
    assert {r.recall for r in vectors.near_vectors(spark.createDataFrame(alone, kind)).collect()} == {None}
    # a vector that is asked about under a larger id of its own
    nodes = vectors.nodes_of(spark.createDataFrame([(3, 1, 2, b"k", [1.0, 0.0]), (10, 1, 2, b"k", [1.0, 0.0]), (4, 1, 2, b"m", [0.0, 1.0])], "id long, label long, dim int, key binary, vec array<double>"))
    assert {(r.node, r.asked, r.mult) for r in nodes.collect()} == {(3, True, 2), (4, False, 1)}


def test_long_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(31)
    base = rng.normal(size=20_000)
    rows = [(k, [float(x) for x in (base if k < 4 else rng.normal(size=20_000))], 1) for k in range(8)]
    clash = [f"{k} AS {c}" for k, c in enumerate(["id", "node", "key", "dim", "mult", "vec", "asked", "n", "root", "recall", "n_links", "component_id", "kept"])]
    got = vectors.near_vectors(spark.createDataFrame(rows, VEC).selectExpr("*", *clash))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {k: (3, 0) if k < 4 else (0, k) for k in range(8)}


def test_labels_of_any_type(spark):
    vec = [1.0, 0.5]
    for kind, a, b in (("string", "x", "y"), ("long", 2**40, 2**40 + 2**32), ("double", 0.5, 1.5), ("boolean", True, False)):
        got = vectors.near_vectors(spark.createDataFrame([(1, vec, a), (2, vec, a), (3, vec, b), (4, vec, None), (5, vec, None)], f"vec_id long, embedding array<float>, label {kind}")).collect()
        assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def planted_pairs(n=300, dim=24):
    """Unstructured vectors, each with one other at cosine 0.935 to 0.96."""
    rng = np.random.default_rng(12)
    a = vectors.unit(rng.normal(size=(n, dim)))
    b = rng.normal(size=(n, dim))
    b = vectors.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.935, 0.96, (n, 1))
    return [(k, [float(x) for x in v.astype(np.float32)], 1) for k, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]


def test_the_last_try_is_audited(spark, monkeypatch):
    """A search that loses half of the links on every try: all is compared in full then, in several blocks."""
    for name, value in (("REFINE", 100), ("EVERY", 1)):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "audit", lambda nodes, links, limit, audit=vectors.audit: audit(nodes, links, limit, 1))
    search, calls = vectors.search_links, []
    monkeypatch.setattr(vectors, "search_links", lambda *args: calls.append(args[3]) or search(*args).where("a % 2 = 0"))
    rows = planted_pairs()
    check_vectors(spark, rows + [(1000 + k, rows[0][1], 1) for k in range(5)] + [(None, [1.0, 2.0], 1)])
    assert calls == [2, 3, 4]


def test_homes_reach_shards_that_are_split_again():
    rows = pa.table({"label": pa.array([1] * 9, pa.int64()), "dim": pa.array([2] * 9, pa.int32()), "cluster": range(9), "node": range(9), "mult": [1] * 9, "vec": [[1.0, k / 9] for k in range(9)]})
    pivots = pa.table({"pivot": [0, 4, 7, 8], "pivot_vec": [[1.0, k / 9] for k in (0, 4, 7, 8)]})
    key = [pa.scalar(0)] * 3
    assert [vectors.deal_out(homes)(key, rows, pivots).num_rows for homes in (2, 3, 4)] == [18, 27, 36]


def test_walks_find_what_is_in_range():
    rng = np.random.default_rng(8)
    x = vectors.unit(np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(1, 24)), 60, axis=0) + rng.normal(size=(60, 24)) * 0.05]))
    adj = vectors.build_graph(x, rng)
    small = x.astype(np.float32)
    q, p = vectors.ranged(small, small, adj, np.array([0]), vectors.BEAM, vectors.LIMIT)
    truth = (x @ x.T >= vectors.LIMIT).sum()
    assert (np.einsum("ij,ij->i", x[q], x[p]) >= vectors.LIMIT).sum() >= 0.95 * truth
    assert zlib.crc32(b"") == 0
