"""BPE, classifier, JPEG, licenses, sharding, mixing, WARC and the pipeline."""

import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import byte_bpe, common, jpeg, licenses, mixing, quality, registry, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (4, "one two"), (None, "one two"), (6, "é" * 9), (7, "x\n" * 3), (1, None), (8, "ab" * 5000)]
PATH = registry.VOCABULARY


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


#: Names that operators use for columns of their own.
CLASHES = ["id", "row", "rows", "key", "g", "r", "n", "shard", "slot", "size", "hash", "copies", "words", "numbers", "block", "fp", "node", "digest", "drops", "label", "score", "media", "_n", "a.b"]


def written_tables(spark, path, rows, labels=()):
    """documents with extra columns whose names clash, and labels."""
    df = spark.createDataFrame([(i, t, "en", None if i == 7 else f"s{(i or 0) % 2}", 1) for i, t in rows], DOC + ", lang string, source string, n_chars long")
    df.selectExpr("*", *[f"'clash {c}' AS `{c}`" for c in CLASHES]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_rows(name, rows, model=None, library=None):
    """What a query's columns that depend on the row alone are, from each row's text."""
    for i, text in rows:
        raw, words = (text or "").encode(), re.findall("[^\x20\x09-\x0d]+", text or "")
        padded = jpeg.padded(raw)
        if name == "op1_sharding":
            yield i, len(raw) + 16, zlib.crc32(raw), "rows"
        elif name == "op2_mixing":
            yield i, len(words)
        elif name == "op4_licenses":
            found, hits = plain_scan(text)
            yield i, len(found), len(hits), min((s for s, _ in hits), default=None), max((s for s, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))
        elif name == "op5_jpeg":
            yield i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])
        elif name == "op6_line_dedup":
            yield i, (text or "").count("\n") + 1
        elif name == "op7_quality_cnn":
            yield i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(float(quality.scores([raw], model)[0]), 5) if model else 0.5
        elif name == "op8_byte_bpe":
            ids = library.encode_ordinary(text or "")
            yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()
        elif name == "op9_simhash_pigeonring":
            yield i, f"{simhash.fingerprint(raw):016x}"


COLUMNS = {
    "op1_sharding": ["doc_id", "size", "text_crc32", "law"],
    "op2_mixing": ["doc_id", "size"],
    "op4_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"],
    "op5_jpeg": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"],
    "op6_line_dedup": ["doc_id", "n_lines"],
    "op7_quality_cnn": ["doc_id", "held_out", "score"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_simhash_pigeonring": ["doc_id", "fingerprint"],
}


def check_rows(spark, path, name, rows, model=None, library=None):
    got = registry.QUERIES[name](spark, path).select(COLUMNS[name]).collect()
    plain = lambda x: repr(tuple(round(v, 5) if isinstance(v, float) else v for v in x))
    assert sorted(map(plain, got)) == sorted(map(plain, plain_rows(name, rows, model, library))), name


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_odd_rows_and_empty_tables(spark, tmp_path, library, name):
    """Values for null, empty, repeated and clashing rows, and nothing for nothing."""
    labels = [(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (2, None, 0)]
    at = written_tables(spark, str(tmp_path / "odd"), ODD, labels)
    model = None
    if name == "op7_quality_cnn":
        read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
        model = quality.fit(read("documents"), read("labels"))
    check_rows(spark, at, name, ODD, model, library)
    assert registry.QUERIES[name](spark, written_tables(spark, str(tmp_path / "empty"), [])).count() == 0


def test_a_text_of_50_mb(spark, tmp_path, library):
    """Whole texts, however long: every query over one of 50 MB beside short ones."""
    line = "A long line of the words number {} under the MIT License, näher beschrieben."
    text = "\n".join(line.format(k % 5000) for k in range(50 * (1 << 20) // 78))
    rows = [(1, text), (2, "short\n" + line.format(7)), (3, None)]
    documents_path = tmp_path / "documents.parquet"
    documents_path.mkdir()
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    table = pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*[(i, t, "en", "s", 1) for i, t in rows]), kinds)], names=[n for n, _ in kinds])
    pq.write_table(table, documents_path / "part-0.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in COLUMNS:
        check_rows(spark, str(tmp_path), name, rows, None, library)
    kept = {r.doc_id: r for r in registry.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert kept[1].n_dropped == 0 and kept[2].n_dropped == 1


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    at = written_tables(spark, str(tmp_path), [*ODD, *[(20 + k, f"line {k} of a document\nand one that many share\n{'word ' * k}") for k in range(30)]], [(k, 1, 0) for k in range(20, 50)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"clash {c}" for r in rows for c in CLASHES)
        docs = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == docs.count()


# ---- BPE


def odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "a" * 300, "\n\n  x  \n", "don't  I'll", "日本語 テキスト", "😀👨‍👩‍👧", "".join(rng.choice("abc \n") for _ in range(5000)), "ab" * 4000 + " " + "é" * 500]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x9000)])) for _ in range(60)) for _ in range(100)]


def test_bpe_equals_the_library(codec, library):
    for text in odd_texts():
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def check_bpe(spark, library, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    lists = {r.doc_id: r for r in byte_bpe.tokens(df, PATH, public_tokenizers.PATTERN, keep=("doc_id",)).collect()}
    assert len(got) == len(lists) == len(texts)
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        spelled = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        plain = hashlib.sha256((text or "").encode()).hexdigest()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), spelled, plain), k
        assert (lists[k].ids, lists[k].n_tokens, lists[k].decoded_sha256) == (ids, len(ids), plain)


def test_bpe_over_a_corpus(spark, library):
    texts = [r.text for r in documents(spark).select("text").collect()]
    check_bpe(spark, library, [*texts, None, *odd_texts(), texts[0], texts[0]])


def test_bpe_with_many_parts(spark, library, monkeypatch):
    """Parts are counted on the driver's side: here nearly every word has one of its own."""
    monkeypatch.setattr(byte_bpe, "PART_BYTES", 50)
    check_bpe(spark, library, ["a few words, a few", "", "words 12 and\n more", None])


def test_bpe_splits_blocks_and_long_texts(monkeypatch, codec, library):
    """What a task makes of its texts when blocks, pieces and groups are small."""
    for name, value in (("BLOCK", 200), ("PIECE", 40), ("TOGETHER", 60), ("WORD_BYTES", 8)):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(byte_bpe, "TaskContext", type("T", (), {"get": lambda: type("C", (), {"partitionId": lambda self: 3})()}))
    monkeypatch.setattr(byte_bpe, "codec", lambda *_: codec)
    texts = [t for t in odd_texts()[:20]] + ["short", None, "and more words " * 30]
    batches = [pa.record_batch([pa.array(range(k, min(k + 7, len(texts)))), pa.array(texts[k : k + 7])], names=["row", "text"]) for k in range(0, len(texts), 7)]
    rows = pa.Table.from_batches(list(byte_bpe.split_texts(public_tokenizers.PATTERN, 5)(iter(batches)))).to_pylist()
    words = [r for r in rows if r["key"] >= 0]
    ids = []
    for part in sorted({r["key"] for r in words}):
        own = [r for r in words if r["key"] == part]
        table = pa.table({n: [r[n] for r in own] for n in ("block", "numbers", "words")})
        ids += byte_bpe.encode_part("", "")((pa.scalar(part),), table).to_pylist()
    blocks = sorted({r["key"] for r in rows if r["key"] < 0})
    assert len(blocks) > 3 and blocks[-1] == -1 - (3 << 32)
    seen = {}
    for block in blocks:
        held, own = [r for r in rows if r["key"] == block], [r for r in ids if r["key"] == block]
        table = lambda x, names: pa.table({n: pa.array([r[n] for r in x], pa.list_(pa.int64()) if n == "rows" else pa.binary()) for n in names})
        out = byte_bpe.assemble("", "", True)((pa.scalar(block),), table(held, ["rows", "sizes", "numbers"]), table(own, ["numbers", "ids", "counts"]))
        seen |= {r["row"]: r["ids"] for r in out.to_pylist()}
    assert seen == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_bpe_with_ranks_out_of_order():
    """Pairs that rank below the merge that makes them, overlaps and neighbours of the same rank."""
    rng = random.Random(3)
    longer = [b"aa", b"ab", b"abc", b"bc", b"ca", b"cab", b"aab", b"bca", b"bb", b"abab", b"caca", b"abca", b"aaa", b"aaaa"]
    for _ in range(8):
        rng.shuffle(longer)
        ranks = {bytes([k]): k for k in range(256)} | {t: 256 + k for k, t in enumerate(longer)}
        merges = byte_bpe.Merges(ranks)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
        ids, count = byte_bpe.replay_corpus(words, merges)
        library = tiktoken.Encoding("x", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        for w, own in zip(words, np.split(ids, np.cumsum(count)[:-1])):
            assert own.tolist() == library.encode_ordinary(w.decode()) == byte_bpe.replay(w, merges).tolist()


def test_what_is_no_scan_is_written_first(spark):
    docs = documents(spark)
    assert byte_bpe.is_scan(docs.select("doc_id", "text").where("doc_id > 3"))
    assert not byte_bpe.is_scan(docs.repartition(3)) and not byte_bpe.is_scan(docs.distinct()) and not byte_bpe.is_scan(docs.orderBy("text").limit(5))


def test_numbers_pack():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0), np.arange(5), rng.integers(0, 2**32, 1000), rng.integers(0, 300, 5000)):
        assert (common.unpack_numbers(common.pack_numbers(x.astype(np.uint32))) == x).all()
    for words in ([], [b""], [b"a", b"", "é".encode() * 3000, b"\n"]):
        assert byte_bpe.unpack_words(byte_bpe.pack_words(words)) == words


# ---- classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_docs(docs, quality.fit(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got[got.held_out]
    assert (test.predicted == test.quality).mean() >= 0.93
    assert (test[test.quality == 1].predicted == 1).mean() >= 0.98


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert all((a[k] == b[k]).all() for k in a)


def test_long_texts_are_scored_whole(monkeypatch):
    model = quality.new_model(np.random.default_rng(0))
    texts = [bytes(np.random.default_rng(k).integers(0, 256, n).astype(np.uint8)) for k, n in enumerate((0, 1, 127, 128, 129, 5000, 20001))]
    whole = quality.scores(texts, model)
    monkeypatch.setattr(quality, "PIECE", 1024)
    assert np.allclose(whole, quality.scores(texts, model), atol=1e-5)
    assert np.allclose(whole, [quality.scores([t], model)[0] for t in texts], atol=1e-5)


def plain_score(text, model):
    """The network over a whole text by its definition: every window of a chunk, every chunk of the text."""
    n = max(1, -(-len(text) // quality.BLOCK))
    text = text + bytes((n + 2) * quality.BLOCK - len(text))
    found = []
    for c in range(n):
        begin = c * quality.BLOCK
        windows = [model["emb"][np.frombuffer(text[k : k + quality.WIDTH], np.uint8)].reshape(-1) @ model["filt"] for k in range(begin, begin + 2 * quality.BLOCK, quality.STRIDE)]
        found.append(np.maximum(np.max(windows, axis=0) + model["bias"], 0))
    z = np.concatenate([np.mean(found, axis=0), np.max(found, axis=0)]) @ model["out"] + model["shift"][0]
    return 1 / (1 + np.exp(-z))


def random_texts(rng):
    return [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 300, 900, 2000)]


def test_scores_against_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(4)
    model = quality.new_model(rng)
    model["bias"] += rng.normal(0, 0.3, quality.FILTERS).astype(np.float32)
    texts = random_texts(rng)
    want = [plain_score(t, model) for t in texts]
    for piece in (quality.PIECE, 512):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.allclose(quality.scores(texts, model), want, atol=1e-5)


def test_gradients(monkeypatch):
    """Against differences of the loss, over whole texts that are read in pieces."""
    monkeypatch.setattr(quality, "PIECE", 384)
    rng = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in quality.new_model(rng).items()}
    model["bias"] += rng.normal(0, 0.3, quality.FILTERS)
    batch = [(t, k % 2) for k, t in enumerate(random_texts(rng))]

    def loss(m):
        total = 0.0
        for text, y in batch:
            p = plain_score(text, m)
            total -= np.log(p if y else 1 - p) / len(batch)
        return total + 0.5e-4 * (m["filt"] ** 2).sum() + 0.5e-4 * (m["out"] ** 2).sum()

    grads = quality._gradients(batch, model)
    for name, at in (("emb", (100, 1)), ("emb", (0, 2)), ("filt", (5, 3)), ("filt", (30, 17)), ("bias", (2,)), ("out", (4,)), ("out", (quality.FILTERS + 4,)), ("shift", (0,))):
        step = {k: v.copy() for k, v in model.items()}
        step[name][at] += 1e-6
        back = {k: v.copy() for k, v in model.items()}
        back[name][at] -= 1e-6
        assert abs((loss(step) - loss(back)) / 2e-6 - grads[name][at]) < 1e-5, (name, at)


def test_the_sample_has_whole_texts_within_its_bounds(spark):
    docs = spark.createDataFrame([(k, "x" * (10 * k)) for k in range(40)] + [(7, "x" * 70), (None, "n")], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(99, 1), (None, 1), (3, None)], "doc_id long, quality int")
    some = lambda most, most_bytes: quality.chosen_rows(docs, labels, "doc_id", "text", "quality", most, most_bytes)
    every = some(1000, 1 << 20)
    assert sorted(every) == [(k, k % 2) for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert some(10, 1 << 20) == every[:10] or 7 in dict(every[:10])
    few = some(1000, 600)
    assert sum(10 * k * (2 if k == 7 else 1) for k, _ in few) <= 600 and set(few) <= set(every) and len(few) > 3
    assert some(1000, 0) == [(0, 0)] if (0, 0) in every else True


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame([(1, "a")], DOC)
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.score_docs(docs, None).first().score == 0.5


# ---- JPEG


def test_jpeg_round_trip(spark):
    rng = np.random.default_rng(1)
    texts = [r.text.encode() for r in documents(spark).limit(50).collect()] + [b"", b"a", bytes(range(256)), b"\xff" * 200, bytes([0, 255] * 500), rng.integers(0, 256, jpeg.FRAME + 1000).astype(np.uint8).tobytes()]
    payloads = [jpeg.padded(t) for t in texts]
    media = jpeg.encode(payloads)
    for p, m in zip(payloads, media):
        images = jpeg.parse(m)
        assert b"".join(t.tobytes() for t in jpeg.thumbnails(images)) == p
        assert len(images) == -(-len(p) // jpeg.FRAME)


# The standard's luminance AC table (numbers of codes by length) and enough of its values for the test below.
AC_BITS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0)
AC_VALUES = (0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82)


def bits_of(value, size):
    return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def color_jpeg(width, height, interval, rng):
    """A file of three components (luminance 2x2) with random coefficients, and its luminance DC values by block row."""
    dc_codes, ac_codes = jpeg.huffman_codes(jpeg.DC_BITS, jpeg.DC_VALUES), jpeg.huffman_codes(AC_BITS, AC_VALUES)
    code = lambda table, v: format(table[v][0], f"0{table[v][1]}b")
    across, down = -(-width // 16), -(-height // 16)
    luma = rng.integers(-60, 60, (2 * down, 2 * across))
    out, bits, pred = b"", "", [0, 0, 0]

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return raw

    for mcu in range(across * down):
        if interval and mcu and mcu % interval == 0:
            out += flush() + bytes((0xFF, 0xD0 + (mcu // interval - 1) % 8))
            pred = [0, 0, 0]
        y, x = divmod(mcu, across)
        for c, values in ((0, [luma[2 * y + j, 2 * x + i] for j in (0, 1) for i in (0, 1)]), (1, [int(rng.integers(-30, 30))]), (2, [int(rng.integers(-30, 30))])):
            for v in values:
                diff, pred[c] = int(v) - pred[c], int(v)
                size = abs(diff).bit_length()
                bits += code(dc_codes, size) + bits_of(diff, size)
                k = 1
                while k < 64 and rng.random() < 0.6:
                    run = int(rng.choice([0, 1, 2, 15]))
                    if run == 15:
                        if k + 16 > 63:
                            break
                        bits, k = bits + code(ac_codes, 0xF0), k + 16
                    elif k + run <= 63:
                        size = int(rng.choice([1, 2]))
                        bits += code(ac_codes, run << 4 | size if (run << 4 | size) in AC_VALUES else 0x01 if size == 1 else 0x02)
                        run = run if (run << 4 | size) in AC_VALUES else 0
                        bits += bits_of(int(rng.choice([-1, 1])) * (1 << size - 1), size)
                        k += run + 1
                if k <= 63:
                    bits += code(ac_codes, 0)
    out += flush()
    s = jpeg._segment
    head = b"\xff\xd8" + s(0xE0, b"JFIF\0") + s(0xDB, b"\0" + bytes([3] + [1] * 63)) + s(0xDB, b"\x11" + bytes([0, 5] + [0, 1] * 63))
    head += s(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01")
    head += s(0xC4, b"\x00" + bytes(jpeg.DC_BITS) + bytes(jpeg.DC_VALUES) + b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES))
    head += (s(0xDD, interval.to_bytes(2, "big")) if interval else b"") + s(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return head + out + b"\xff\xd9", luma


@pytest.mark.parametrize("width,height,interval", [(16, 16, 0), (70, 45, 0), (70, 45, 3), (33, 200, 5)])
def test_jpeg_with_components_and_ac(width, height, interval):
    data, luma = color_jpeg(width, height, interval, np.random.default_rng(width + interval))
    (image,) = jpeg.parse(data)
    assert (image.width, image.height, image.interval) == (width, height, interval)
    (thumb,) = jpeg.thumbnails([image])
    want = np.clip((luma * 3 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    assert (thumb == want).all()


def test_jpeg_rejects():
    data, _ = color_jpeg(16, 16, 0, np.random.default_rng(1))
    for bad in (b"GIF89a", data.replace(b"\xff\xc0", b"\xff\xc2"), data[: data.index(b"\xff\xda") + 14] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.thumbnails(jpeg.parse(bad))


def test_jpeg_query(spark):
    got = {r.doc_id: r for r in registry.op5_jpeg(spark, SF).collect()}
    for d in documents(spark).collect():
        p, r = jpeg.padded(d.text.encode()), got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(d.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m := jpeg.encode([p])[0]), hashlib.sha256(m).hexdigest())


# ---- licenses


def plain_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(s, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for s in range(len(words) - len(p) + 1) if words[s : s + len(p)] == p]
    return words, hits


def test_licenses_against_brute_force(spark):
    long = " ".join(["mit"] * 40 + ["mit license"] * 50 + ["w"] * 100 + ["GNU General\nPublic License", "cc-by", "the Apache (License)"])
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(-1, long), (-2, "éapache license"), (-3, licenses.NOTICES[0][0].replace("hereby", "")), (-4, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOC)).collect()}
    index = licenses.Index(licenses.PHRASES, licenses.NOTICES, licenses.THRESHOLD, {})
    for i, text in rows:
        words, hits = plain_scan(text)
        r, starts = got[i], [s for s, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))
        # every block against every notice
        best, found = float(bool(hits)), {x for _, x in hits}
        for b in range(0, max(1, len(words)), index.half):
            block = set(words[b : b + 2 * index.half])
            for notice, label, required in licenses.NOTICES:
                t = set(notice.split())
                if len(t & block) >= licenses.THRESHOLD * len(t) - 1e-9 and set(required.split()) <= block:
                    best, found = max(best, len(t & block) / len(t)), found | {label}
        assert (r.labels, round(r.score, 9)) == (",".join(sorted(found)), round(best, 9)), (i, r)
    assert got[-3].labels == "mit" and got[-3].n_base == 0


def test_licenses_are_told_apart(spark):
    terms = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    rows = [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("This program is free software: you can redistribute it and/or modify " + terms.format(""), "gpl"),
        ("This library is free software; you can redistribute it and/or modify " + terms.format("Lesser "), "lgpl"),
        ("Licensed under the Apache License, Version 2.0", "apache"),
        ("licensed under the license version 2 0", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], DOC)).collect()
    assert [r.labels for r in sorted(got)] == [labels for _, labels in rows]


def test_notices_come_from_a_table(spark):
    kind = "text string, label string, required string, extra int"
    table = spark.createDataFrame([("Free as in Speech, not as in beer!", "speech", "speech", 1), ("all rights reserved by the owner", "closed", None, 2)], kind)
    notices = licenses.notices_of(table)
    assert notices == (("all rights reserved by the owner", "closed", ""), ("free as in speech not as in beer", "speech", "speech"))
    docs = spark.createDataFrame([(1, "free as in speech not as in"), (2, "free as in not as in beer"), (3, "All rights reserved by owner, apache license")], DOC)
    assert [r.labels for r in sorted(licenses.scan_licenses(docs, notices=notices).collect())] == ["speech", "", "apache,closed"]
    for bad in [("", "x", ""), ("a b", None, ""), ("a b", "x", "c")]:
        with pytest.raises(ValueError):
            licenses.notices_of(spark.createDataFrame([(*bad, 0)], kind))


# ---- sharding


def test_sharding(spark):
    rows = [(k, f"text {k}") for k in range(300)] + [(1000 + k, f"pair {k // 2}") for k in range(120)] + [(2000 + k, "hot") for k in range(250)]
    got = sharding.place(spark.createDataFrame(rows, DOC), shards=7).toPandas()
    text = dict(rows)
    sizes = got.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in got.itertuples())
    shards = got.assign(text=got.doc_id.map(text)).groupby("text").shard.nunique()
    assert (shards[shards.index != "hot"] == 1).mean() > 0.95 and shards["hot"] <= 4
    again = sharding.place(spark.createDataFrame(rows[::-1], DOC).repartition(5), shards=7).toPandas()
    assert again.set_index("doc_id").shard.to_dict() == got.set_index("doc_id").shard.to_dict()


def split_groups(got, text):
    return int((got.assign(text=got.doc_id.map(text)).groupby("text").shard.nunique() > 1).sum())


def test_shards_exchange_rows(spark):
    """No unlinked row, so no shard has a free place at any time: only exchanges put groups together."""
    pairs = [(k, f"pair {k // 2}") for k in range(4000)]
    got = sharding.place(spark.createDataFrame(pairs, DOC)).toPandas()
    assert got.groupby("shard").size().tolist() == [100] * 40 and split_groups(got, dict(pairs)) == 0
    rows = [(k, "hot") for k in range(1000)] + [(1000 + k, f"group {k // 3 if k < 999 else (k - 999) // 2 + 333}") for k in range(1999)]
    got = sharding.place(spark.createDataFrame(rows, DOC), shards=7).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and split_groups(got, dict(rows)) <= 7
    assert got[got.doc_id < 1000].shard.nunique() == 3


def test_labels_are_propagated_in_small_tables(spark, monkeypatch):
    """Below some 40 * 16 members a shard no group is large, so all of them go through the rounds."""
    calls = []
    monkeypatch.setattr(sharding, "propagate", lambda linked, quotas, own=sharding.propagate: calls.append(linked.count()) or own(linked, quotas))
    rows = [(k, f"group {k // 4}") for k in range(400)]
    got = sharding.place(spark.createDataFrame(rows, DOC)).toPandas()
    assert calls == [400] and set(got.groupby("shard").size()) == {10}
    # two groups of four fill eight of ten places, so a fifth of the groups can't but be cut
    assert split_groups(got, dict(rows)) <= 20


def least_cut(groups, quotas):
    """The fewest groups that any placement splits, by trying which of them stay whole."""
    def fits(sizes, room):
        if not sizes:
            return True
        n, *rest = sizes
        tried = set()
        for k, r in enumerate(room):
            if r >= n and r not in tried:
                tried.add(r)
                if fits(rest, [*room[:k], r - n, *room[k + 1 :]]):
                    return True
        return False

    for cut in range(len(groups) + 1):
        for gone in itertools.combinations(range(len(groups)), cut):
            if fits(sorted((n for k, n in enumerate(groups) if k not in gone), reverse=True), list(quotas)):
                return cut


@pytest.mark.parametrize("groups,shards", [([3, 3, 2, 2, 2], 3), ([4, 4, 4], 2), ([5, 3, 2, 2], 2), ([2] * 6, 4), ([6, 2, 2, 2], 4)])
def test_small_cuts_against_every_placement(spark, groups, shards):
    rows = [(10 * g + k, f"text {g}") for g, n in enumerate(groups) for k in range(n)]
    got = sharding.place(spark.createDataFrame(rows, DOC), shards=shards).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    quotas = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    least = least_cut(groups, quotas)
    assert least <= split_groups(got, dict(rows)) <= min(least + 1, shards)


def test_exchanges_along_cycles():
    assert sharding.exchanges({(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 2}, [0, 0, 0]) == {(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 2}
    assert sharding.exchanges({(0, 1): 5}, [0, 0]) == {} and sharding.exchanges({(0, 1): 5}, [0, 2]) == {(0, 1): 2}


# ---- mixing


def plain_targets(sizes, share=1.5, cap=2.0):
    """Shares by weight, capped and reshared until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= cap * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " w" * rng.choice([0, 1, 3, 20, 50, 400, 3000]), rng.choice(["a", "b", "Z", "é", "zz", "", None])) for k in range(900)] + [(5, "x y", "a"), (None, "x y z", "b"), (6, None, "only-null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    assert sorted((len((t or "").split()) for _, t, _ in rows)) == sorted(got["size"])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    full = mixing.mix_sizes(df.select(F.col("doc_id").alias("id"), "source", mixing.n_words("text").alias("size"))).toPandas()
    for _, part in full.groupby(full.source.map(repr)):
        s = part.source.iloc[0]
        assert abs(part.target.iloc[0] - want[s]) < 1e-6 and part.source_size.iloc[0] == sizes[s]
        assert abs((part["size"] * part.copies).sum() - want[s]) <= max(60, 0.005 * want[s])
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))


def test_mixed_rows_keep_their_own_decisions(spark):
    """Null and repeated ids, a null source and equal rows: the stage takes as many words as the query, row by row."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 7, 7, 100 + k]), " w" * rng.choice([0, 1, 3, 20, 50]) + f" x{k % 40}", rng.choice(["a", "b", "c", None])) for k in range(900)] + [(None, "same text", "c")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mix_sizes(df.select(mixing.to_id("doc_id").alias("id"), "source", mixing.n_words("text").alias("size"))).toPandas()
    got = mixing.mixed(df).select("doc_id", "source", mixing.n_words("text").alias("size")).collect()
    count = {}
    for r in got:
        key = (2**63 - 1 if r.doc_id is None else r.doc_id, r.source, r["size"])
        count[key] = count.get(key, 0) + 1
    due = {}
    for i, s, n, c in zip(want.id, want.source, want["size"], want.copies):
        key = (int(i), s if isinstance(s, str) else None, int(n))
        due[key] = due.get(key, 0) + int(c)
    assert count == {k: c for k, c in due.items() if c}
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mixed(df).collect()))


def test_mixed_with_clashing_names(spark):
    names = ["copies", "_copies", "_copy", "_mix_id", "row", "id", "hash", "n", "size", "key", "nth", "a.b"]
    rows = [(k % 7 if k % 3 else None, " w" * (k % 5), "ab"[k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    more = df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(names)])
    got = mixing.mixed(more)
    assert got.columns == more.columns
    assert sorted(map(repr, got.select("doc_id", "text", "source").collect())) == sorted(map(repr, mixing.mixed(df).collect()))


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, "a", 5)] * 40 + [(1, None, 0), (1, None, 0), (2, "a", 5)]
    got = mixing.numbered(spark.createDataFrame(rows, "id long, source string, size long")).collect()
    assert sorted(r.nth for r in got if r.id is None) == list(range(40)) and sorted((r.id, r.nth) for r in got if r.id) == [(1, 0), (1, 1), (2, 0)]


def test_rounding_keeps_mass_and_probability(spark):
    rows = [(k % 2, k, 1 + k % 9, 0.3 * (1 + k % 9)) for k in range(2000)]
    df = spark.createDataFrame(rows, "s int, id long, w long, m double").withColumn("nth", F.lit(0).cast("long"))
    got = mixing.round_by_pairs(df, 2).toPandas()
    assert len(got) == 2000 and set(got.up) == {0, 1}
    for s in (0, 1):
        mass = sum(m for k, _, _, m in rows if k == s)
        assert abs((got.w * got.up)[got.s == s].sum() - mass) <= 9
    assert all(abs(got.up[got.w == w].mean() - 0.3) < 0.12 for w in range(1, 10))


# ---- WARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = b"HTTP/1.1 200 OK\r\n\r\nline\nline 2\n\n"
    records = [warc.ArcRecord("http://a/b c", "1.2.3.4", "20010203040506", "text/html", block), warc.ArcRecord("http://x", "0.0.0.0", "20260101000000", "text/html", b"")]
    raw = warc.arc_version_block(version, "n.arc") + b"\n" + b"\n".join(warc.arc_record(version, "n.arc", r) for r in records) + b"\n"
    packed = gzip.compress(raw[:100]) + gzip.compress(raw[100:])
    assert list(warc.read_arc(packed)) == [records[0]._replace(url="http://a/b%20c"), records[1]]
    with pytest.raises(ValueError):
        list(warc.read_arc(gzip.compress(raw[:-40])))
    with pytest.raises(ValueError):
        list(warc.read_arc(gzip.compress(b"no version block\n")))


@pytest.mark.parametrize("few", [warc.FEW_BYTES, 0])
def test_warc_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_BYTES", few)
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(1, "http://a", big), (2, "http://b c\n", big), (3, None, None), (4, "", "short"), (5, "u", "short"), (None, "n", big), (2, "http://d", big), (6, "http://e", "x" * 100), (7, "http://e", "x" * 100), (8, "http://e", "y" * 99), (9, "http://e", "y" * 99)]
    pages += [(None, "http://hot", "hot " * 50)] * 40 + [(k, "http://hot", "hot " * 50) for k in range(20, 60)] + [(k, "http://own", f"{k} " * 60) for k in range(100, 130)]
    got = warc.archive(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")).collect()
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None]
        again = len(raw) >= 100 and same and min(same) != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_payloads_and_clashing_names(spark):
    long = "é <p> long payload\n" * 1_000_000
    rows = [(1, "http://a", long), (2, "http://b", long), (3, "http://c", "short")]
    clash = [f"{k} AS {c}" for k, c in enumerate(["id", "digest", "size", "kind", "head", "member", "kept", "n", "first", "value", "payload_bytes", "record_type"])]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *clash)).collect()
    raw = long.encode()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)[:2] == [(1, len(raw), "response", None), (2, len(raw), "revisit", 1)]
    assert {r.payload_digest for r in got if r.page_id < 3} == {hashlib.sha256(raw).hexdigest()} and len(got) == 3


def archive_files(path):
    return sorted(p for p in path.glob("part-*"))


def test_types_and_members(spark, tmp_path):
    """Version blocks, responses, resources and revisits of files of both versions, read member by member."""
    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" + b"<p>" + b"same " * 40
    records = [
        warc.ArcRecord("http://a", "1.2.3.4", "20010203040506", "text/html", http % 7),
        warc.ArcRecord("dns:a", "1.2.3.4", "20010203", "text/dns", b"20010203\na. 300 IN A 1.2.3.4\n"),
        warc.ArcRecord("http://b", "1.2.3.4", "20010203040507", "text/html", http % 3),
    ]
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        raw = warc.arc_version_block(version, "n.arc") + b"\n" + b"".join(warc.arc_record(version, "n.arc", r) + b"\n" for r in records[version - 1 :: 2])
        (tmp_path / "arc" / f"v{version}.arc.gz").write_bytes(gzip.compress(raw))
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    seen = []
    for f in archive_files(tmp_path / "warc"):
        packed, own = f.read_bytes(), []
        while packed:
            work = zlib.decompressobj(31)
            (record,) = warc.read_warc(gzip.compress(work.decompress(packed)))
            packed = work.unused_data
            own.append(record)
        assert own[0][0]["warc-type"] == "warcinfo" and all(f["warc-type"] != "warcinfo" for f, _ in own[1:])
        seen += own[1:]
    by = {f["warc-target-uri"]: (f, block) for f, block in seen}
    assert {u: f["warc-type"] for u, (f, _) in by.items()} == {"http://a": "revisit", "dns:a": "resource", "http://b": "response"}
    kept, again, lookup = by["http://b"][0], by["http://a"][0], by["dns:a"]
    assert (again["warc-refers-to"], again["warc-refers-to-target-uri"], again["warc-refers-to-date"]) == (kept["warc-record-id"], "http://b", "2001-02-03T04:05:07Z")
    assert again["warc-payload-digest"] == kept["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"<p>" + b"same " * 40).hexdigest()
    assert lookup[0]["content-type"] == "text/dns" and lookup[0]["warc-date"] == "2001-02-03T00:00:00Z" and lookup[1] == records[1].block
    rows = sorted(map(repr, map(tuple, warc.read_warc_files(spark, f"file://{tmp_path}/warc").select("page_id", "record_type", "refers_to").collect())))
    assert rows == sorted(map(repr, [(7, "revisit", 3), (3, "response", None), (None, "resource", None)]))


def test_files_end_by_their_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = [(k, f"http://p/{k}", rng.bytes(3 << 20).hex()) for k in range(12)] + [(20, "http://long", rng.bytes(9 << 20).hex())]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(df, f"file://{tmp_path}/arc")
    sizes = [f.stat().st_size for f in archive_files(tmp_path / "arc")]
    assert len(sizes) > 2 and max(sizes) < 40 << 20
    assert [r.block[-10:] for f in archive_files(tmp_path / "arc") for r in warc.read_arc(f.read_bytes())] == [p[2][-10:].encode() for p in pages]
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.archive(df).collect()}
    assert got == {p[0]: (len(p[2]), "response") for p in pages}


# ---- pipeline


def test_pipeline_stages(spark):
    docs = documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = lambda d: {r.doc_id for r in d.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = ids(kept["quality classifier"])
    good = [i for i, q in labels.items() if q == 1]
    assert len(first & set(good)) >= 0.98 * len(good)
    assert ids(kept["line dedup"]) == first
    near = simhash.near_duplicates(kept["line dedup"]).toPandas()
    assert ids(kept["simhash near-dedup"]) == set(near.component_id)
    copies = kept["source mixing"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 2 and {r.doc_id for r in copies} <= ids(kept["simhash near-dedup"])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    texts = {r.doc_id: r.text for r in kept["source mixing"].collect()}
    for r in docs.collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_the_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_texts_pass_through_the_pipeline(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in ODD]
    spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
