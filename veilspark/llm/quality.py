"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

A text's UTF-8 bytes are embedded; learned filters of WIDTH bytes slide over them by STRIDE. Chunks of two blocks of
BLOCK bytes, each overlapping the next by one block, cover the whole text; a filter's response to a chunk is its maximum
there. The mean and the maximum of these over all chunks of the text are combined into one probability.

The network is fitted on the driver on a bounded sample (parameters `most` and `most_bytes`): the labelled rows with the
smallest hashes of their id, as many as fit into both bounds, each with all chunks of its whole text. Labels are learned
only from rows outside the held-out fold (crc32 of the id as text, mod FOLDS, is 0 there). Scores depend on the text
alone. Every text is scored whole.

Defined cases: a null or empty text is scored as one block of zero bytes; a very long text is convolved a PIECE at a time; equal texts get
equal scores; labels that are null, or that belong to no document, are ignored, and of several labels of one id the smallest holds; rows with the
same doc_id are learned from and scored one by one; a null doc_id is in no fold (held_out false) and is never learned from; without any
label every score is 0.5; extra columns are ignored, or passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import trimmed, unpacked, whole_row

DIM, WIDTH, STRIDE, FILTERS, BLOCK = 4, 8, 2, 32, 128
FOLDS, THRESHOLD = 5, 0.3
#: The sample that the network is fitted on: rows, and bytes of their texts.
DOCS, DOC_BYTES = 4000, 24 << 20
EPOCHS, STEP, BATCH, SEED = 12, 0.01, 32, 7
#: Bytes that are convolved at once.
PIECE = 1 << 17

Model = dict[str, np.ndarray]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def new_model(rng: np.random.Generator) -> Model:
    f = np.float32
    return {
        "emb": rng.normal(0, 0.5, (256, DIM)).astype(f),
        "filt": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f),
        "bias": np.zeros(FILTERS, f),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f),
        "shift": np.zeros(1, f),
    }


def patches(emb: np.ndarray) -> np.ndarray:
    """(..., n, DIM) embedded bytes to (..., positions, WIDTH * DIM)."""
    n = (emb.shape[-2] - WIDTH) // STRIDE + 1
    flat = emb.reshape(*emb.shape[:-2], -1)
    step = flat.strides[-1]
    view = np.lib.stride_tricks.as_strided(flat, (*flat.shape[:-1], n, WIDTH * DIM), (*flat.strides[:-1], STRIDE * DIM * step, step))
    return np.ascontiguousarray(view)


def scores(texts: Iterable[bytes], model: Model) -> np.ndarray:
    """The probability of label 1 for every text, each read whole; short texts are convolved together, about PIECE bytes at once."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > PIECE:
            out += [_together(group, model), _pooled_score(*_long_pool(text, model), model)[None]]
            group, size = [], 0
            continue
        if size + len(text) > PIECE:
            out.append(_together(group, model))
            group, size = [], 0
        group.append(text)
        size += len(text)
    return np.concatenate([*out, _together(group, model)])


def _together(texts: list[bytes], model: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    used = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    # a block of zeros after each text keeps the windows of its last bytes off the next text
    flat = b"".join(t.ljust((u + 1) * BLOCK, b"\0") for t, u in zip(texts, used.tolist()))
    pooled = _block_maxima(flat, model)
    blank = np.cumsum(used + 1) - 1
    # the last windows of a block of zeros reach into the next text
    pooled[blank] = _block_maxima(b"\0" * BLOCK, model)[0]
    chunk = np.delete(np.maximum(pooled, np.concatenate([pooled[1:], pooled[-1:]])), blank, axis=0)
    first = np.cumsum(used) - used
    mean = np.add.reduceat(chunk, first, axis=0) / used[:, None]
    return _pooled_score(mean, np.maximum.reduceat(chunk, first, axis=0), model)


def _block_maxima(flat: bytes, model: Model) -> np.ndarray:
    """(blocks, FILTERS): each filter's largest response that starts in each block."""
    raw = np.frombuffer(flat + b"\0" * (WIDTH - STRIDE), np.uint8)
    got = patches(model["emb"][raw]) @ model["filt"]
    return np.maximum(got.reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1) + model["bias"], 0)


def _long_pool(text: bytes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The mean and maximum over all chunks of a text that is too long for one piece."""
    used = -(-len(text) // BLOCK)
    text = text.ljust((used + 1) * BLOCK, b"\0")
    total, most, last = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), None
    for k in range(0, len(text), PIECE):
        part = text[k : k + PIECE + WIDTH - STRIDE].ljust(min(PIECE, len(text) - k) + WIDTH - STRIDE, b"\0")
        pooled = np.maximum((patches(model["emb"][np.frombuffer(part, np.uint8)]) @ model["filt"]).reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1) + model["bias"], 0)
        if last is not None:
            pooled = np.concatenate([last[None], pooled])
        chunk = np.maximum(pooled[:-1], pooled[1:])
        total += chunk.sum(axis=0)
        most = np.maximum(most, chunk.max(axis=0)) if len(chunk) else most
        last = pooled[-1]
    return total / used, most


def _pooled_score(mean: np.ndarray, most: np.ndarray, model: Model) -> np.ndarray:
    z = np.concatenate([mean, most], axis=-1) @ model["out"] + model["shift"][0]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(samples: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fits the network to (whole text, label) samples by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    rate = np.clip(np.mean([y for _, y in samples]), 0.02, 0.98)
    model["shift"][0] = np.log(rate / (1 - rate))
    t = 0
    total = epochs * -(-len(samples) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), BATCH):
            t += 1
            grads = _gradients([samples[i] for i in order[k : k + BATCH]], model)
            rate = STEP * min(1.0, 2 * (1 - t / (total + 1)))
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def _chunk_maxima(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, number of chunks of each, each chunk's largest responses, where in the bytes they begin), a PIECE at a time."""
    used = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    # a block of zeros after each text, so that a text's last chunk is like any other
    flat = np.frombuffer(b"".join(t.ljust((u + 1) * BLOCK, b"\0") for t, u in zip(texts, used.tolist())) + b"\0" * (WIDTH - STRIDE), np.uint8)
    blocks = int(used.sum()) + len(texts)
    best, where = np.zeros((blocks, FILTERS), model["filt"].dtype), np.zeros((blocks, FILTERS), np.int64)
    step = PIECE // BLOCK
    for k in range(0, blocks, step):
        n = min(step, blocks - k)
        got = (patches(model["emb"][flat[k * BLOCK : (k + n) * BLOCK + WIDTH - STRIDE]]) @ model["filt"]).reshape(n, BLOCK // STRIDE, FILTERS)
        at = got.argmax(axis=1)
        best[k : k + n] = np.take_along_axis(got, at[:, None], axis=1)[:, 0]
        where[k : k + n] = at * STRIDE + (np.arange(k, k + n) * BLOCK)[:, None]
    blank = np.cumsum(used + 1) - 1
    # what begins in a block of zeros may reach into the next text: a block of nothing but zeros stands for it
    best[blank] = (model["emb"][np.zeros(WIDTH, np.uint8)].ravel() @ model["filt"])[None]
    where[blank] = blank[:, None] * BLOCK
    first = np.delete(np.arange(blocks), blank)
    later = best[first + 1] > best[first]
    return flat, used, np.where(later, best[first + 1], best[first]), np.where(later, where[first + 1], where[first])


def _gradients(batch: list[tuple[bytes, int]], model: Model) -> Model:
    """Gradients of the mean log loss (and a little of the weights' squares) over all chunks of the texts."""
    flat, n, best, where = _chunk_maxima([t for t, _ in batch], model)
    first = np.cumsum(n) - n
    h = np.maximum(best + model["bias"], 0)
    mean = np.add.reduceat(h, first, axis=0) / n[:, None]
    most = np.maximum.reduceat(h, first, axis=0)
    y = np.array([label for _, label in batch], np.float32)
    kind = model["filt"].dtype
    dz = ((_pooled_score(mean, most, model) - y) / len(batch)).astype(kind)
    feats = np.concatenate([mean, most], axis=1)
    doc = np.repeat(np.arange(len(batch)), n)
    dh = (dz / n)[doc, None] * model["out"][:FILTERS]
    top = h == most[doc]
    ties = np.add.reduceat(top.astype(kind), first, axis=0)
    dh = dh + top * (dz[:, None] * model["out"][FILTERS:] / ties)[doc]
    dh = np.where(h > 0, dh, 0).astype(kind)
    dfilt, demb = np.zeros_like(model["filt"]), np.zeros_like(model["emb"])
    byte = np.arange(WIDTH)
    for f in range(FILTERS):
        live = np.flatnonzero(dh[:, f])
        near = flat[where[live, f][:, None] + byte]
        # by byte value and place in the filter: sums of what flows back, from which both gradients follow
        flow = np.bincount((near + 256 * byte).ravel(), weights=np.repeat(dh[live, f], WIDTH), minlength=256 * WIDTH).reshape(WIDTH, 256)
        dfilt[:, f] = (flow @ model["emb"]).ravel()
        demb += flow.T @ model["filt"][:, f].reshape(WIDTH, DIM)
    return {"emb": demb, "filt": dfilt + 1e-4 * model["filt"], "bias": dh.sum(axis=0), "out": feats.T @ dz + 1e-4 * model["out"], "shift": np.array([dz.sum()], np.float32)}


def chosen_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> list[tuple[int, int]]:
    """(id, label) of the sample: labelled rows outside the held-out fold in the order of a hash of their ids, as long as there are under
    `most` of them and their texts fit into `most_bytes`; one that doesn't fit makes room for the next."""
    key = F.col(id_col).cast("long")
    open_fold = F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    wanted = labels.where(open_fold & F.col(label_col).isin(0, 1)).groupBy(key.alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sizes = docs.where(open_fold).select(key.alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    sized = sizes.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).join(wanted, "id")
    # texts that never fit are left out before the limit
    first = sized.where(F.col("size") <= most_bytes).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    out, rows, room = [], 0, most_bytes
    for r in first:
        if rows + r.rows <= most and r.size <= room:
            out.append((r.id, r.label))
            rows, room = rows + r.rows, room - r.size
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = DOCS, most_bytes: int = DOC_BYTES) -> Model | None:
    """The network fitted to the whole texts of at most `most` labelled rows outside the held-out fold, of `most_bytes` in all; None without any."""
    chosen = chosen_rows(docs, labels, id_col, text_col, label_col, most, most_bytes)
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(ids), "id")
    got = rows.select("id", "label", "text").collect()
    return train([(bytes(r.text or b""), r.label) for r in sorted(got, key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.text or b""))])


def _batch_scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return scores((x.as_py() or b"" for x in texts.cast(pa.binary())), model)


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _batch_scores(batch.column(1), model)
            yield pa.record_batch([batch.column(0), pa.array(got, pa.float64())], names=["row", "score"])

    return run


def score_docs(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(trimmed(_score(model)), "row long, score double")
    return out.select(F.col("row").alias("doc_id"), held_out(F.col("row")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _accepted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _batch_scores(batch.column(0), model)
            yield pa.record_batch([batch.column(1)], names=["row"]).filter(pa.array(got >= THRESHOLD))

    return run


def good_docs(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts."""
    rows = docs.select(F.col(text_col).alias("text"), whole_row(docs).alias("row"))
    return unpacked(rows.mapInArrow(trimmed(_accepted(model)), StructType([rows.schema["row"]])))
