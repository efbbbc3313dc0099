"""Document quality by a byte-level convolutional network in numpy.

Bytes become embeddings; FILTERS learned filters of 8 bytes, 4 apart, run over the whole document in chunks that
overlap by one filter; rectified responses are max-pooled and averaged within each chunk. A document's features
are, over its chunks, the largest maximum, the mean of the means and the largest mean of each filter, and the logarithm of
its length; a small hidden layer combines them into one probability. Everything is trained together by Adam on a bounded sample
of rows (SAMPLE_ROWS of each label); the sample takes both labels equally, and the output's bias is then moved to the share
of labels in all rows that may be learnt from. The rows of the sample are learnt from whole, every chunk of them pooled as in scoring; where
their texts pass SAMPLE_BYTES for a label, the sample has fewer rows. Gradients go through long texts a few chunks at a time.

Defined cases: a null or empty text is scored as one chunk of padding; repeated rows score alike; rows without a label,
or with a null quality, are scored but never learnt from; with no learnable row, or only one label, the score is the
learnable share of label 1 (0.5 if there is none); a very long text is scored whole, a few chunks at a time; other columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import limit_batches, read
from .language_id import part_of
from .tokens import text_slices

STRIDE = 4
EMBEDDING = 8
FILTERS = 48
HIDDEN = 24
#: Filter positions of a chunk (times STRIDE bytes); the next chunk begins one filter earlier than this one ends.
CHUNK = 128
SAMPLE_ROWS = 2000
#: Text of a label's sample that the driver holds; rows beyond it are left out whole (the first one never).
SAMPLE_BYTES = 8 << 20
#: Chunks that go through the network at once.
PIECE = 256
EPOCHS = 10
#: Fewest steps, for small samples; chunks that go through in all steps together, about, which long texts spend faster; and how fast weights decay.
LEAST_STEPS = 600
PASSES = 400_000
DECAY = 0.3
BATCH = 16
RATE = 0.004
SEED = 5
THRESHOLD = 0.7


@dataclasses.dataclass
class QualityModel:
    parameters: dict[str, np.ndarray] | None
    shift: float  # added to the logit
    constant: float  # the score where nothing could be trained


def layout(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' bytes as rows of STRIDE, each chunk on CHUNK + 1 rows; chunk counts; rows that hold text in a chunk.

    A filter reads two rows that follow one another, so a chunk's last row is the first row of the next chunk.
    """
    step = CHUNK * STRIDE
    counts = np.array([max(1, -(-(len(b) - STRIDE) // step)) for b in blobs])
    ends = np.cumsum(counts)
    data = np.zeros((ends[-1], step + STRIDE), dtype=np.uint8)
    used = np.full(ends[-1], CHUNK)
    for blob, end, n in zip(blobs, ends.tolist(), counts.tolist()):
        padded = np.zeros(n * step + STRIDE, dtype=np.uint8)
        padded[: len(blob)] = np.frombuffer(blob, dtype=np.uint8)[: len(padded)]
        data[end - n : end] = np.lib.stride_tricks.sliding_window_view(padded, step + STRIDE)[::step]
        used[end - 1] = max(1, -(-(len(blob) - (n - 1) * step - STRIDE) // STRIDE))
    return data, counts, np.minimum(used, CHUNK)


def responses(p: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """Rectified filter responses: chunk by position by filter."""
    x = p["embedding"][data].reshape(len(data), CHUNK + 1, STRIDE * EMBEDDING)
    both = x.reshape(-1, STRIDE * EMBEDDING) @ p["filters"]
    both = both.reshape(len(data), CHUNK + 1, 2 * FILTERS)
    out = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    out += p["bias"]
    return np.maximum(out, 0, out=out)


def pooled(act: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and mean of each filter over each chunk's used positions (responses are not negative)."""
    for k in np.flatnonzero(used < CHUNK):
        act[k, used[k] :] = 0
    return act.max(axis=1), act.sum(axis=1) / used[:, None]


def features(top: np.ndarray, mean: np.ndarray, counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A row for each document."""
    starts = np.cumsum(counts) - counts
    total = np.add.reduceat(used, starts)
    average = np.add.reduceat(mean * used[:, None], starts, axis=0) / total[:, None]
    parts = (np.maximum.reduceat(top, starts), 4 * average, 4 * np.maximum.reduceat(mean, starts))
    return np.concatenate((*parts, np.log1p(total)[:, None] / 4), axis=1).astype(top.dtype)


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ p["w1"] + p["b1"])
    return hidden @ p["w2"] + p["b2"][0], hidden


def _gradients(p: dict[str, np.ndarray], blobs: list[bytes], target: np.ndarray) -> dict[str, np.ndarray]:
    data, counts, used = layout(blobs)
    pieces = [slice(a, a + PIECE) for a in range(0, len(data), PIECE)]
    held = []  # responses of the only piece; where there are more, each is worked out again on the way back
    tops, means = [], []
    for piece in pieces:
        act = responses(p, data[piece])
        for out, values in zip((tops, means), pooled(act, used[piece])):
            out.append(values)
        held = [act]
    top, mean = np.concatenate(tops), np.concatenate(means)
    x = features(top, mean, counts, used)
    z, hidden = logits(p, x)
    error = ((1 / (1 + np.exp(-z))) - target).astype(np.float32) / len(blobs)
    g = {"w2": hidden.T @ error, "b2": np.array([error.sum()], np.float32)}
    back = np.outer(error, p["w2"]) * (1 - hidden**2)
    g["w1"], g["b1"] = x.T @ back, back.sum(axis=0)
    dx = back @ p["w1"].T
    d_top, d_average, d_high = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS] * 4, dx[:, 2 * FILTERS : 3 * FILTERS] * 4
    starts = np.cumsum(counts) - counts
    spread = np.repeat(d_average / np.add.reduceat(used, starts)[:, None], counts, axis=0)
    # For each document and filter the chunk of the largest maximum and that of the largest mean.
    best, high = (np.stack([a + v[a : a + n].argmax(axis=0) for a, n in zip(starts.tolist(), counts.tolist())]) for v in (top, mean))
    columns = np.broadcast_to(np.arange(FILTERS), best.shape)
    size = STRIDE * EMBEDDING
    for name, shape in (("bias", (FILTERS,)), ("filters", (size, 2 * FILTERS)), ("embedding", (256, EMBEDDING))):
        g[name] = np.zeros(shape, p[name].dtype)
    for piece in pieces:
        if len(pieces) > 1:
            act = responses(p, data[piece])
            pooled(act, used[piece])
        else:
            (act,) = held
        d_act = np.repeat(spread[piece][:, None, :], CHUNK, axis=1)
        here = (high >= piece.start) & (high < piece.stop)
        np.add.at(d_act, (high[here] - piece.start, slice(None), columns[here]), (d_high[here] / used[high[here]])[:, None])
        here = (best >= piece.start) & (best < piece.stop)
        chunk, column = best[here] - piece.start, columns[here]
        np.add.at(d_act, (chunk, act[chunk, :, column].argmax(axis=1), column), d_top[here])
        d_act *= act > 0
        g["bias"] += d_act.sum(axis=(0, 1))
        x_in = p["embedding"][data[piece]].reshape(len(d_act), CHUNK + 1, size)
        flat = d_act.reshape(-1, FILTERS)
        g["filters"] += np.concatenate((x_in[:, :-1].reshape(-1, size).T @ flat, x_in[:, 1:].reshape(-1, size).T @ flat), axis=1)
        d_x = np.zeros_like(x_in)
        d_x[:, :-1] += (flat @ p["filters"][:, :FILTERS].T).reshape(len(d_act), CHUNK, size)
        d_x[:, 1:] += (flat @ p["filters"][:, FILTERS:].T).reshape(len(d_act), CHUNK, size)
        per_byte, symbols = d_x.reshape(-1, EMBEDDING), data[piece].reshape(-1)
        g["embedding"] += np.stack([np.bincount(symbols, per_byte[:, k], 256) for k in range(EMBEDDING)], axis=1)
    return g


def train(rows: list[tuple[bytes, int]], share: float, seed: int = SEED) -> QualityModel:
    """rows: (text as bytes, label); share: of label 1 among all learnable rows."""
    labels = np.array([label for _, label in rows], dtype=np.float32)
    if not len(rows) or labels.min() == labels.max():
        return QualityModel(None, 0.0, share)
    rng = np.random.RandomState(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {
        "embedding": draw(256, EMBEDDING, scale=0.5), "filters": draw(STRIDE * EMBEDDING, 2 * FILTERS, scale=0.25),
        "bias": np.zeros(FILTERS, np.float32), "w1": draw(3 * FILTERS + 1, HIDDEN, scale=0.1), "b1": np.zeros(HIDDEN, np.float32),
        "w2": draw(HIDDEN, scale=0.3), "b2": np.zeros(1, np.float32),
    }
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    groups = [np.flatnonzero(labels == k) for k in (0, 1)]
    chunks = np.array([max(1, -(-(len(text) - STRIDE) // (CHUNK * STRIDE))) for text, _ in rows])
    of_step = BATCH // 2 * sum(chunks[group].mean() for group in groups)
    step, steps = 0, min(max(LEAST_STEPS, EPOCHS * -(-len(rows) // BATCH)), max(LEAST_STEPS // 6, int(PASSES / of_step)))
    while step < steps:
        picked = np.concatenate([rng.choice(group, BATCH // 2) for group in groups])
        step += 1
        g = _gradients(p, [rows[i][0] for i in picked], labels[picked])
        rate = RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if p[k].ndim == 2:
                p[k] *= np.float32(1 - rate * DECAY)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return QualityModel(p, float(np.log(share / (1 - share))), share)


def scores(model: QualityModel, blobs: list[bytes]) -> np.ndarray:
    if model.parameters is None:
        return np.full(len(blobs), model.constant)
    tops, means, all_counts, all_used = [], [], [], []
    # Long documents go through in pieces of whole chunks, so that memory doesn't follow their length.
    data, counts, used = layout(blobs)
    for a in range(0, len(data), 64):
        top, mean = pooled(responses(model.parameters, data[a : a + 64]), used[a : a + 64])
        tops.append(top)
        means.append(mean)
    x = features(np.concatenate(tops), np.concatenate(means), counts, used)
    z = logits(model.parameters, x)[0].astype(np.float64) + model.shift
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on at most `rows` rows of each label, whole; docs (doc_id, text), labels (doc_id, quality)."""
    limit_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    known = sizes.join(usable, "doc_id").select("doc_id", "size", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id", F.lit(SEED)).alias("_order"))
    first = [known.where(F.col("quality") == q).orderBy("_order", "doc_id").limit(rows) for q in (0, 1)]
    by_order = Window.partitionBy("quality").orderBy("_order", "doc_id")  # over at most `rows` of each label
    chosen = first[0].union(first[1]).withColumns({"place": F.row_number().over(by_order), "upto": F.sum("size").over(by_order)})
    chosen = chosen.where((F.col("upto") <= SAMPLE_BYTES) | (F.col("place") == 1)).select("doc_id", "quality", "place")
    sample = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most 2 * rows
        .select("place", "quality", F.coalesce("text", F.lit("")).alias("text"))
        .orderBy("place", "quality", "text").limit(2 * rows)
    )
    return train([(r.text.encode(), r.quality) for r in sample.collect()], share)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, 1 << 18):
                score = scores(shared.value, [t.encode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score)], names=["doc_id", "score"])

    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out():
    return F.coalesce(part_of(F.col("doc_id"), 4) == 2, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
