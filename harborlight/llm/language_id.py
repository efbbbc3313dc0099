"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is read as lower-cased UTF-8 bytes; every run of 2, 3 and 4 bytes (word ends included) has a hashed bucket with
an embedding, the text is the mean of its buckets' embeddings, and a linear softmax gives the languages' probabilities.
Both layers are trained by stochastic gradient descent in numpy, on a bounded sample of rows (SAMPLE_ROWS for each
language): the whole of each text and two short pieces from anywhere in it, each as the counts of its buckets, so that what
the driver gathers is bounded by the number of buckets, however long texts are. A part of the sample that is not trained on
sets the softmax's temperature and the score below which a prediction counts as rejected.

For scoring, the two layers are multiplied into one table (bucket by language), so that a byte costs three look-ups.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; texts too short for a run of
two bytes are padded by word ends; a very long text is scored whole; repeated rows are scored alike; other columns, whatever their
names, pass through in `keep_identified`; with no labelled row at all every text is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import limit_batches, read
from .tokens import text_slices

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSIONS = 12
RUNS = (2, 3, 4)
SAMPLE_ROWS = 500
#: Most examples that the driver gathers, whatever the number of languages and of rows that share a doc_id.
MOST_EXAMPLES = 100_000
EPOCHS = 6
RATE = 3.0
SEED = 11
#: Share of rightly identified calibration texts that the rejection may cost, and the highest score it may ask for.
REJECTED_SHARE = 0.0005
HIGHEST_REJECTION = 0.5

_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b" " * 5)


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket by language: embedding times softmax weights, temperature applied
    bias: np.ndarray
    reject_below: float


def buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each run length, the bucket of the run that begins at each byte (the last ones go on with spaces)."""
    wide = data.astype(np.uint32)
    out, value = [], wide.copy()
    for k in range(1, max(RUNS)):
        following = np.concatenate((wide[k:], np.full(min(k, len(wide)), 32, np.uint32)))[: len(wide)]
        value = value * np.uint32(0x01000193) + following + np.uint32(k)
        if k + 1 in RUNS:
            x = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(((x >> np.uint32(13)) ^ x) & np.uint32(BUCKETS - 1))
    return out


def prepared(text: str) -> bytes:
    return b" " + text.encode().translate(_LOWER) + b" "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs, in integers as short as they can be."""
    all_buckets = np.concatenate(buckets(np.frombuffer(prepared(text), dtype=np.uint8)))
    ids, counts = np.unique(all_buckets, return_counts=True)
    return ids.astype(np.uint16), counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32)


def _cuts(text: str, rng: np.random.RandomState) -> list[str]:
    """The text and two shorter pieces of it, so that short texts are learnt as well."""
    words = text.split(" ")
    out = [text]
    for n in (rng.randint(1, 6), rng.randint(6, 30)):
        a = rng.randint(0, max(1, len(words) - n))
        piece = " ".join(words[a : a + n])
        if has_letter(piece):
            out.append(piece)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts for a whole text and for short pieces of it."""
    return [_features(piece) for piece in _cuts(text, np.random.RandomState(seed))]


def train(rows: list[tuple[list, str, bool]], seed: int = SEED) -> LanguageModel:
    """rows: (examples of a text, language, whether it is kept for calibration)."""
    languages = sorted({lang for _, lang, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    rng = np.random.RandomState(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    learn, hold = [], []
    for made, lang, calibrate in rows:
        (hold if calibrate else learn).extend((ids, counts, number[lang]) for ids, counts in made)
    shares = lambda counts: (counts / counts.sum()).astype(np.float32)
    embeddings = rng.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.uniform(-0.1, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(learn)):
            ids, counts, target = learn[at]
            share = shares(counts)
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ embeddings[ids]
            error = _softmax(hidden @ weights + bias)
            error[target] -= 1
            back = weights @ error
            weights -= rate * 0.1 * np.outer(hidden, error)
            bias -= rate * 0.01 * error
            embeddings[ids] -= rate * share[:, None] * back * np.float32(8)
    table = embeddings @ weights
    hold = hold or learn
    raw = np.array([shares(counts) @ table[ids] for ids, counts, _ in hold]) + bias
    truth = np.array([target for _, _, target in hold])
    losses = [(-np.log(_softmax(raw / t)[np.arange(len(raw)), truth] + 1e-12).mean(), t) for t in np.geomspace(0.05, 10, 60)]
    temperature = min(losses)[1]
    chance = _softmax(raw / temperature)
    right = chance.argmax(axis=1) == truth
    limit = float(np.quantile(chance.max(axis=1)[right], REJECTED_SHARE)) if right.any() else 0.0
    return LanguageModel(
        languages, (table / temperature).astype(np.float32), (bias / temperature).astype(np.float32), min(limit, HIGHEST_REJECTION)
    )


def scores(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Probabilities, one row for each text and one column for each language."""
    gap = b" " * (max(RUNS) - 1)  # so that no run reaches into the next text
    blobs = [prepared(t) for t in texts]
    sizes = np.array([len(b) for b in blobs])
    ends = np.cumsum(sizes + len(gap)) - len(gap)
    bounds = np.stack((ends - sizes, ends), axis=1).ravel()
    data = np.frombuffer(b"".join(b + gap for b in blobs), dtype=np.uint8)
    total = np.zeros((len(texts), len(model.languages)))
    for found in buckets(data):
        for lang in range(len(model.languages)):
            total[:, lang] += np.add.reduceat(model.table[:, lang][found], bounds, dtype=np.float64)[::2]
    mean = total / (sizes[:, None] * len(RUNS))
    return _softmax(mean + model.bias)


def _example_rows(batches):
    for batch in batches:
        for a, b, texts in text_slices(batch):
            seeds = batch.column("seed").slice(a, b - a).to_pylist()
            made = [examples(t, s) if has_letter(t) else [] for t, s in zip(texts, seeds)]
            rows = pa.array(np.repeat(np.arange(a, b), [len(m) for m in made]))
            flat = [e for m in made for e in m]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(rows), batch.column("place").take(rows), batch.column("seed").take(rows),
                    pa.array([ids.tobytes() for ids, _ in flat], pa.binary()),
                    pa.array([counts.tobytes() for _, counts in flat], pa.binary()),
                ],
                names=["lang", "place", "seed", "ids", "counts"],
            )


def fit(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on at most `rows` rows for each language among those where usable holds and lang isn't null."""
    limit_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    usable = usable & F.col("lang").isNotNull()
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 1)
    # A row for each language; hashes up to the bound are of about three times as many rows as are taken.
    bounds = docs.where(usable).groupBy("lang").agg((F.least(F.lit(1.0), F.lit(3.0 * rows) / F.count("*")) * float(1 << 63)).alias("bound"))
    ranked = docs.where(usable & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", h.alias("h"))
    ranked = ranked.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("bound")).drop("bound")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).select("doc_id", "lang", "place")
    seed = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 31))
    sample = (
        docs.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])  # at most `rows` for each language
        .select("text", "lang", "place", seed.alias("seed"))
        .mapInArrow(_example_rows, "lang string, place int, seed long, ids binary, counts binary")
        .orderBy("place", "seed", "lang", "ids", "counts").limit(MOST_EXAMPLES)
    )
    kind = lambda r: np.uint16 if len(r.counts) == len(r.ids) else np.uint32
    return train([
        ([(np.frombuffer(r.ids, np.uint16), np.frombuffer(r.counts, kind(r)))], r.lang, r.place % 5 == 0) for r in sample.collect()
    ])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected."""
    limit_batches(docs.sparkSession)
    schema = docs.schema
    names = [f"{i}" for i in range(len(schema))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    out = plain.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_rejected"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lettered, pred, score = np.zeros(n, dtype=bool), [UNKNOWN] * n, np.zeros(n)
            for a, b, texts in text_slices(batch, name=text):
                rows = [i for i in range(a, b) if model.languages and has_letter(texts[i - a])]
                if rows:
                    lettered[rows] = True
                    chance = scores(model, [texts[i - a] for i in rows])
                    score[rows] = chance.max(axis=1)
                    for i, k in zip(rows, chance.argmax(axis=1).tolist()):
                        pred[i] = model.languages[k]
            rejected = (score < model.reject_below) | ~lettered
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*names, "lang_pred", "lang_score", "lang_rejected"],
            )

    taken = ["lang_pred", "lang_score", "lang_rejected"]
    return plain.mapInArrow(run, out.schema).toDF(*docs.columns, *taken)


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def learnable() -> Column:
    return F.coalesce(part_of(F.col("doc_id"), 5) != 0, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified and not rejected; columns as they are."""
    model = fit(docs, learnable())
    names = [f"c{i}" for i in range(len(docs.columns))]  # docs may have columns of the added names
    found = identify(docs, model).toDF(*names, "pred", "score", "rejected")
    return found.where("not rejected").select(*names).toDF(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, learnable())
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learnable()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )
