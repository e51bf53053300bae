"""Language identification: averaged hashed subword embeddings with a linear softmax.

The embeddings and the softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (sample_rows, sample_bytes). As everything after the lookup is linear, a prediction adds up one row of class
scores for each hashed subword, so the trained model is one table of buckets x languages. A temperature and
a rejection threshold are calibrated on whole texts of rows of the sample that the training did not see.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, texts_of, with_columns

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
SAMPLE_ROWS, EPOCHS, RATE, BATCH = 4000, 4, 0.5, 32
#: Bytes of the pieces that a text is cut into for training, in turn, so that short texts are learned as well as long ones.
SNIPPETS = (60, 160, 640)
SAMPLE_BYTES, STRETCH = 32 << 20, 640  # bytes of the sample's texts, and characters of the stretches of texts that are cut down to them
CHUNK = 1 << 18  # bytes that are looked up at once
REJECT_RATE, REJECT_MOST = 0.001, 0.5
UNKNOWN = "und"

#: Lower case; ASCII digits, signs and control characters count as a space, so that subwords are of letters.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the byte n-gram at each position, one row an order; BUCKETS where it would leave its text."""
    folded, n = FOLD[data], len(data)
    out = np.full((len(ORDERS), n), BUCKETS, np.int32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    code = folded.copy()
    for i in range(1, max(ORDERS)):
        code = code[:-1] * np.uint32(0x01000193) + folded[i:] if len(code) > 1 else code[:0]
        if i + 1 in ORDERS and len(code):
            row = ((code * np.uint32(0x9E3779B1) + np.uint32(i)) >> np.uint32(16)).astype(np.int32)
            out[ORDERS.index(i + 1), : len(code)] = np.where(left[: len(code)] > i, row, BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS + 1, languages), the last row zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row a text. Bytes are looked up in chunks, so that a long text needs no more memory than a short one."""
        out, n = np.zeros((len(offsets) - 1, len(self.languages))), len(data)
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b))
            ends = np.clip(offsets[i : j + 1], a, min(n, b + max(ORDERS) - 1)) - a  # subwords may reach into the next chunk
            at = np.clip(offsets[i : j + 1], a, b) - a
            full = np.flatnonzero(np.diff(at))
            for row in subwords(data[a : a + ends[-1]], ends)[:, : b - a]:
                out[i + full] += np.add.reduceat(self.scores[row], at[full], axis=0, dtype=np.float64)
        size = np.diff(offsets)
        grams = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
        return out / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(1), p.max(1, initial=0)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(texts: list[str], languages: list[str], seed: int = 7) -> Model | None:
    """A model from labelled texts, a fifth of them kept for the calibration; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in languages])
    raw = [t.encode() for t in texts]
    order = rng.permutation(len(raw))
    held = set(order[: len(raw) // 5].tolist())
    grams, target, turn_of = [], [], []
    for i, t in enumerate(raw):
        at = k = 0
        while i not in held and (at < len(t) or not k):
            piece = t[at : at + SNIPPETS[k % len(SNIPPETS)]]
            g = subwords(np.frombuffer(piece, np.uint8), np.array([0, len(piece)])).ravel()
            grams.append(g[g < BUCKETS])
            target.append(label[i])
            turn_of.append(-1 if at == 0 else k % EPOCHS)
            at, k = at + len(piece) if piece else len(t), k + 1
    target, turn_of = np.array(target), np.array(turn_of)
    # A text's first piece is learned in each epoch, each other one in one of them: all of the text, long or short.
    turns = [np.flatnonzero((turn_of < 0) | (turn_of == e)) for e in range(EPOCHS)]
    emb = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = sum(max(1, -(-len(t) // BATCH)) for t in turns), 0
    for turn in map(rng.permutation, turns):
        for a in range(0, len(turn), BATCH):
            rate, rows = RATE * (1 - done / steps), [i for i in turn[a : a + BATCH] if len(grams[i])]
            done += 1
            if not rows:
                continue
            sizes = np.array([len(grams[i]) for i in rows])
            flat = np.concatenate([grams[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None]
            wrong = softmax(x @ soft + bias)
            wrong[np.arange(len(rows)), target[rows]] -= 1
            back = (wrong @ soft.T) / sizes[:, None]
            soft -= (rate / 4) * (x.T @ wrong)
            bias -= (rate / 40) * wrong.sum(0)
            hit, where = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(where, np.repeat(back[:, d], sizes), len(hit)) for d in range(DIM)], 1)
            emb[hit] -= (rate * 8) * step.astype(np.float32)
    emb[BUCKETS] = 0
    model = Model(names, (emb @ soft).astype(np.float32), bias.astype(np.float64))
    check = sorted(held) or list(range(len(raw)))
    logits, truth = model.logits(*packed([raw[i] for i in check])), label[check]
    # Smoothed targets: even without an error among n rows, a chance of about 1 in n is left for one.
    aim = np.full((len(truth), len(names)), 1 / (len(truth) + 2) / max(1, len(names) - 1))
    aim[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    loss = lambda t: -(aim * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(1).mean()
    model.temperature = float(min((0.05 * 1.25**k for k in range(24)), key=loss))
    p = softmax(logits / model.temperature)
    right = p.max(1)[p.argmax(1) == truth]
    model.threshold = float(min(REJECT_MOST, np.quantile(right, REJECT_RATE))) if len(right) else 0.0
    return model


def train(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fits on sample_rows labelled rows at most, those of the smallest hash of their key, of sample_bytes of text at most.

    The rows are counted first, so that each task sends only its share of hashes to the driver; no texts are sorted. Where the
    texts of the sample have more bytes together, each is cut down in its task to stretches spread over all of it, by
    its share of them. Rows that repeat key, text and language are learned once. Rows without a language or a letter are
    no use and left out; without any row there is no model (None).
    """
    usable = labelled.where(F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}"))
    n = usable.count()
    share = min(1.0, 2 * (sample_rows + 100) / max(n, 1))
    hashed = usable.select(F.col(text).alias("t"), F.col(language).alias("l"), F.xxhash64(key).alias("h"), F.xxhash64(text).alias("m")).where((F.col("h") / 2.0**63) <= 2 * share - 1)
    marks = hashed.select("h", "m").distinct().orderBy("h", "m").limit(sample_rows).collect()
    if not marks:
        return None
    last = marks[-1]
    chosen = hashed.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("m") <= last.m))).dropDuplicates(["h", "m", "l"])
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0]
    if total > sample_bytes:
        room = F.greatest(F.lit(STRETCH), F.floor(F.length("t") * (sample_bytes / total)))
        n = F.greatest(F.lit(1), F.floor(room / STRETCH)).cast("int")
        start = lambda i: (1 + F.floor(i * (F.length("t") - STRETCH) / F.greatest(n - 1, F.lit(1)))).cast("int")
        cut = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), start(i), F.lit(STRETCH))), " ")
        chosen = chosen.withColumn("t", F.when(F.length("t") > room, cut).otherwise(F.col("t")))
    rows = sorted(chosen.select("t", "l", "h").collect(), key=lambda r: (r.h, r.t))
    return fit([r.t for r in rows], [r.l for r in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; own columns of these names are replaced.

    A text that is null or without a letter has language und, score 0 and is rejected; so is every text if
    there was nothing to learn from. Other texts get the likeliest language and its calibrated probability,
    and are rejected where that is below the calibrated threshold. Only the text is looked at. Rows are
    neither joined nor reordered: repeated rows, null ids and empty tables need no care.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    if model is None:
        return docs.drop("lang_pred", "score", "rejected").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        model = shared.value
        names = np.array(model.languages, object)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            best, score = model.predict(*texts_of(batch.column(text)))
            return [pa.array(names[best], pa.string()), pa.array(score), pa.array(score < model.threshold)]

        return each

    out = with_columns(docs, fields, make)
    blank = F.col(text).isNull() | ~F.col(text).rlike(r"\p{L}")
    return out.withColumns({"lang_pred": F.when(blank, UNKNOWN).otherwise(F.col("lang_pred")), "score": F.when(blank, 0.0).otherwise(F.col("score")), "rejected": blank | F.col("rejected")})


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
