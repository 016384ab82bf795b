"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _IS_SPACE, chunks, fold_of, giving_back, hash_spans, materialize, mix64, split_table, text_bytes, word_spans

ROWS = 1 << 14  # word vectors: a word's hash chooses its row
SHAPES = 34 << 7  # vectors of shapes, one each, after those of words
DIM = 64
NONZERO = 4  # entries of +1 or -1 in an index vector
REACH = 2  # words on either side that are a word's context
SAMPLE = 20_000  # labelled training documents, by hash order, on which the model is fitted
HIDDEN = 32
EPOCHS = 60

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = ~_LETTER & ~_DIGIT & ~_IS_SPACE & (_BYTES > 32)
_MARK_NUMBER = np.where(_MARK, np.cumsum(_MARK), 0).astype(np.uint64)  # 1 to 33; 0: not a mark


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of two symbols a word, its lower-case hash and its shape, and the bounds of each text's words.

    A shape has whether the word begins with a capital, has further ones, digits or
    inner marks, its last byte if that is a mark, and whether it repeats one of the
    two words before it.
    """
    raw, bounds = text_bytes(texts)
    starts, stops, at = word_spans(raw, bounds)
    if not len(starts):
        return np.zeros((0, 2), np.int64), at
    word = hash_spans(raw, starts, stops)
    count = lambda table: np.diff(np.append(0, np.cumsum(table[raw]))[np.stack([starts, stops])], axis=0)[0]
    upper, digit, mark = count(_UPPER), count(_DIGIT), count(_MARK)
    shape = _UPPER[raw[starts]].astype(np.uint64)
    shape |= (upper > 1).astype(np.uint64) << np.uint64(1)
    shape |= (digit > 0).astype(np.uint64) << np.uint64(2)
    shape |= np.minimum(mark, 3).astype(np.uint64) << np.uint64(3)
    again, own = np.zeros(len(word), bool), np.repeat(np.arange(len(at) - 1), np.diff(at))
    for k in (1, 2):
        again[k:] |= (word[k:] == word[:-k]) & (own[k:] == own[:-k])
    shape |= again.astype(np.uint64) << np.uint64(6)
    shape |= _MARK_NUMBER[raw[stops - 1]] << np.uint64(7)
    return np.stack([word % np.uint64(ROWS), np.uint64(ROWS) + shape], axis=1).astype(np.int64), at


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each row, fixed by its number."""
    out = np.zeros((ROWS + SHAPES, DIM), np.int8)
    rows = np.arange(ROWS + SHAPES, dtype=np.uint64)
    for k in range(NONZERO):
        h = mix64(rows * np.uint64(NONZERO) + np.uint64(k + 1))
        out[np.arange(len(rows)), (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def context_sums(docs: DataFrame) -> np.ndarray:
    """For each row, the sum of the index vectors around its words, over all of ``docs`` (text)."""

    def run(batches):
        index, sums = index_vectors(), np.zeros((ROWS + SHAPES, DIM), np.int64)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                rows, at = _symbols(part.column("text"))
                if not len(rows):
                    continue
                # REACH empty places after each text, so that no context goes over its end; all sums fit a byte
                place = np.arange(len(rows)) + REACH * (1 + np.repeat(np.arange(len(at) - 1), np.diff(at)))
                both = np.zeros((place[-1] + REACH + 1, DIM), np.int8)
                both[place] = index[rows[:, 0]] + index[rows[:, 1]]
                around = np.zeros((len(rows), DIM), np.int8)
                for k in range(1, REACH + 1):
                    around += both[place - k]
                    around += both[place + k]
                for column in (0, 1):
                    own = rows[:, column].astype(np.uint16)
                    order = np.argsort(own, kind="stable")
                    ids, first = np.unique(own[order], return_index=True)
                    sums[ids] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
        for block in range(0, len(sums), 1024):
            if sums[block : block + 1024].any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums[block : block + 1024].tobytes()], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros((ROWS + SHAPES, DIM))
    found = docs.select("text").mapInArrow(giving_back(run), "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
    for row in found.toLocalIterator():  # one row a block of vectors
        part = np.frombuffer(row["sums"], np.int64).reshape(-1, DIM)
        total[row["block"] : row["block"] + len(part)] += part
    return total


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = _forward((x - self.mean) / self.scale, self.w1, self.b1, self.w2, self.b2)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Means of the word and of the shape vectors of each text, and two measures of its length."""
    rows, at = _symbols(texts)
    n = np.diff(at)
    out = np.zeros((len(n), 2 * DIM + 2))
    live = np.flatnonzero(n)
    if len(live):
        for column in (0, 1):
            sums = np.add.reduceat(vectors[rows[:, column]], at[:-1][live], axis=0)
            out[live, column * DIM : (column + 1) * DIM] = sums / n[live, None]
    out[:, -2] = np.log1p(n)
    out[:, -1] = n < 10
    return out


def _forward(x, w1, b1, w2, b2):
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> QualityModel:
    """Two layers by Adam on four fifths of the rows; the temperature by least log loss on the others."""
    rng = np.random.default_rng(seed)
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return QualityModel(vectors, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z, t = (x - mean) / scale, y.astype(float)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), 128):
            rows = shuffled[at : at + 128]
            hidden, logit = _forward(z[rows], *params)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - t[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-3 * params[0], back.sum(0), hidden.T @ error + 1e-3 * params[2], error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 2e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = _forward(z[held], *params)[1]
    loss = lambda k: float(np.mean(np.logaddexp(0, -np.where(t[held] > 0, 1, -1) * logits / k)))
    temperature = min(np.exp(np.linspace(np.log(0.5), np.log(8), 61)), key=loss) if len(held) else 1.0
    return QualityModel(vectors.astype(np.float32), mean, scale, *params[:3], float(params[3][0]), float(temperature))


def _with_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                x = pooled(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    return docs.select("text", "quality").mapInArrow(run, "quality int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled documents (doc_id, text) x (doc_id, quality), chosen by a hash of doc_id.

    The word vectors are summed over all rows of ``docs``, labelled or not.  Rows without id or label teach the network nothing.  With labels of one class only the
    model gives every text that class's smoothed share.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id")
    ids = ids.withColumn("order", F.xxhash64("doc_id", F.lit(5))).orderBy("order", "doc_id").limit(sample).select("doc_id", "quality")
    rows = materialize(docs.join(materialize(ids, "sample-ids"), "doc_id").select("text", "quality").repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    sums = context_sums(split_table(docs, docs.sparkSession.sparkContext.defaultParallelism))
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    found = _with_features(rows, vectors).collect()
    x = np.array([r["x"] for r in found]).reshape(-1, 2 * DIM + 2)
    return train(x, np.array([r["quality"] for r in found], int), vectors)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Learns from rows outside the held-out quarter: word vectors from all, the network from labelled ones.  Null and empty texts
    pool to zeros and are scored by that.  Rows without doc_id are scored and count
    as not held out; repeated rows are scored alike.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held), labels)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.probability(pooled(part.column("text"), model.vectors)))], names=["doc_id", "score"])

    spread = split_table(docs, docs.sparkSession.sparkContext.defaultParallelism)
    scored = spread.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
