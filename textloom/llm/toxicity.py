"""Toxic passages: maximum-scoring segments of token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _IS_SPACE, chunks, fold_of, giving_back, hash_spans, materialize, split_table, text_bytes, unique_by_text, word_spans

MIN_Z = 3.0
MIN_DOCUMENTS = 5  # toxic documents that a word of the lexicon is in, at least
PRIOR_SHARE = 0.1  # weight of the Dirichlet prior (corpus proportions), as a share of all counts
SAMPLE = 20_000  # labelled training documents, by hash order, on which the final logistic is fitted

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words (A-Z lower-cased, ASCII punctuation at both ends dropped), bounds, and byte spans."""
    raw, bounds = text_bytes(texts)
    starts, stops, at = word_spans(raw, bounds)
    inner = ~_PUNCTUATION[raw] & ~_IS_SPACE[raw]
    place = np.flatnonzero(inner)
    if len(place):
        low = np.searchsorted(place, starts)
        high = np.searchsorted(place, stops)
        has = low < high
        starts = np.where(has, place[np.minimum(low, len(place) - 1)], starts)
        stops = np.where(has, place[np.maximum(high, 1) - 1] + 1, stops)
    return hash_spans(raw, starts, stops), at, starts, stops, bounds


@dataclass(frozen=True)
class ToxicModel:
    """words: sorted hashes; weights: their log-odds; drift: the score of any other word; lam, k: of the background's
    maximal segment scores; bias, slope, many: the final logistic over calibrated passages."""

    words: np.ndarray
    weights: np.ndarray
    drift: float
    lam: float
    k: float
    bias: float = 0.0
    slope: float = 1.0
    many: float = 0.0


def word_table(docs: DataFrame) -> DataFrame:
    """(word, toxic, n): in how many labelled documents (text, toxic) a word is, pre-aggregated in each Arrow batch."""

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            hashes, at, *_ = _tokens(batch.column(0))
            hashes, at = unique_by_text(hashes, at)
            own = np.repeat(toxic, np.diff(at))
            for label in (0, 1):
                word, n = np.unique(hashes[own == label], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), label, np.int32)), pa.array(n.astype(np.int64))], names=["word", "toxic", "n"])

    return docs.select("text", F.col("toxic").cast("int")).mapInArrow(giving_back(run), "word long, toxic int, n long")


def _karlin(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1 under the background."""
    low, high = 1e-9, 1.0
    over = lambda x: float(np.sum(chances * np.expm1(np.minimum(x * scores, 700)))) > 0
    while not over(high) and high < 1e6:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return (low + high) / 2


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, by the stack of candidate segments.

    Each candidate keeps a link to the last one before it whose left sum is smaller:
    the search for a partner follows links and never looks at a candidate twice.
    ``scores`` may be sparse: the caller passes runs, see ``_passages``.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before = total
        total += s
        if s <= 0:
            continue
        start, left, j = i, before, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, i, left, total, j))
                break
            start, left, link = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = link
    return [(a, b + 1, right - left) for a, b, left, right, _ in stack]


def _passages(weights: np.ndarray, hits: np.ndarray, n: int, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments over n words of which only ``hits`` differ from ``drift``; time is linear in the hits."""
    run: list[float] = []
    where: list[int] = []
    last = -1
    for h, w in zip(hits.tolist(), weights.tolist()):
        if h - last > 1:
            run.append(drift * (h - last - 1))
            where.append(last + 1)
        run.append(w)
        where.append(h)
        last = h
    return [(where[a], where[b - 1] + 1, s) for a, b, s in segments(np.array(run))]


def _features(model: ToxicModel, passages: list[tuple[int, int, float]], n: int) -> tuple[float, float, int]:
    """The best passage's score in nats above what a text of n words reaches by chance, the sum over significant ones, their count."""
    if not passages:
        return -math.log(model.k * max(n, 1) + 1), 0.0, 0
    level = math.log(model.k * max(n, 1) + 1)
    over = [model.lam * s - level for _, _, s in passages]
    good = [x for x in over if x > 0]
    return max(over), sum(good), len(good)


def scan(docs: DataFrame, model: ToxicModel, keep: list[str] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, top, best, total, passages (byte spans in the UTF-8 text, calibrated score) of each document.

    ``top`` is the score of the best passage in nats, ``best`` the same above what a text of this length reaches by chance.

    Columns in ``keep`` (and the text, if asked for) pass through, even under the names above.
    """
    names = ["doc_id", *keep, *(["text"] if with_text else [])]
    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in names)).schema)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, at, starts, stops, bounds = _tokens(part.column("text").cast(pa.string()))
                place = np.searchsorted(model.words, hashes)
                place[place == len(model.words)] = 0
                hit = np.flatnonzero(model.words[place] == hashes) if len(model.words) else np.zeros(0, np.int64)
                cut = np.searchsorted(hit, at)
                top, best, total, spans = [], [], [], []
                for i in range(part.num_rows):
                    n = int(at[i + 1] - at[i])
                    own = hit[cut[i] : cut[i + 1]]
                    found = _passages(model.weights[place[own]], own - at[i], n, model.drift) if len(own) else []
                    b, t, _ = _features(model, found, n)
                    level = math.log(model.k * max(n, 1) + 1)
                    top.append(model.lam * max((x[2] for x in found), default=0.0))
                    best.append(b)
                    total.append(t)
                    spans.append([{"from": int(starts[at[i] + a] - bounds[i]), "to": int(stops[at[i] + z - 1] - bounds[i]), "score": model.lam * s - level} for a, z, s in found if model.lam * s > level])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), pa.array(np.diff(at)), pa.array(top, pa.float64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())])))],
                    names=[*names, "n_words", "top", "best", "total", "passages"],
                )

    rows = docs.select(*(F.col(f"`{c}`") for c in names), *([] if with_text else ["text"]))
    return rows.mapInArrow(giving_back(run), f"{kept}, n_words long, top double, best double, total double, passages array<struct<from:long,to:long,score:double>>")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learn from labelled documents (doc_id, text) x (doc_id, toxic); rows without label or id teach nothing.

    Word counts cover all of these documents, each distinct text once, and each word
    once a text, so that copies and repetitions prove nothing.  A word's weight is the log-odds ratio
    of its two class frequencies, each with pseudo-counts in the proportions of both
    classes together (PRIOR_SHARE); all words whose z-score reaches MIN_Z enter the
    lexicon, with 16 bytes each: at most one for MIN_DOCUMENTS toxic (document, word) pairs.  Any other word scores ``drift``.
    The extreme-value constants come from the background: ``lam`` from the word chances, ``k`` from the scores of all texts that are not toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    prints = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2")).join(known, "doc_id")
    once = materialize(prints.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "toxic")).alias("x")).select("x.doc_id", "x.toxic"), "labelled")
    rows = texts.join(once.hint("merge"), "doc_id")  # one plan for any size: labels grow with the corpus
    counts = word_table(rows).groupBy("word").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("o"))
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    nt, no = float(total["t"] or 0), float(total["o"] or 0)
    if not nt or not no:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0, -4.0, 0.0)
    mass = PRIOR_SHARE * (nt + no)
    prior = F.lit(PRIOR_SHARE) * (F.col("t") + F.col("o"))
    yt, yo = F.col("t") + prior, F.col("o") + prior
    delta = F.log(yt / (nt + mass - yt)) - F.log(yo / (no + mass - yo))
    scored = counts.select("word", "t", "o", delta.alias("delta"), (delta / F.sqrt(1 / yt + 1 / yo)).alias("z"))
    lexicon = scored.where((F.col("z") >= MIN_Z) & (F.col("t") >= MIN_DOCUMENTS)).select("word", "t", "o", "delta").collect()
    lexicon.sort(key=lambda r: r["word"] & 0xFFFFFFFFFFFFFFFF)
    words = np.array([r["word"] for r in lexicon], np.int64).view(np.uint64)
    weights = np.array([r["delta"] for r in lexicon], np.float64)
    if not len(words):
        return ToxicModel(words, weights, -1.0, 1.0, 1.0, -4.0, 0.0)
    share = np.array([r["o"] for r in lexicon], np.float64)
    chances = np.append((share + 0.5) / (no + len(words)), 0.0)
    chances[-1] = 1 - chances[:-1].sum()
    in_toxic = min(0.5, float(sum(r["t"] for r in lexicon)) / nt)
    drift = min(-0.05, math.log((1 - in_toxic) / max(1e-6, chances[-1])), -1.2 * float(np.sum(chances[:-1] * weights)) / chances[-1])
    lam = _karlin(np.append(weights, drift), chances)
    model = ToxicModel(words, weights, drift, lam, _extreme_k(scan(rows.where("toxic = 0"), ToxicModel(words, weights, drift, lam, 1.0))))
    sample = once.withColumn("order", F.xxhash64("doc_id", F.lit(8))).orderBy("order", "doc_id").limit(SAMPLE).select("doc_id", "toxic")
    feats = scan(texts.join(F.broadcast(sample), "doc_id"), model, ["toxic"]).select("best", "total", "toxic").collect()
    bias, slope, many = _logistic(np.array([[_squash(f["best"]), math.log1p(f["total"])] for f in feats]), np.array([f["toxic"] for f in feats], float))
    return ToxicModel(words, weights, drift, lam, model.k, bias, slope, many)


def _extreme_k(background: DataFrame) -> float:
    """The extreme-value constant that makes the best passages of all ``background`` texts likeliest.

    P(top >= x) = 1 - exp(-k n exp(-x)); texts without a passage only tell that their top is not above 0.
    """
    found = background.agg(F.count_if(F.col("top") > 0).alias("reached"), F.sum(F.col("n_words") * F.exp(-F.col("top"))).alias("mass")).first()
    return (found["reached"] + 0.5) / ((found["mass"] or 0.0) + 1.0)


def _squash(best: float) -> float:
    """P(no background text of this length reaches such a passage): the extreme-value distribution of the best one."""
    return math.exp(-math.exp(-max(-30.0, min(30.0, best))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    if not len(y):
        return -4.0, 0.0, 0.0
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def score_column(model: ToxicModel):
    """The probability from ``best`` and ``total``, as a Spark expression."""
    chance = F.exp(-F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("best")))))
    z = F.lit(model.bias) + F.lit(model.slope) * chance + F.lit(model.many) * F.log1p("total")
    return 1 / (1 + F.exp(-z))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and passages of every row of ``docs``.

    Learns from labelled rows outside the held-out third.  Null or empty texts have
    no passage and get the score of a text without one.  Rows without doc_id are
    scored, and count as not held out.  Repeated rows are scored alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held), labels)
    spread = split_table(docs, docs.sparkSession.sparkContext.defaultParallelism)
    out = scan(spread, model).withColumn("score", score_column(model)).withColumn("held_out", held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_words", "passages")
