"""Lempel-Ziv phrase fingerprints: the phrases of an incremental parse, hashed, compared by minimum-hash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mix64

SIZE = 128
_SALTS = (mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ODD, _ADD = _SALTS[:SIZE] | np.uint32(1), _SALTS[SIZE:]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def parse(text: str, known: set[str], start: int, ends: list[int], stop: int | None = None) -> int:
    """Go on with a Lempel-Ziv (1978) parse of ``text`` from ``start``; returns where the last phrase begins.

    A phrase is the longest known one and one character more, and becomes known.
    Every prefix of a known phrase is known, so the longest is sought from three
    characters up or down.  With ``stop``, only phrases that end there at the latest
    are taken.  The text's last phrase may be one that is known already.
    """
    n = len(text) if stop is None else stop
    add, append = known.add, ends.append
    at = start
    while at < n:
        end = at + 3
        if text[at:end] in known:
            end += 1
            while end <= n and text[at:end] in known:
                end += 1
        elif text[at : at + 2] in known:
            pass
        elif text[at : at + 1] in known:
            end = at + 2
        else:
            end = at + 1
        if end > n:
            if stop is not None:
                break
            end = n
        add(text[at:end])
        append(end)
        at = end
    return at


def _sums(text: str) -> np.ndarray:
    """Prefix sums of a polynomial over the code points: any span's hash is a difference."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                full = np.full(max(n + 1, 1 << 15), base)
                full[0] = 1
                _powers[k] = np.multiply.accumulate(full)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(points + np.uint64(77)) * _powers[0][:n], out=out[1:])
    return out


def _phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    if not ends:
        return np.zeros(0, np.uint32)
    stops = np.array(ends)
    starts = np.append(0, stops[:-1])
    sums = _sums(text)
    with np.errstate(over="ignore"):
        spans = mix64((sums[stops] - sums[starts]) * _powers[1][starts] + (stops - starts).astype(np.uint64))
    return (spans >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SIZE minima over the phrases; an empty text has none and keeps the largest number everywhere."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            part = hashes[at : at + 2048, None] * _ODD[None, :] + _ADD[None, :]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x846CA68B)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def likeness(a: np.ndarray, b: np.ndarray, empty: tuple[bool, bool]) -> float:
    """Share of equal minima; an empty text is like another empty one only."""
    if any(empty):
        return float(all(empty))
    return float(np.count_nonzero(a == b)) / SIZE


def fingerprints(text: str, edited: str | None = None, shared: int = 0) -> list[np.ndarray]:
    """The signature of ``text``, and that of ``edited``, which has the same first ``shared`` characters.

    The parse of the shared part is done once: both go on from its last whole phrase.
    """
    ends: list[int] = []
    known: set[str] = set()
    if edited is None:
        parse(text, known, 0, ends)
        return [signature(_phrase_hashes(text, ends))]
    at = parse(text, known, 0, ends, shared)
    head, after = ends.copy(), len(ends)
    common = known.copy()
    parse(text, known, at, ends)
    own = _phrase_hashes(text, ends)
    parse(edited, common, at, head)
    other = _phrase_hashes(edited, head)
    first = signature(own[:after])
    return [np.minimum(first, signature(own[after:])), np.minimum(first, signature(other[after:]))]


def _hex(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches):
    """Rows (range, halo, doc_id, text) in order: each meets the next one of its range; a halo row only serves the last.

    ``near_next`` waits for the next row's signature; at the end of a batch it is
    made for that row ahead of its turn, so no row waits across batches.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting, where = None, None
    for batch in batches:
        out: list[list] = []
        open_row = None  # the last row made, its signature and text

        def close(sign: np.ndarray, text: str) -> None:
            if open_row is not None:
                row, own, before = open_row
                row[6] = likeness(own, sign, (not before, not text))

        for place, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if place != where:
                waiting, where = None, place
            if waiting is not None:
                own_id, own = waiting
                cut = len(own) // 3
                edited = own[: len(own) - cut] + text[:cut]
                sign, changed = fingerprints(own, edited, len(own) - cut)
                close(sign, own)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append([own_id, len(own), digest, _hex(sign), _hex(changed), likeness(sign, changed, (not own, not edited)), None])
                open_row = (out[-1], sign, own)
                if halo:
                    close(fingerprints(text)[0], text)
                    open_row = None
            waiting = None if halo else (doc_id, text)
        if waiting is not None:
            close(fingerprints(waiting[1])[0], waiting[1])
        columns = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


RANGE_CHARS = 4_000_000
MOST_RANGES = 16_384
SUBRANGES = 1 << 20


def _ranges(rows: DataFrame, n: int, alone: list[int]):
    """The number of a row's doc_id range as an expression; 0 has the largest ids, and null ids come last.  Ids in ``alone`` are ranges of their own."""
    found = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    marks = sorted({*(found or []), *alone, *(i + 1 for i in alone if i < 2**63 - 1)}, reverse=True)
    groups = [marks[i : i + 128] for i in range(0, len(marks), 128)]
    if not groups:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    above = lambda values: F.size(F.filter(values, lambda m: m > F.col("doc_id")))
    coarse = above(F.array(*(F.lit(g[0]) for g in groups)))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(coarse, F.lit(1)))
    fine = F.when(coarse > 0, (coarse - 1) * 128 + above(inner)).otherwise(0)
    return F.when(F.col("doc_id").isNull(), len(marks) + 1).otherwise(fine)


def _placed(rows: DataFrame, chars: int) -> DataFrame:
    """``rows`` with ``tie`` (a hash of the text) and ``place``: its range of ids, and of ties where one id has more than a range holds."""
    ranged = rows.withColumn("tie", F.xxhash64("text"))
    most = max(2 * RANGE_CHARS, chars // MOST_RANGES)  # so there are MOST_RANGES such ids at most
    large = rows.groupBy("doc_id").agg(F.sum(F.length("text").cast("long")).alias("c")).where(F.col("c") > most).collect()
    place = _ranges(rows, max(1, min(MOST_RANGES, chars // RANGE_CHARS)), [r["doc_id"] for r in large if r["doc_id"] is not None])
    if not large:
        return ranged.withColumn("place", place.cast("long") * SUBRANGES)
    each = max(RANGE_CHARS, chars // MOST_RANGES)
    split = rows.sparkSession.createDataFrame([(r["doc_id"], min(SUBRANGES, -(-r["c"] // each))) for r in large], "large long, parts int")
    part = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * F.coalesce("parts", F.lit(1)))
    met = ranged.join(F.broadcast(split), F.col("doc_id").eqNullSafe(F.col("large")) & F.col("parts").isNotNull(), "left")
    return met.withColumn("place", place.cast("long") * SUBRANGES + F.least(part, F.coalesce("parts", F.lit(1)) - 1)).drop("large", "parts")


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is the one with the next smaller doc_id (after the last, the
    first); rows with equal doc_id follow each other by a hash of the text, rows
    without one come last.  A lone row is its own next.  Null texts are empty; an
    empty table gives an empty result.  Other columns are ignored.

    The ids are cut into ranges of about RANGE_CHARS characters; rows of one id (or of
    none) beyond that are cut by the hash of their text.  Each range also
    gets its follower's first row, so texts are shuffled once, and a task streams
    through sorted ranges with two texts in memory.  What reaches the driver is one
    row a range, of which there are about 2 * MOST_RANGES at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    ranged = _placed(rows, facts["chars"])
    first = ranged.groupBy("place").agg(F.min(F.struct(-F.col("doc_id").cast("decimal(20,0)"), F.col("tie"))).alias("first"), F.max("doc_id").alias("head"))
    heads = sorted((r["place"], r["head"], r["first"]["tie"]) for r in first.collect())
    mapped = spark.createDataFrame([(place, head, tie, heads[i - 1][0]) for i, (place, head, tie) in enumerate(heads)], "place long, head long, head_tie long, before long")
    halo = ranged.join(F.broadcast(mapped), "place").where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    halo = halo.select(F.col("before").alias("place"), F.lit(True).alias("halo"), "doc_id", "text", "tie")
    both = ranged.select("place", F.lit(False).alias("halo"), "doc_id", "text", "tie").unionByName(halo)
    tasks = max(spark.sparkContext.defaultParallelism, len(heads) // 2)
    dealt = both.repartition(tasks, "place").sortWithinPartitions("place", "halo", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.select("place", "halo", "doc_id", "text").mapInArrow(_stream, RESULT)
