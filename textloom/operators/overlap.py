"""Duplicates and overlap: equal bytes, shingle sketches, candidates, coverage, alignment runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.functions.text import fold
from textloom.plans.tasks import MOST_ROWS, spread

WIDTH, MODULUS, GENERIC = 32, 32, 12
MOST_PLACES = 24


def identical_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with equal bytes: (content_hash, members); empty texts are never grouped."""
    hashed = docs.where(F.length(text) > 0).select(key, F.sha2(F.col(text), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.sort_array(F.collect_list(key)).alias("members")).where(F.size("members") > 1)


def copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each document with its group's first member and size: all that equal bytes link, without pairs."""
    hashed = docs.where(F.length(text) > 0).select(key, F.sha2(F.col(text), 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min(key).alias("first"), F.count("*").alias("members")).where("members > 1")
    return hashed.join(groups, "content_hash").select(key, "first", "members")


def taken(n: int, derive, most: int = MOST_ROWS):
    """(i, what ``derive`` gives for i) of i below n, in lists whose first arrays have about ``most`` values in all."""
    group, held = [], 0
    for i in range(n):
        group.append((i, derive(i)))
        held += len(group[-1][1][0])
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def shingles(docs: DataFrame, key: str, text: str, width: int = WIDTH, modulus: int = 1) -> DataFrame:
    """(key, at, hash) of every folded window at stride 1 whose hash ``modulus`` divides (see ``folding.shingles``; the hash as a signed number).

    Bodies are folded in the JVM; windows are hashed together, a body at a time, and handed on by MOST_ROWS or a body.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in taken(batch.num_rows, lambda i, batch=batch: hashed(batch.column(1)[i].as_py())):
                rows = np.repeat([i for i, _ in group], [len(at) for _, (at, _) in group])
                places, values = (np.concatenate([x[k] for _, x in group]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places), pa.array(values)], names=[key, "at", "hash"])

    def hashed(body):
        found = folding.shingles(np.frombuffer(body.encode("utf-32-le"), "<u4"), width)
        at = np.flatnonzero(found % np.uint64(modulus) == 0) if modulus > 1 else np.arange(len(found))
        return at.astype(np.int32), found[at].view(np.int64)

    folded = spread(docs.select(key, text)).select(key, fold(F.col(text)).alias("body")).where(F.length("body") >= width)
    return folded.mapInArrow(run, f"{key} {kind}, at int, hash long")


def sketch(shingled: DataFrame, key: str, modulus: int = MODULUS) -> DataFrame:
    """The consistent sample of distinct shingles: hash & (modulus - 1) = 0 for a power of two."""
    if modulus & (modulus - 1):
        raise ValueError("the modulus must be a power of two")
    return shingled.where(F.col("hash").bitwiseAND(modulus - 1) == 0).select(key, "hash").distinct()


def sketch_facts(docs: DataFrame, key: str, text: str, width: int = WIDTH, modulus: int = MODULUS) -> DataFrame:
    """(key, total, sampled): distinct shingles of each text that has one, and those that a sketch keeps, counted where the text is."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.array([counted(body.as_py()) for body in batch.column(1)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[key, "total", "sampled"])

    def counted(body):
        """One text's: its hashes are not kept."""
        found = folding.shingles(np.frombuffer(body.encode("utf-32-le"), "<u4"), width)
        return folding.kinds(found), folding.kinds(found[found % np.uint64(modulus) == 0])

    folded = spread(docs.select(key, text)).select(key, fold(F.col(text)).alias("body")).where(F.length("body") >= width)
    return folded.mapInArrow(run, f"{key} {kind}, total long, sampled long")


def generic(sketched: DataFrame, key: str, cutoff: int = GENERIC) -> DataFrame:
    return sketched.groupBy("hash").agg(F.count("*").alias("df")).where(F.col("df") >= cutoff)


def masks(shingled: DataFrame, key: str, generic: DataFrame, width: int = WIDTH, slack: int = MODULUS, length: DataFrame | None = None) -> DataFrame:
    """(key, lo, hi): the merged stretches of a folded body under generic shingles, each widened by ``slack`` inside the body.

    ``length`` (key, length) of the bodies is needed where ``shingled`` has only those that a sketch keeps.
    """
    length = shingled.groupBy(key).agg((F.max("at") + width).alias("length")) if length is None else length
    hits = shingled.join(generic.select("hash"), "hash", "left_semi").join(length, key)
    hits = hits.select(key, F.greatest(F.col("at") - slack, F.lit(0)).alias("lo"), F.least(F.col("at") + width + slack, "length").alias("hi"))
    return merged(hits, key, "lo", "hi")


def merged(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Intervals that touch or overlap, as one."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    reached = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.coalesce((F.col(lo) > reached).cast("int"), F.lit(1)))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def candidates(probe: DataFrame, index: DataFrame, cutoff: int = GENERIC, shared: int = 3) -> DataFrame:
    """(a, b, shared): documents that share sampled shingles; shingles of ``cutoff`` documents or more are left out, so no list is long."""
    usual = index.join(generic(index, "b", cutoff).select("hash"), "hash", "left_anti")
    return probe.join(usual, "hash").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)


def similarity(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard and both containments over distinct shingles of the given pairs."""
    sizes = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias(f"n_{key}"))
    common = pairs.select("a", "b").join(a, "a").join(b, ["b", "hash"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    met = common.join(sizes(a, "a"), "a").join(sizes(b, "b"), "b")
    return met.select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"), (F.col("common") / F.col("n_a")).alias("a_in_b"), (F.col("common") / F.col("n_b")).alias("b_in_a"))


def seeds(a: DataFrame, b: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """(a, at_a, b, at_b) of equal windows; one with more than ``most`` places in a text of side b anchors nothing there."""
    near = b.join(a.select("hash").distinct(), "hash", "left_semi")
    places = F.count("*").over(Window.partitionBy("b", "hash"))
    usual = near.withColumn("n", places).where(F.col("n") <= most).drop("n")
    return a.withColumnRenamed("at", "at_a").join(usual.withColumnRenamed("at", "at_b"), "hash").select("a", "at_a", "b", "at_b")


def runs(seeds: DataFrame, width: int = WIDTH, least: int = 40) -> DataFrame:
    """Matching runs of pairs (a, b) from seeds (at_a, at_b): seeds of one diagonal not over ``width`` apart are one run."""
    diagonal = seeds.select("a", "b", "at_a", "at_b", (F.col("at_b") - F.col("at_a")).alias("delta"))
    order = Window.partitionBy("a", "b", "delta").orderBy("at_a")
    new = (F.col("at_a") - F.lag("at_a").over(order) > width).cast("int")
    island = diagonal.withColumn("island", F.sum(F.coalesce(new, F.lit(1))).over(order))
    out = island.groupBy("a", "b", "delta", "island").agg(F.min("at_a").alias("from_a"), (F.max("at_a") + width).alias("to_a"))
    return out.where(F.col("to_a") - F.col("from_a") >= least).select("a", "b", "from_a", "to_a", (F.col("from_a") + F.col("delta")).alias("from_b"), (F.col("to_a") + F.col("delta")).alias("to_b"))


def union_length(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Length of the union of each key's intervals, by the furthest end before each one."""
    order = Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(hi).over(order), F.col(lo))
    added = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), reached))
    return intervals.select(key, added.alias("added")).groupBy(key).agg(F.sum("added").alias("covered"))
