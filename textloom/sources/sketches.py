"""A store of sketches: sampled shingles of documents by recipe, probed by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.operators.overlap import GENERIC, candidates, generic, merged, taken
from textloom.plans.tasks import MOST_ROWS, spread
from textloom.sources.segmented import SegmentStore

FEW_HASHES = 4096  # of a probe, up to which the scan is told them


def recipe_name(width: int, modulus: int) -> str:
    """A folder's name for how sketches were made."""
    return f"w{width}-m{modulus}"


def sketched(body: np.ndarray, width: int, modulus: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """(number of distinct shingles, the sampled ones, each one's places in order) of a folded text."""
    hashes = folding.shingles(body, width)
    at = np.flatnonzero(hashes % np.uint64(modulus) == 0)
    kept, own = np.unique(hashes[at], return_inverse=True)
    order = np.argsort(own, kind="stable")
    return len(np.unique(hashes)), kept, np.split(at[order], np.cumsum(np.bincount(own, minlength=len(kept)))[:-1]) if len(kept) else []


class SketchStore(SegmentStore):
    """Sampled shingles with their places, for documents of one recipe.

    Stores of other recipes under the same folder stand beside this one: ``recipes``
    lists them, and documents whose sketches only they have are stale.
    """

    FACT_COLUMNS = "chars int, total int, sampled int"
    ROW_COLUMNS = "hash long, places array<int>"
    CHARS = 64 << 20

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", width: int = folding.WIDTH, modulus: int = folding.MODULUS, read_only: bool = False):
        self.width, self.modulus, self.top = width, modulus, path.rstrip("/")
        super().__init__(spark, f"{self.top}/{recipe_name(width, modulus)}", key_type, read_only)

    def recipes(self) -> list[str]:
        return sorted(self._names(self.top))

    def is_fact(self) -> Column:
        return F.col("hash").isNull()

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.shiftrightunsigned("hash", 40), F.lit(buckets))

    def order_in_bucket(self) -> list[str]:
        return ["hash"]

    def derived(self, docs: DataFrame) -> DataFrame:
        width, modulus = self.width, self.modulus

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group in taken(batch.num_rows, lambda i, batch=batch: derived(batch.column(2)[i].as_py()), MOST_ROWS >> 3):
                    own = pa.array(np.repeat([i for i, _ in group], [len(x[0]) for _, x in group]))
                    facts = (np.concatenate([np.full(len(x[0]), x[3][k], np.int32) for _, x in group]) for k in range(3))
                    kept, places = np.concatenate([x[0] for _, x in group]), [p for _, x in group for p in x[1]]
                    null = np.concatenate([x[2] for _, x in group])
                    columns = [batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, facts), pa.array(kept, mask=null), pa.array(places, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "chars", "total", "sampled", "hash", "places"])

        def derived(text):
            """Hashes, their places, which row is the fact's, and the facts of one text."""
            body = folding.fold(text).body
            n, kept, at = sketched(body, width, modulus)
            return np.append(np.int64(0), kept.view(np.int64)), [None, *at], np.arange(len(kept) + 1) == 0, (len(body), n, len(kept))

        return spread(docs.select("key", "text_hash", "text")).mapInArrow(run, f"key {self.key_type}, text_hash string, {self.FACT_COLUMNS}, {self.ROW_COLUMNS}")

    def facts(self) -> DataFrame:
        """(key, chars, total, sampled) of each document: folded characters, distinct shingles, sampled ones."""
        return self.documents().select("key", "chars", "total", "sampled")

    def postings(self, hashes: DataFrame | None = None) -> DataFrame:
        """(key, hash, places, chars) of live documents; with ``hashes`` (hash), the rows of these from their buckets' files alone."""
        manifest = self.manifest()
        if hashes is None:
            return self.rows(None, manifest).select("key", "hash", "places", "chars")
        wanted = hashes.select("hash").distinct()
        if not manifest["segments"]:
            return self.rows([], manifest).select("key", "hash", "places", "chars")
        buckets = [r[0] for r in wanted.select(self.bucket_of(manifest["buckets"])).distinct().collect()]  # at most as many as there are
        few = wanted.limit(FEW_HASHES + 1).collect()
        if len(few) <= FEW_HASHES:
            listed = [r[0] for r in few]
            return self.rows(buckets, manifest, lambda found: found.where(F.col("hash").isin(listed))).select("key", "hash", "places", "chars")
        return self.rows(buckets, manifest, lambda found: found.join(wanted, "hash", "left_semi")).select("key", "hash", "places", "chars")

    def probe(self, texts: DataFrame, key: str, text: str, cutoff: int = GENERIC, shared: int = 3) -> DataFrame:
        """(a, b, shared): documents of the store that share usual sampled shingles with each of ``texts``, which need not be in it."""
        probe = self.sketch_of(texts, key, text)
        return candidates(probe, self.postings(probe).select(F.col("key").alias("b"), "hash"), cutoff, shared)

    def sketch_of(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(a, hash): distinct sampled shingles of any texts, by this store's recipe."""
        from textloom.plans.tasks import written

        kind = texts.schema[key].dataType.simpleString()
        other = SketchStore(self.spark, self.top, kind, self.width, self.modulus, True)
        rows = other.derived(texts.select(F.col(key).alias("key"), F.lit("").alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text")))
        return written(rows.where("hash is not null").select(F.col("key").alias("a"), "hash"))

    def masks(self, cutoff: int = GENERIC) -> DataFrame:
        """(key, lo, hi): what lies under shingles of ``cutoff`` documents and more, widened by the modulus and merged."""
        rows = self.postings()
        common = generic(rows.select("key", "hash"), "key", cutoff).select("hash")
        at = rows.join(common, "hash", "left_semi").select("key", "chars", F.explode("places").alias("at"))
        spans = at.select("key", F.greatest(F.col("at") - self.modulus, F.lit(0)).alias("lo"), F.least(F.col("at") + self.width + self.modulus, F.col("chars")).alias("hi"))
        return merged(spans, "key", "lo", "hi")

    def status(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, state) of ``docs``: sketched, changed since, stale (by another recipe only), or unsketched."""
        mine = self.documents().select("key", F.col("text_hash").alias("mine"))
        met = self._prepared(docs, key, text).select("key", "text_hash").join(mine, "key", "left")
        others = None
        for name in self.recipes():
            if name != recipe_name(self.width, self.modulus):
                width, modulus = (int(x[1:]) for x in name.split("-"))
                keys = SketchStore(self.spark, self.top, self.key_type, width, modulus, True).documents().select("key")
                others = keys if others is None else others.unionByName(keys)
        met = met.withColumn("other", F.lit(None).cast("boolean")) if others is None else met.join(others.distinct().withColumn("other", F.lit(True)), "key", "left")
        state = F.when(F.col("mine") == F.col("text_hash"), "sketched").when(F.col("mine").isNotNull(), "changed").when(F.col("other"), "stale").otherwise("unsketched")
        return met.select("key", state.alias("state"))
