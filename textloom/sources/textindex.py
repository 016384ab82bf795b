"""A positional text index in a folder: BM25 over words and phrases, by surface or stem, updated document by document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stem import stem
from textloom.functions.text import tokens
from textloom.operators.search import K1, B, phrases
from textloom.plans.tasks import spread, written
from textloom.sources.segmented import SegmentStore


@lru_cache(maxsize=500_000)
def _stem(word: str) -> str:
    return stem(word)


def placed(terms: pa.ListArray, stemmed: bool) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """(text, term, its places in order) of each different term of each text; different words of a batch are stemmed once."""
    sizes = terms.value_lengths().to_numpy()
    coded = terms.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    if stemmed:
        stems = pa.array([_stem(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
        words, code = stems.dictionary, stems.indices.to_numpy()[code]
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((at, code, own))
    own, code, at = own[order], code[order], at[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))) if len(own) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(at, pa.int32()))
    return own[first], words.take(pa.array(code[first])), places


class TextIndex(SegmentStore):
    """Terms of documents with their places.

    A search opens the buckets of its query's terms.  A word of the query that splits
    into several tokens is a phrase: its tokens must follow each other.  With
    ``stemmed``, words and phrases are compared by their English stems.
    """

    FACT_COLUMNS = "chars int, dl int"
    ROW_COLUMNS = "term string, positions array<int>"
    CHARS = 8 << 20

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", stemmed: bool = False, read_only: bool = False):
        self.stemmed = stemmed
        super().__init__(spark, f"{path.rstrip('/')}/{'stems' if stemmed else 'words'}", key_type, read_only)

    def is_fact(self) -> Column:
        return F.col("term").isNull()

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets))

    def order_in_bucket(self) -> list[str]:
        return ["term"]

    def totals(self, live: DataFrame) -> dict:
        found = live.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))
        return found.first().asDict()

    def derived(self, docs: DataFrame) -> DataFrame:
        stemmed = self.stemmed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, terms, places = placed(batch.column(3), stemmed)
                facts = np.arange(batch.num_rows)
                row = np.append(facts, own)
                column = lambda i: batch.column(i).take(pa.array(row))
                chars, length = batch.column(2).cast(pa.int32()), batch.column(3).value_lengths().cast(pa.int32())
                nothing = lambda kind: pa.nulls(batch.num_rows, kind)
                columns = [column(0), column(1), chars.take(pa.array(row)), length.take(pa.array(row)), pa.concat_arrays([nothing(pa.string()), terms.cast(pa.string())]), pa.concat_arrays([nothing(places.type), places])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "chars", "dl", "term", "positions"])

        listed = spread(docs.select("key", "text_hash", "text")).select("key", "text_hash", F.length("text").alias("chars"), tokens(F.col("text")).alias("terms"))
        return listed.mapInArrow(run, f"key {self.key_type}, text_hash string, {self.FACT_COLUMNS}, {self.ROW_COLUMNS}")

    def search(self, query: str | list[str]) -> DataFrame:
        """(key, score) of all documents with any word or phrase of the query; a list is of single terms."""
        wanted = phrases(query) if isinstance(query, str) else [[t.lower()] for t in query]
        wanted = [[stem(t) for t in p] if self.stemmed else p for p in wanted]
        manifest, terms = self.manifest(), sorted({t for p in wanted for t in p})
        none = self.spark.createDataFrame([], f"key {self.key_type}, score double")
        if not terms or not manifest["segments"]:
            return none
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket_of(manifest["buckets"])).distinct()
        buckets = [r[0] for r in asked.collect()]  # at most a query's terms
        rows = self.rows(buckets, manifest, lambda found: found.where(F.col("term").isin(terms)))
        each = [F.first(F.when(F.col("term") == t, F.col("positions")), True).alias(f"p{i}") for i, t in enumerate(terms)]
        met = rows.groupBy("key", "dl").agg(*each)
        counts = written(met.select("key", "dl", *(self._times([terms.index(t) for t in p]).alias(f"tf{i}") for i, p in enumerate(wanted))))
        found = counts.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
        n, mean = manifest["totals"]["documents"], manifest["totals"]["terms"] / max(1, manifest["totals"]["documents"])
        score = F.lit(0.0)
        for i in range(len(wanted)):
            tf = F.col(f"tf{i}")
            idf = F.greatest(F.log((F.lit(float(n)) - found[i] + 0.5) / (found[i] + 0.5)), F.lit(1e-6))
            score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return counts.where(" or ".join(f"tf{i} > 0" for i in range(len(wanted)))).select("key", score.alias("score"))

    @staticmethod
    def _times(terms: list[int]) -> Column:
        """How often the terms follow each other: places of the first that are, less one, two, ..., places of the others."""
        start = F.col(f"p{terms[0]}")
        for step, i in enumerate(terms[1:], 1):
            start = F.array_intersect(start, F.expr(f"transform(p{i}, x -> x - {step})"))
        return F.coalesce(F.size(start), F.lit(0))
