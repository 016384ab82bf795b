"""Rows derived from documents, kept in segments of bucketed files: built in steps, read by bucket."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_BUCKETS = 4096
FACTS = -1  # the bucket of rows about documents themselves
MOST_DEAD = 1 << 20  # documents that went, up to which a merge sends them to where the rows are
PACK_ROWS, PACK_BYTES = 1 << 18, 32 << 20  # of rows that are packed together
# What a segment's write leaves and holds: its shuffle's files go when it ends, tasks sort small parts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


@contextmanager
def writing(spark: SparkSession):
    """The session with the settings of WRITING; its own come back."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def packed(rows: DataFrame, order: list[str]) -> DataFrame:
    """(bucket, size, pack): rows of one bucket, many at a time, in order and compressed as one; they take a third of the room that single rows take in a shuffle."""

    def run(batches):
        held, n, size = [], 0, 0
        for batch in batches:
            held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
            if n >= PACK_ROWS or size >= PACK_BYTES:
                yield packs(held)
                held, n, size = [], 0, 0
        if n:
            yield packs(held)

    def packs(held):
        table = pa.Table.from_batches(held)
        table = table.sort_by([(c, "ascending") for c in ("bucket", *order)]).combine_chunks()
        bucket = table["bucket"].to_numpy()
        bounds = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(bucket)]
        found = [one(table.slice(lo, hi - lo)) for lo, hi in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]], pa.int32()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["bucket", "size", "pack"])

    def one(part):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        whole = sink.getvalue()
        return whole.size, pa.compress(whole, "zstd", asbytes=True)

    return rows.mapInArrow(run, "bucket int, size long, pack binary")


def unpacked(packs: DataFrame, schema: StructType) -> DataFrame:
    """The rows of ``packed``, a pack at a time."""

    def run(batches):
        for batch in batches:
            for size, pack in zip(batch.column(1), batch.column(2)):
                with pa.ipc.open_stream(pa.decompress(pack.as_buffer(), size.as_py(), "zstd")) as found:
                    yield from found

    return packs.mapInArrow(run, schema)


class SegmentStore:
    """What a subclass derives from documents, under ``path``, with the documents' own facts.

    A build adds one segment: rows of the documents that are new or whose text
    changed, and marks of those that went.  The newest segment that knows a document
    holds its rows; what older ones have of it is passed over, and goes when segments
    are merged.  A manifest names the segments in their order; it is written last, so
    a build that broke off leaves nothing to be seen, and readers go on with the
    segments that they have opened.

    Rows lie in buckets.  A read opens the files of its buckets alone.  Rows of one
    bucket that are many, such as those of a term that most documents have, are written
    as several files.  Documents (key, text) are told apart by key: rows without one are
    left out, of rows with one key the text that sorts last counts, a null text is empty.
    """

    #: Columns that a subclass derives for a document (chars, its length, among them), and for each row below it.
    FACT_COLUMNS: str
    ROW_COLUMNS: str
    #: Characters of text for each bucket.
    CHARS: int

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", read_only: bool = False):
        self.spark, self.path, self.key_type, self.read_only = spark, path.rstrip("/"), key_type, read_only
        self.schema = StructType.fromDDL(f"key {key_type}, text_hash string, gone boolean, {self.FACT_COLUMNS}, {self.ROW_COLUMNS}")

    # -- what a subclass defines

    def derived(self, docs: DataFrame) -> DataFrame:
        """For each of ``docs`` (key, text_hash, text) a row with its facts and null row columns, and its rows."""
        raise NotImplementedError

    def bucket_of(self, buckets: int) -> Column:
        """The bucket of a derived row."""
        raise NotImplementedError

    def is_fact(self) -> Column:
        """Whether a derived row is about the document itself."""
        raise NotImplementedError

    def order_in_bucket(self) -> list[str]:
        raise NotImplementedError

    def totals(self, live: DataFrame) -> dict:
        """What the manifest keeps about the live documents."""
        found = live.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
        return found.asDict()

    # -- files

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, top = self._fs(), self._hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []

    def manifest(self) -> dict:
        """The newest whole manifest; an empty one before the first build."""
        top = f"{self.path}/manifest"
        whole = [int(n[2:]) for n in self._names(top) if n.startswith("v=") and self._fs().exists(self._hadoop(f"{top}/{n}/_SUCCESS"))]
        if not whole:
            return {"version": -1, "segments": [], "buckets": 0, "totals": {}}
        rows = self.spark.read.text(f"{top}/v={max(whole)}").collect()  # one line
        return {"version": max(whole), **json.loads(rows[0]["value"])}

    def _commit(self, before: dict, segments: list[str], buckets: int) -> dict:
        """A new manifest; another one that was committed since ``before`` was read is an error."""
        after = {"segments": segments, "buckets": buckets}
        after["totals"] = self.totals(self.documents({**before, **after}))
        line = self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1)
        line.write.mode("errorifexists").text(f"{self.path}/manifest/v={before['version'] + 1}")
        return {"version": before["version"] + 1, **after}

    def _write(self, rows: DataFrame, buckets: int, dealt: bool = False) -> str:
        """A new segment of ``rows``; with ``dealt``, rows of a bucket lie together and stay with their task."""
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        name = uuid.uuid4().hex
        bucket = F.when(self.is_fact(), F.lit(FACTS)).otherwise(self.bucket_of(buckets)).cast("int")
        placed = rows.withColumns({"bucket": bucket, "text_hash": F.when(self.is_fact(), F.col("text_hash"))})  # only facts are asked for their text
        order = [*self.order_in_bucket(), "key"]  # keys of a term in order take less room
        with writing(self.spark):
            met = placed if dealt else unpacked(packed(placed, order).hint("rebalance", "bucket"), placed.schema)
            ordered = met.sortWithinPartitions("bucket", *order)
            ordered.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/segments/{name}")
        return name

    def _segment(self, name: str, buckets: list[int] | None) -> DataFrame | None:
        """Rows of a segment that lie in the given buckets (None: all but facts), with their bucket; only these folders are listed."""
        top = f"{self.path}/segments/{name}"
        there = [int(n[7:]) for n in self._names(top) if n.startswith("bucket=")]
        wanted = sorted(b for b in there if (b != FACTS if buckets is None else b in set(buckets)))
        return self.spark.read.schema(self.schema).option("basePath", top).parquet(*(f"{top}/bucket={b}" for b in wanted)) if wanted else None

    def _read(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        """Rows of all segments with the number of theirs, dead ones too."""
        out = self.spark.createDataFrame([], self.schema).withColumn("segment", F.lit(0))
        for number, name in enumerate(manifest["segments"]):
            found = self._segment(name, buckets)
            if found is not None:
                out = out.unionByName(found.select(*self.schema.names).withColumn("segment", F.lit(number)))
        return out

    # -- reading

    def _newest(self, manifest: dict) -> DataFrame:
        rows = self._read(manifest, [FACTS])
        held = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*held), "segment").alias("x")).select("key", "x.*")

    def documents(self, manifest: dict | None = None) -> DataFrame:
        """The live documents: key, text_hash, their facts, and the segment that holds their rows."""
        facts = [f.name for f in StructType.fromDDL(self.FACT_COLUMNS)]
        return self._newest(manifest or self.manifest()).where("not gone").select("key", "text_hash", *facts, "segment")

    def _dead(self, manifest: dict) -> DataFrame:
        """(key, segment) of what later segments replaced or dropped."""
        seen = self._read(manifest, [FACTS]).select("key", "segment", "gone")
        newest = seen.groupBy("key").agg(F.max("segment").alias("newest"))
        return seen.join(newest, "key").where("segment < newest or gone").select("key", "segment")

    def rows(self, buckets: list[int] | None = None, manifest: dict | None = None, filtered=None, dead: DataFrame | None = None) -> DataFrame:
        """Live rows of these buckets (all where None is given); ``filtered`` is applied before dead ones are told apart."""
        manifest = manifest or self.manifest()
        found = self._read(manifest, buckets)
        found = filtered(found) if filtered else found
        columns = ["key", *(f.name for f in StructType.fromDDL(self.ROW_COLUMNS)), *(f.name for f in StructType.fromDDL(self.FACT_COLUMNS))]
        if len(manifest["segments"]) > 1:
            found = found.join(self._dead(manifest) if dead is None else dead, ["key", "segment"], "left_anti")
        return found.select(*columns)

    # -- changing

    def _prepared(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        rows = docs.select(F.col(key).cast(self.key_type).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null")
        return rows.withColumn("text_hash", F.sha2("text", 256))

    def update(self, docs: DataFrame, key: str, text: str, whole: bool = False) -> dict:
        """Derive the rows of documents that are new or changed, and of no others; with ``whole``, documents that ``docs`` has not go.

        How many of either there were is told; where there were none, nothing is written.
        """
        from textloom.plans.tasks import written

        before = self.manifest()
        rows = self._prepared(docs, key, text)
        known = self.documents(before).select("key", "text_hash")
        hashes = written(rows.groupBy("key").agg(F.max("text_hash").alias("text_hash"), F.count("*").alias("n"), F.max(F.length("text")).alias("chars")))
        fresh = written(hashes.join(known, ["key", "text_hash"], "left_anti").select("key", "text_hash"))
        gone = written(known.join(hashes, "key", "left_anti").select("key") if whole else known.limit(0).select("key"))
        counts = {"changed": fresh.count(), "gone": gone.count()}
        if not any(counts.values()):
            return counts
        seen = hashes.agg(F.sum("chars").alias("chars"), F.max("n").alias("n"), F.count("*").alias("keys")).first()
        every = counts["changed"] == seen["keys"]  # texts need not meet the keys of those that changed
        changed = rows if every and seen["n"] == 1 else rows.join(fresh, ["key", "text_hash"], "left_semi")
        changed = changed.dropDuplicates(["key"]) if seen["n"] > 1 else changed
        buckets = before["buckets"] or self._buckets(seen["chars"])
        name = self._write(self.derived(changed).withColumn("gone", F.lit(False)).select(*self.schema.names).unionByName(self._marks(gone).select(*self.schema.names)), buckets)
        self._commit(before, [*before["segments"], name], buckets)
        return counts

    def _buckets(self, chars: int | None) -> int:
        return max(1, min(MOST_BUCKETS, -(-(chars or 0) // self.CHARS)))

    def _marks(self, gone: DataFrame) -> DataFrame:
        """Rows that say that documents went."""
        rest = [f for f in self.schema if f.name not in ("key", "gone")]
        return gone.select("key", F.lit(True).alias("gone"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))

    def delete(self, keys: DataFrame) -> None:
        """Drop documents; ``keys`` (key) that the store has not are passed over."""
        before = self.manifest()
        gone = keys.select(F.col("key").cast(self.key_type)).distinct().join(self.documents(before).select("key"), "key", "left_semi")
        name = self._write(self._marks(gone).select(*self.schema.names), max(1, before["buckets"]))
        self._commit(before, [*before["segments"], name], before["buckets"])

    def merge(self) -> None:
        """All live rows as one segment; the others' files stay for readers that opened them, until ``vacuum``.

        Rows that lie in one segment, where the others have marks only, stay in their
        buckets and are not shuffled; nor are they to meet what is dead, if that is not much.
        """
        from textloom.plans.tasks import written

        before = self.manifest()
        if len(before["segments"]) < 2:
            return
        dead = written(self._dead(before))
        dead, few = (F.broadcast(dead), True) if dead.count() <= MOST_DEAD else (dead, False)
        facts = self._newest(before).where("not gone").select(*self.schema.names)
        rows = self.rows(None, before, dead=dead).withColumns({"text_hash": F.lit(None).cast("string"), "gone": F.lit(False)})
        buckets = self._buckets(before["totals"]["chars"])
        held = [n for n in before["segments"] if any(b.startswith("bucket=") and b != f"bucket={FACTS}" for b in self._names(f"{self.path}/segments/{n}"))]
        stay = few and len(held) < 2 and buckets <= 2 * before["buckets"] and before["buckets"] <= 2 * buckets
        buckets = before["buckets"] if stay else buckets
        name = self._write(facts.unionByName(rows.select(*self.schema.names)), buckets, stay)
        self._commit(before, [name], buckets)

    def vacuum(self) -> None:
        """Remove segments that the newest manifest does not name."""
        live = set(self.manifest()["segments"])
        for name in set(self._names(f"{self.path}/segments")) - live:
            self._fs().delete(self._hadoop(f"{self.path}/segments/{name}"), True)

    def clear(self) -> None:
        """Forget all documents."""
        self._commit(self.manifest(), [], 0)
