"""Content-addressed store of token ids: rolling hashes cut chunks, recipes and Merkle roots rebuild documents.

A store is a folder with three Parquet tables.

* ``parts``: unique chunks and raw recipes.  A chunk has a digest (SHA-256 of the ids
  as little-endian unsigned 32-bit integers), length, and payload: the same bytes with
  byte planes apart, compressed by zstd.  Each is there once, in the file that its
  digest chooses.  Recipes are the rows without digest.
* ``documents``: one recipe a document, in files that ascend by doc_id: file number,
  place in the file, doc_id, the digests in order, their lengths, and the Merkle root.
* ``manifest``: one row a file of recipes: documents, ids, and the Merkle root over its
  recipes.  ``store_root`` is the root over these.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import chunks as slices
from textloom.llm.common import materialize, mix64, scratch_path, split_table
from textloom.llm.encode import ENCODE_BYTES, encoder

WINDOW = 16  # ids that a rolling hash sees, a power of two
MASK = np.uint64((1 << 9) - 1)  # a cut after one id in 512
LEAST, MOST = 64, 4096  # ids in a chunk
_CODES = mix64(np.arange(1, 1 << 16, dtype=np.uint64))  # of small ids, ready


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids asks for a cut.

    The stream may hold several documents: a window reaches back less than LEAST
    ids, and no chunk ends so near its document's begin.
    """
    rolled = _CODES[ids] if len(ids) and ids.max() < len(_CODES) else mix64(ids.astype(np.uint64) + np.uint64(1))
    k = 1
    while k < WINDOW:  # a xor of the last WINDOW ids, each rotated by its distance: windows of k make those of 2 k
        if k < len(rolled):
            turned = rolled[:-k] << np.uint64(k)
            turned |= rolled[:-k] >> np.uint64(64 - k)
            rolled[k:] ^= turned
        k *= 2
    return np.flatnonzero((rolled & MASK) == 0) + 1


def cut_points(n: int, asked: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, with at least LEAST ids (but the last) and at most MOST."""
    ends, at = [], 0
    for place in asked:
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST:
            at = place
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


class Merkle:
    """A Merkle tree that takes leaves one after the other and holds one node a level.

    Leaves and inner nodes are told apart by a first byte; an odd node rises alone.
    """

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == level:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        node = self.peaks[-1][1]
        for _, left in self.peaks[-2::-1]:
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves: Iterable[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _press(raw: bytes, press) -> bytes:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T
    return press.compress(planes.tobytes())


def _unpress(payload: bytes, length: int, press) -> bytes:
    planes = np.frombuffer(press.decompress(payload, max_output_size=4 * length), np.uint8).reshape(4, -1)
    return planes.T.tobytes()


def _encoded(docs: DataFrame, end_id: int, tokenizer: str | None) -> DataFrame:
    """A recipe row for each document, and beside it a row for each chunk that its task has not met lately."""

    def run(batches):
        import zstandard

        ids_of, press = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=1)
        met: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                rows: list[tuple] = []
                ids, bounds = ids_of(part.column("text"))
                ids, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4"), bounds + np.arange(len(bounds))
                data, asked = ids.tobytes(), marks(ids)
                first = np.searchsorted(asked, bounds, side="right")
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    raw = data[4 * bounds[i] : 4 * bounds[i + 1]]
                    n, digests, lengths, at = len(raw) // 4, [], [], 0
                    for end in cut_points(n, (asked[first[i] : first[i + 1]] - bounds[i]).tolist()):
                        piece = raw[4 * at : 4 * end]
                        digest = hashlib.sha256(piece).digest()
                        if digest not in met:
                            if len(met) > 200_000:
                                met.clear()
                            met.add(digest)
                            rows.append((None, None, None, None, digest, end - at, _press(piece, press)))
                        digests.append(digest)
                        lengths.append(end - at)
                        at = end
                    rows.append((doc, digests, lengths, merkle_root(digests), None, n, None))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "digests", "lengths", "root", "digest", "length", "payload"])

    slim = split_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), docs.sparkSession.sparkContext.defaultParallelism)
    return slim.mapInArrow(run, "doc_id long, digests array<binary>, lengths array<int>, root binary, digest binary, length long, payload binary")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """Recipes, and the first of each run of chunks with one digest."""

    def run(batches):
        last = pa.scalar(None, pa.binary())
        for batch in batches:
            if batch.num_rows:
                digests = batch.column(4)
                before = pa.concat_arrays([pa.array([last.as_py()], pa.binary()), digests[:-1]])
                last = digests[-1]
                yield batch.filter(pc.fill_null(pc.not_equal(digests, before), True))

    return rows.mapInArrow(run, rows.schema)


def _file_roots(recipes: DataFrame) -> DataFrame:
    """(file, documents, ids, root): the Merkle root over the recipes of each file in order, with their ids and lengths."""

    def run(batches):
        found: list[tuple] = []
        at, tree, documents, ids = None, Merkle(), 0, 0
        for batch in batches:
            for file, doc, length, root in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != at:
                    if at is not None:
                        found.append((at, documents, ids, tree.root()))
                    at, tree, documents, ids = file, Merkle(), 0, 0
                tree.add((b"" if doc is None else doc.to_bytes(8, "little", signed=True)) + b"|" + length.to_bytes(8, "little") + root)
                documents, ids = documents + 1, ids + length
        if at is not None:
            found.append((at, documents, ids, tree.root()))
        columns = list(zip(*found)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "documents", "ids", "root"])

    dealt = recipes.select("file", "doc_id", "length", "root", "place").repartition("file").sortWithinPartitions("file", "place")
    return dealt.select("file", "doc_id", "length", "root").mapInArrow(run, "file int, documents long, ids long, root binary")


def store_root(spark: SparkSession, path: str) -> str:
    """The Merkle root over the roots of all recipe files, in hex; one row a file passes the driver."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy("file").select("root").toLocalIterator()
    return merkle_root(bytes(r["root"]) for r in rows).hex()


def write_store(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write a store.

    Null and empty texts are the end id alone.  Rows with equal doc_id are documents
    of their own, next to each other; rows without one come last.  An empty table
    gives two empty tables.  Other columns are ignored.

    The chunks are dealt by digest, so equal ones meet in one task, which keeps the
    first; tasks leave out what they sent before, so a passage of many documents
    arrives about once a task and not once a document.
    """
    key = F.when(F.col("digest").isNull(), F.xxhash64("doc_id", "root")).otherwise(F.xxhash64("digest"))
    dealt = _encoded(docs, end_id, tokenizer).repartition(key).sortWithinPartitions("digest")
    _first_of_each(dealt).write.option("compression", "none").parquet(f"{path}/parts")
    recipes = docs.sparkSession.read.parquet(f"{path}/parts").where("digest is null").select("doc_id", "digests", "lengths", "root", "length")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_last(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "root")
    ordered.select(F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"), "doc_id", "digests", "lengths", "root", "length").write.parquet(f"{path}/documents")
    _file_roots(docs.sparkSession.read.parquet(f"{path}/documents")).write.parquet(f"{path}/manifest")


def _checked_chunks(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """Every stored chunk, its digest verified from its bytes: crc32 and, if asked for, the ids."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = [_unpress(p, n, press) for p, n in zip(batch.column(2).to_pylist(), lengths)]
            for digest, piece in zip(digests, raw):
                if hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not have its digest")
            out = [pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in raw], pa.int64())]
            names = ["digest", "n", "crc"]
            if payload:
                out, names = [*out, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "digest binary, n long, crc long" + (", ids binary" if payload else "")
    return spark.read.parquet(f"{path}/parts").where("digest is not null").select("digest", "length", "payload").mapInArrow(run, schema)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``: ids of all documents before, by sums over files and then inside each file."""
    from pyspark.sql import Window

    recipes = spark.read.parquet(f"{path}/documents")
    files = recipes.groupBy("file").agg(F.sum("length").alias("ids"))
    before = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))
    inside = F.sum("length").over(Window.partitionBy("file").orderBy("place")) - F.col("length")
    return recipes.withColumn("inside", inside).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, rebuilt from its chunks."""
    recipes = _starts(spark, path)
    parts = recipes.select("place", F.posexplode("digests").alias("at", "digest"))
    met = parts.join(_checked_chunks(spark, path, True), "digest")
    whole = met.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    joined = F.expr("unhex(concat_ws('', transform(parts, p -> hex(p.ids))))")
    return recipes.join(whole.select("place", joined.alias("ids")), "place").select("doc_id", "start", F.col("length").alias("n_tokens"), "ids")


_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of crc32, bit-reflected."""
    a, out = a.copy(), np.zeros_like(a)
    b = b.copy()
    for _ in range(32):
        out ^= np.where(a & 0x80000000, b, 0)
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ np.where(b & 1, _POLYNOMIAL, 0)
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds to that of a whole in which ``after`` bytes follow it."""
    out, power = crc.astype(np.int64), np.array([0x00800000], np.int64)  # x ** 8
    after = after.astype(np.int64).copy()
    while after.any():
        odd = np.flatnonzero(after & 1)
        if len(odd):
            out[odd] = _times(out[odd], np.repeat(power, len(odd)))
        power, after = _times(power, power), after >> 1
    return out


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified of every document, from the files.

    Chunks are read, decompressed and hashed where they lie.  Only their checksums
    travel to the documents: the crc32 of a whole is the exclusive or of its parts',
    each shifted by the bytes that follow.  ``verified``: all chunks were there, with
    the recipe's lengths, the digests have the recipe's Merkle root, and the recipes
    of its file have that of the manifest.  A file of the manifest that is gone is an
    error.
    """
    recipes = _starts(spark, path)
    parts = recipes.select("place", F.expr("explode(arrays_zip(digests, lengths, transform(sequence(1, size(lengths)), i -> aggregate(slice(lengths, i + 1, size(lengths)), 0L, (s, x) -> s + x))) )").alias("p"))
    parts = parts.select("place", F.col("p.digests").alias("digest"), F.col("p.lengths").alias("length"), F.col("p.2").alias("after"))
    met = parts.join(_checked_chunks(spark, path, False), "digest")

    def shift(batches):
        for batch in batches:
            out = shifted_crc(batch.column(1).to_numpy(), 4 * batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(3)], names=["place", "part", "n"])

    shifted = met.where("n = length").select("place", "crc", "after", "n").mapInArrow(shift, "place long, part long, n long")
    sums = shifted.groupBy("place").agg(F.bit_xor("part").alias("crc"), F.count("*").alias("parts"), F.sum("n").alias("ids"))

    def roots(batches):
        for batch in batches:
            good = [merkle_root(d) == r for d, r in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([len(d) for d in batch.column(4)]), pa.array(good), batch.column(6)], names=["place", "doc_id", "start", "length", "wanted", "rooted", "file"])

    manifest = spark.read.parquet(f"{path}/manifest")
    again = _file_roots(recipes)
    same = materialize(manifest.select("file", "documents", "ids", F.col("root").alias("stored")).join(again.select("file", F.col("root").alias("found")), "file", "full").select("file", F.col("stored").eqNullSafe(F.col("found")).alias("sealed"), F.col("found").isNull().alias("gone")), "seals")
    lost = same.where("gone").count()
    if lost:
        raise ValueError(f"{lost} recipe files of the manifest are gone")
    rooted = recipes.select("place", "doc_id", "start", "length", "digests", "root", "file").mapInArrow(roots, "place long, doc_id long, start long, length long, wanted long, rooted boolean, file int")
    out = rooted.join(sums, "place", "left").join(same.select("file", "sealed"), "file", "left")
    verified = F.col("rooted") & F.col("sealed") & (F.col("parts") == F.col("wanted")) & (F.col("ids") == F.col("length"))
    return out.select("doc_id", "start", F.coalesce("ids", F.lit(0)).alias("n_tokens"), F.coalesce("crc", F.lit(0)).alias("ids_crc32"), F.coalesce(verified, F.lit(False)).alias("verified"))


def new_store_path(spark: SparkSession) -> str:
    return scratch_path(spark, "store")
