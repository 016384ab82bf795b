"""Shared pieces of the training-data operators: scratch tables and an Arrow/numpy word kernel.

Words everywhere are the maximal runs of bytes outside ``0x20, 0x09-0x0D``.  The
kernel finds and hashes them for a whole Arrow batch at once, so a word costs a
few nanoseconds and no Python object.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, as a regular expression and as characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

CHUNK_BYTES = 1 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"  # rows that Arrow hands over at once: texts are long


_RUN = uuid.uuid4().hex


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode one of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this process's part of the shared folder."""
    return f"{scratch_dir(spark)}/textloom-{_RUN}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the written table back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all tables that this process wrote to the shared folder; results that were not written yet are lost."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/textloom-{_RUN}")
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh_name(names, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``names``."""
    used = {n.lower() for n in names}
    while name.lower() in used:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo: the split that all learning operators use."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def split_table(df: DataFrame, partitions: int) -> DataFrame:
    """Spread an input of few files over at least ``partitions`` tasks; larger inputs stay as they are.

    Where the session has Spark's own batch size of 10,000 rows, it is lowered: texts are long.
    """
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, BATCH_ROWS)
    return df if df.rdd.getNumPartitions() >= partitions else df.repartition(partitions)


def give_back() -> None:
    """Return freed memory to the system: Python's workers live on for other tasks and groups."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """An Arrow function of batches that returns freed memory at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def group_by_group(run):
    """An Arrow function of a group's table that returns freed memory after each group, so that a worker's memory is that of one group, however many it meets."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return wrapped


def slices(batches, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches in which the columns, of whole numbers, don't change, with their values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            yield tuple(values[:, at].tolist()), batch.slice(at, to - at)


# ---------------------------------------------------------------- numpy kernel


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (xor-shift and odd multiplication)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.arange(256)
_IS_SPACE = np.isin(_BYTES, np.frombuffer(SPACES.encode(), np.uint8))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_CODE = mix64(_BYTES.astype(np.uint64) + np.uint64(0x1234567))
_CODE_LOWER = _CODE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                full = np.full(max(n, CHUNK_BYTES + 1), base)
                full[0] = 1
                _powers[k] = np.multiply.accumulate(full)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the n + 1 bounds of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 bounds of each text's words."""
    solid = ~_IS_SPACE[raw]
    begins, ends = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    begins[bounds] = ends[bounds] = True
    if len(raw):
        begins[1:-1] |= ~solid[:-1]
        ends[1:-1] |= ~solid[1:]
    starts = np.flatnonzero(begins[:-1] & solid)
    stops = np.flatnonzero(ends[1:] & solid) + 1
    return starts, stops, np.searchsorted(starts, bounds)


def hash_spans(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over byte codes, read off prefix sums, then mixed with the length."""
    forward, back = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[raw] * forward[: len(raw)], out=sums[1:])
        return mix64((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the bounds of each text's words among them."""
    raw, bounds = text_bytes(texts)
    starts, stops, at = word_spans(raw, bounds)
    return hash_spans(raw, starts, stops, lower), at


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (a longer text is a slice of its own)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text (one run of all words where there are fewer), and bounds."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.zeros(len(at), np.int64)
    np.cumsum(count, out=bounds[1:])
    total = len(hashes)
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    own = np.repeat(np.arange(len(n)), count)
    first = np.arange(bounds[-1]) - bounds[own] + at[own]
    length = np.minimum(n, width)[own]
    with np.errstate(over="ignore"):
        out = np.full(len(first), np.uint64(width), np.uint64)
        for k in range(width):
            live = length > k
            word = hashes[np.minimum(first + k, total - 1)]
            out = np.where(live, mix64(out * _BASE + word), out)
    return out, bounds


def unique_by_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    out = np.zeros(len(bounds), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out


def reduce_by_text(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each text's values; ``empty`` where it has none."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    live = np.flatnonzero(np.diff(bounds))
    if len(live):
        out[live] = ufunc.reduceat(values, bounds[:-1][live])
    return out


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; a path in TEXTLOOM_TOKENIZERS comes before the installed package."""
    with contextlib.suppress(KeyError):
        return os.path.join(os.environ["TEXTLOOM_TOKENIZERS"], name)
    import public_tokenizers

    return public_tokenizers.path(name)
