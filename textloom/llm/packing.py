"""Hierarchical residual packing: best fit locally, nearly full bins leave, the rest merges up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks, giving_back, materialize, split_table
from textloom.llm.encode import ENCODE_BYTES, encoder

CAPACITY = 2048
SLACK = 4  # a bin with so little room left has nothing to gain from another round
LEAF_ITEMS = 60_000
FAN_IN = 4
LEAST_GAIN = 0.001

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` of which the first may be shorter."""

    def run(batches):
        from pyspark import TaskContext

        ids_of, key = encoder(tokenizer).encode, TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in chunks(batch, "text", ENCODE_BYTES):
                ids, bounds = ids_of(part.column("text"))
                ids, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4"), bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                count = -(-total // capacity)
                own = np.repeat(np.arange(len(total)), count)
                n = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                head = total - (count - 1) * capacity  # the first piece may be shorter
                length = np.where(n == 0, head[own], capacity)
                start = np.where(n == 0, 0, head[own] + (n - 1) * capacity)
                raw, at = memoryview(ids.tobytes()), 4 * (bounds[own] + start)
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                out = [key + own, part.column("doc_id").take(pa.array(own)), n, start, length, crc]
                key += len(total)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(out, kinds)], names=["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return split_table(slim, docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(giving_back(run), PIECES)


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """A bin number for each size, in order: the fullest bin that has room, else a new one.

    Bins stand in stacks by their room; one big integer has a bit for each stack
    that isn't empty, so the tightest fit is the lowest set bit at or above the size.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for size in sizes:
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, bins
            bins += 1
        left = room - size
        if left:
            stacks[left].append(chosen)
            mask |= 1 << left
        out.append(chosen)
    return out


MEMBER = "struct<row_key:long,doc_id:long,start:long,length:long,ids_crc32:long>"


def _round(items: DataFrame, capacity: int) -> DataFrame:
    """One level of the tree: best fit (largest first) over each partition's items, as bins."""
    schema = f"size long, members array<{MEMBER}>"

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        sizes = table.column("size").to_numpy()
        least = table.column("least").to_numpy()
        order = np.lexsort((least, -sizes))
        bins = np.empty(len(sizes), np.int64)
        bins[order] = best_fit(sizes[order].tolist(), capacity)
        by_bin = np.argsort(bins, kind="stable")
        members = table.column("members").combine_chunks().take(pa.array(by_bin))
        ends = np.append(np.flatnonzero(np.diff(bins[by_bin])) + 1, len(bins))
        starts = np.insert(ends[:-1], 0, 0)
        offsets = members.offsets.to_numpy()
        merged = pa.ListArray.from_arrays(pa.array(np.append(offsets[starts], offsets[-1]).astype(np.int32) - offsets[0]), members.flatten())
        totals = np.add.reduceat(sizes[by_bin], starts)
        for at in range(0, len(totals), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(totals[at : at + 4096]), merged.slice(at, 4096)], names=["size", "members"])

    return items.select("size", "members", F.expr("array_min(transform(members, m -> m.row_key))").alias("least")).mapInArrow(giving_back(run), schema)


def pack(found: DataFrame, capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """Sequences for a table of pieces (PIECES): every piece with sequence_id and offset.

    Whole pieces fill a sequence each.  The others, at most one per document, are
    dealt by hash to partitions of about ``leaf_items`` and packed there, largest
    first.  Bins within SLACK of full leave; the others come back as single items,
    dealt anew to a FAN_IN-th as many partitions (but no more than ``leaf_items`` to
    each), until one partition held them all or two rounds in a row have each merged
    less than LEAST_GAIN of them.  A bin holds at most ``capacity`` members, so rows
    stay small; no task ever holds more than its share of items.
    """
    full = found.where(F.col("length") == capacity)
    items = found.where(F.col("length") < capacity).select(F.col("length").alias("size"), F.array(F.struct("row_key", "doc_id", "start", "length", "ids_crc32")).alias("members"))
    left, done = items.count(), []
    parts, level, idle = max(1, -(-left // leaf_items)), 0, 0
    while left:
        bins = materialize(_round(items.repartition(parts, F.xxhash64(F.col("members")[0]["row_key"], F.lit(level))), capacity), "bins")
        ready = bins.where(F.col("size") >= capacity - SLACK)
        rest = bins.where(F.col("size") < capacity - SLACK)
        now = rest.count()
        if parts == 1 or not now:
            done.append(bins)
            break
        done.append(ready)
        idle = idle + 1 if now > (1 - LEAST_GAIN) * left else 0
        if idle == 2:
            done.append(rest)
            break
        items, left, parts, level = rest, now, max(-(-now // leaf_items), parts // FAN_IN, 1), level + 1
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    numbered = whole
    for bins in done:
        member = bins.select(F.expr("members[0].row_key * 2").alias("sequence_id"), F.posexplode("members").alias("at", "m"), F.expr("transform(members, m -> m.length)").alias("lengths"))
        before = F.expr("aggregate(slice(lengths, 1, at), 0L, (s, x) -> s + x)")
        numbered = numbered.unionByName(member.select("m.doc_id", F.lit(0).alias("piece"), "m.start", "m.length", "m.ids_crc32", "sequence_id", before.alias("offset")))
    return numbered


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Null and empty texts are one piece of the end id alone.  Rows with equal or
    null doc_id are packed as documents of their own.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    return pack(materialize(pieces(docs, capacity, end_id, tokenizer), "pieces"), capacity)
