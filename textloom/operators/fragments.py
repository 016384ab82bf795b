"""Overlapping windows of long texts, and their reassembly."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, STRIDE, TAIL = 9000, 6000, 3000
SNAP = 512


def parameters(window: int = 0, stride: int = 0, tail: int = 0, embed_limit: int = 0) -> tuple[int, int, int]:
    """Window, stride and tail that hold together: defaults for what is 0, no more than an embedder takes, a quarter of overlap."""
    window, stride, tail = window if window > 0 else WINDOW, stride if stride > 0 else STRIDE, tail if tail > 0 else TAIL
    window = max(1, min(window, embed_limit) if embed_limit > 0 else window)
    return window, max(1, min(stride, window * 3 // 4)), min(tail, window)


def last_mark(text: str, low: int, high: int, mark: str) -> int:
    """The place after the last ``mark`` inside text[low:high]; 0 without one."""
    found = text.rfind(mark, max(low, 0), min(high, len(text)))
    return found + len(mark) if found >= 0 else 0


def _snapped(text: str, low: int, place: int) -> int:
    """``place`` moved back to a paragraph's begin, or else a line's, not before ``low``."""
    return last_mark(text, low, place, "\n\n") or last_mark(text, low, place, "\n") or place


def cut(text: str, window: int = WINDOW, stride: int = STRIDE, tail: int = TAIL) -> list[tuple[int, int]]:
    """Half-open code point spans that cover ``text``: ends move to a paragraph or line end in the window's last
    quarter, begins up to SNAP back to one; a tail shorter than ``tail`` joins the last window.  Nothing has none."""
    n = len(text)
    if n <= window:
        return [(0, n)] if n else []
    spans, at = [], 0
    while True:
        hard = at + window
        end = n if hard >= n else _snapped(text, at + window * 3 // 4, hard)
        after = at + stride
        after = n if after >= n else _snapped(text, max(after - SNAP, 0), after)
        after = end if after <= at else after
        if end < n and n - after < tail:
            end = n
        spans.append((at, end))
        if end >= n:
            return spans
        at = after


def fragments(docs: DataFrame, key: str, text: str, window: int = WINDOW, stride: int = STRIDE, tail: int = TAIL) -> DataFrame:
    """(key, ord, start_off, end_off, text): texts are cut where they lie, in Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, a, z, t[a:z]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (a, z) in enumerate(cut(t or "", window, stride, tail))]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[key, "ord", "start_off", "end_off", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ord int, start_off int, end_off int, text string")


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """Whole texts from overlapping fragments: each adds what lies beyond the furthest end before it."""
    order = Window.partitionBy(key).orderBy("start_off", "ord").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max("end_off").over(order), F.lit(0)), F.col("start_off"))
    new = parts.withColumn("reached", reached).withColumn("piece", F.expr("substring(text, reached - start_off + 1)"))
    return new.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_off", "ord", "piece"))), lambda x: x["piece"]), "").alias("text"))
