"""Append-only logs folded on a stream by keyed state: rulings on units, readings of pages, marks of pairs."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from textloom.operators.attest import Fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNIT = "unit string, ord int, kind string, swept boolean, by string, seq long, text string, label string, gone boolean"
READING = "seq long, text string, by string, version int, person boolean"
MARK = "kind string, seq long"


def stateful(spark: SparkSession) -> None:
    """Choose the state store that keyed state of this kind needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Rulings(StatefulProcessor):
    """A document's units and where they stand, as ``attest.resolve`` folds them, entry by entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "body string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        fold = Fold.restored(json.loads(self.held.get()[0])) if self.held.exists() else Fold([])
        before = {s["unit"]: (i, s) for i, s in enumerate(json.loads(json.dumps(fold.order)))}
        entries = sorted((r.asDict(True) for r in rows), key=lambda e: e["seq"])
        for e in entries:
            if e["kind"] == "units":  # a document's own units, told before its log
                fold.begin([{"unit": u["unit"], "text": u["text"] or "", "label": u["label"] or ""} for u in e["adds"] or []])
            else:
                fold.apply({**e, "text": e["text"] or "", "label": e["label"] or "", "adds": e["adds"] or [], "retires": e["retires"] or []})
        self.held.update((json.dumps(fold.state()),))
        now = {s["unit"]: (i, s) for i, s in enumerate(fold.order)}
        for unit, (i, s) in now.items():
            if before.get(unit) != (i, s):
                yield Row(path=key[0], unit=unit, ord=i, kind=s["kind"], swept=s["swept"], by=s["by"], seq=s["seq"], text=s["text"], label=s["label"], gone=False)
        for unit in before.keys() - now.keys():
            yield Row(path=key[0], unit=unit, ord=None, kind=None, swept=None, by=None, seq=None, text=None, label=None, gone=True)

    def close(self) -> None:
        pass


class _Seats(StatefulProcessor):
    """A page's versions: the last text, how many there were, and the reading that holds the seat."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", f"last string, versions int, seat boolean, {READING}")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        last, n, seat, *held = self.held.get() if self.held.exists() else (None, 0, False, None, None, None, None, None)
        start = list(held)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if n and r["text"] == last:
                continue
            last, n = r["text"], n + 1
            if not seat or r["person"] or not held[4]:
                seat, held = True, [r["seq"], r["text"], r["by"], n, r["person"]]
        self.held.update((last, n, seat, *held))
        if held != start:
            yield Row(path=key[0], page=key[1], **dict(zip(("seq", "text", "by", "version", "person"), held)))

    def close(self) -> None:
        pass


class _Latest(StatefulProcessor):
    """The last mark of a pair."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", MARK)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        held = tuple(self.held.get()) if self.held.exists() else None
        best = max(((r["kind"], r["seq"]) for r in rows), key=lambda m: m[1])
        if held is None or best[1] > held[1]:
            self.held.update(best)
            yield Row(a=key[0], b=key[1], kind=best[0], seq=best[1])

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithState(processor, StructType.fromDDL(schema), "Update", "None")


def rulings(log: DataFrame) -> DataFrame:
    """A stream of (path, UNIT): units whose standing a batch of the log changed; ``gone`` marks those that a resegment retired.

    ``log`` has path, seq, unit, kind, blanket, text, label, by, retires (array of
    units) and adds (array of unit, text, label).  An entry of kind ``units`` tells the
    units of a document by ``adds``, before its other entries.  Entries of one document
    must come in the order of seq, in any batches.  A batch costs what its documents'
    units are, whatever the log's length.
    """
    kind = "array<struct<unit:string,text:string,label:string>>"
    rows = log.select("path", "seq", "unit", "kind", F.coalesce("blanket", F.lit(False)).alias("blanket"), "text", "label", "by", "retires", F.col("adds").cast(kind).alias("adds"))
    return _folded(rows, ["path"], _Rulings(), f"path string, {UNIT}")


def readings(log: DataFrame) -> DataFrame:
    """A stream of (path, page, READING): the reading that holds a page's seat, whenever it changes (see ``records.versions``)."""
    from textloom.functions.text import machine_author

    rows = log.select("path", "page", "seq", "text", "by", (~machine_author(F.col("by"))).alias("person"))
    return _folded(rows, ["path", "page"], _Seats(), f"path string, page int, {READING}")


def marks(log: DataFrame) -> DataFrame:
    """A stream of (a, b, MARK): the last mark of each unordered pair, whenever it changes (see ``records.marks``)."""
    kind = log.schema["a"].dataType.simpleString()
    rows = log.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", F.col("seq").cast("long").alias("seq"))
    return _folded(rows, ["a", "b"], _Latest(), f"a {kind}, b {kind}, {MARK}")


class FoldedTable:
    """The newest row of each key of a stream of changes, as deltas over a snapshot.

    A batch writes its own rows alone; a batch that is run again writes them again.
    ``merge`` makes a new snapshot and removes what it covers.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, StructType.fromDDL(schema)

    def _numbers(self, kind: str) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"{n}/_SUCCESS")))

    def put(self, batch: DataFrame, number: int) -> None:
        """The sink of ``foreachBatch``."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/delta={number}")

    def _parts(self) -> list[tuple[int, str]]:
        base = self._numbers("snapshot")[-1:]
        after = base[0] if base else -1
        return [(n, f"snapshot={n}") for n in base] + [(n + 1, f"delta={n}") for n in self._numbers("delta") if n > after]

    def read(self) -> DataFrame:
        """The rows that stand: the newest of each key, without those that are gone."""
        out = self.spark.createDataFrame([], self.schema).withColumn("_n", F.lit(-1))
        for n, name in self._parts():
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("_n", F.lit(n)))
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_n").alias("x")).select(*self.keys, "x.*").select(*self.schema.names)
        return newest.where("not coalesce(gone, false)") if "gone" in rest else newest

    def merge(self) -> None:
        """One snapshot of all deltas so far; these and older snapshots go."""
        parts = self._parts()
        if len(parts) < 2:
            return
        last = self._numbers("delta")[-1]
        self.read().write.mode("overwrite").parquet(f"{self.path}/snapshot={last}")
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind, most in (("snapshot", last - 1), ("delta", last)):
            for n in self._numbers(kind):
                if n <= most:
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"{kind}={n}"), True)

    def follow(self, changes: DataFrame, checkpoint: str):
        """Keep the table by a stream of changes until what there is now is read."""
        return changes.writeStream.outputMode("update").foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
