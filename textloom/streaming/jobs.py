"""Job logs as streams: windowed metrics (an extension) and a queue drained batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Jobs, failures and mean value of each window; on a stream, ``late`` is the watermark."""
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("jobs"), F.count_if(F.expr("event_type = 'error'")).alias("failed"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "jobs", "failed", "mean_value")


def drain(queue: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each new batch of a streaming queue to ``handle``; offsets live in ``checkpoint``, so a restart goes on."""
    return queue.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduped_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of requests (url, ts, ...) with each url once within ``late``: an approximation of a queue's rule, which asks whether a job is live."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def latest_version(spark, path: str) -> DataFrame | None:
    """The newest whole version of a folded table: a folder ``v=N`` with Spark's mark of success."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    names = [s.getPath() for s in fs.listStatus(top)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}") if done else None


def folded_log(log: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """Keep the last row of each key of a streaming log as a table in ``path``.

    Each batch writes a whole new version and readers take the newest whole one, so
    no read meets half a swap; a batch that is run again writes its version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = latest_version(batch.sparkSession, path)
        rows = batch if before is None else before.unionByName(batch)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")
        last.select(batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assembled_stream(pages: DataFrame, least: int = 3000, most: int = 9000) -> DataFrame:
    """Fragments (path, page, ord, text) of a stream of pages (path, page, segments, continues, last), as they close.

    What is open is carried in a document's state from batch to batch; its last page
    closes it.  Pages of one document must come in order.
    """
    import pandas as pd

    from textloom.functions.segments import assembled

    def run(key, batches, state):
        open_page, open_ord, text, used = state.get if state.exists else (None, 0, "", "")
        ords = dict(p.split(":") for p in used.split()) if used else {}
        rows, ended = [], False
        for batch in batches:
            for page in batch.sort_values("page").itertuples(index=False):
                fed = ([(open_page, [text], False)] if text else []) + [(page.page, [s or "" for s in page.segments], bool(page.continues))]
                found = assembled(fed, least, most)
                for i, f in enumerate(found):
                    if text and i == 0:
                        f["ord"] = open_ord
                    else:
                        f["ord"] = int(ords.get(str(f["page"]), 0))
                        ords[str(f["page"])] = f["ord"] + 1
                rows += [(key[0], f["page"], f["ord"], f["text"]) for f in found[:-1]]
                if found:
                    open_page, open_ord, text = found[-1]["page"], found[-1]["ord"], found[-1]["text"]
                ended = ended or bool(page.last)
        if ended:
            if text:
                rows.append((key[0], open_page, open_ord, text))
            state.remove()
        else:
            state.update((open_page, open_ord, text, " ".join(f"{k}:{v}" for k, v in ords.items())))
        yield pd.DataFrame(rows, columns=["path", "page", "ord", "text"])

    grouped = pages.groupBy("path")
    return grouped.applyInPandasWithState(run, "path string, page int, ord int, text string", "page int, ord int, text string, used string", "append", "NoTimeout")
