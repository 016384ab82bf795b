"""The tables of a document index, derived from the driver's tables.

documents      path, title, text, content_hash, n_chars
pages          path, page, text
fragments      path, frag_id, page, ord, start_off, end_off, text, page_spans, origin
jobs           id, url, state, error, enqueued_at, started_at, finished_at, owner_pid, fresh
job_stages     job_id, seq, name, state, detail
readings       path, page, seq, text, by
rulings        path, seq, unit, kind, blanket, text, by

Conversations stand for paged documents (a turn is a page), events for jobs and for
append-only logs.  Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.pages import plain_windows

WINDOW, STRIDE = 600, 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("source").alias("title"), F.col("lang").alias("index"), "text", F.sha2("text", 256).alias("content_hash"), "n_chars", "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id")).alias("path"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_windows(pages(spark, sf_dir), WINDOW, STRIDE)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event: the newest eighth is pending or running, the rest ended."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    live = F.col("event_id") % 8 == 7
    state = F.when(live & (F.col("event_type") == "click"), "running").when(live, "pending").when(F.col("event_type") == "error", "error").otherwise("done")
    started = F.col("event_id") * 1_000_000_000
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("/d/"), F.col("user_id"), F.when(F.col("user_id") % 4 == 0, ".pdf").otherwise(".md")).alias("url"), state.alias("state"),
        F.when(state == "error", "failed").otherwise("").alias("error"), started.alias("enqueued_at"), F.when(state.isin("pending"), 0).otherwise(started).alias("started_at"),
        F.when(state.isin("done", "error"), started + F.round(F.col("value") * 1000).cast("long") * 1_000_000).otherwise(0).alias("finished_at"),
        (F.col("user_id") % 7).alias("owner_pid"), (F.col("event_id") % 16 == 15).cast("int").alias("fresh"),
    )


def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three stages a job; a failed job's last one is an error, some are degraded or warn of retries."""
    rows = jobs(spark, sf_dir).select("id", "state", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 3 == 0, 3).otherwise(2))).alias("seq"))
    name = F.element_at(F.array(*map(F.lit, ("fetch", "segment", "llm-retries"))), F.col("seq"))
    state = F.when((F.col("state") == "error") & (F.col("seq") == 2), "error").when((F.col("seq") == 2) & (F.col("id") % 10 == 0), "degraded").when((F.col("seq") == 3) & (F.col("id") % 9 == 0), "warn").otherwise("ok")
    return rows.select(F.col("id").alias("job_id"), "seq", name.alias("name"), state.alias("state"), F.concat(name, F.lit(" "), F.col("id")).alias("detail"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the document table behind the jobs: (path, has_fragments, has_pages)."""
    users = table(spark, sf_dir, "events").select("user_id").where("user_id is not null").distinct()
    suffix = F.when(F.col("user_id") % 4 == 0, ".pdf").when(F.col("user_id") % 13 == 5, ".textloom-transcription.md").otherwise(".md")
    slice_ = F.when(F.col("user_id") % 11 == 3, "#p1-2").otherwise("")
    return users.select(F.concat(F.lit("/d/"), F.col("user_id"), suffix, slice_).alias("path"), (F.col("user_id") % 3 != 0).alias("has_fragments"), (F.col("user_id") % 8 != 0).alias("has_pages"))


def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").where("user_id % 17 = 1").distinct()
    return users.select(F.concat(F.lit("/d/"), F.col("user_id"), F.when(F.col("user_id") % 4 == 0, ".pdf").otherwise(".md")).alias("path"), F.lit("superseded").alias("reason"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of readings of pages: purchases stand for a person's."""
    events = table(spark, sf_dir, "events")
    page = (F.col("user_id") % 3 + 1).cast("int")
    return events.select(F.concat(F.lit("conv/"), F.col("user_id") % 40).alias("path"), page.alias("page"), F.col("event_id").alias("seq"), F.concat(F.lit("v"), (F.col("value") / 60).cast("int")).alias("text"), F.when(F.col("event_type") == "purchase", "ann").otherwise("ocr-fast").alias("by"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is ruled on: every turn of a conversation, in order."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id")).alias("path"), F.concat(F.lit("u"), F.col("turn")).alias("unit"), F.col("turn").cast("int").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("label"))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of rulings on the units; a few sweep a whole document, some name units that are not there."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 23 == 0, "affirmed").when(F.col("event_id") % 97 == 0, "retract")
    kind = kind.when(F.col("event_type") == "view", "confirmed").when(F.col("event_type") == "click", "corrected").when(F.col("event_type") == "purchase", "unclear").when(F.col("event_type") == "signup", "unsupported").otherwise("retract")
    blanket = (F.col("event_id") % 23 == 0) | (F.col("event_id") % 97 == 0)
    return events.select(
        F.concat(F.lit("conv/"), F.col("user_id") % 90).alias("path"), F.col("event_id").alias("seq"), F.when(blanket, "").otherwise(F.concat(F.lit("u"), F.col("event_id") % 9)).alias("unit"),
        kind.alias("kind"), blanket.alias("blanket"), F.when((kind == "corrected") & ~blanket, F.concat(F.lit("c"), F.col("event_id"))).otherwise("").alias("text"), F.lit("").alias("label"),
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("by"), F.concat(F.lit("stmt "), F.col("event_id")).alias("statement"),
    )
