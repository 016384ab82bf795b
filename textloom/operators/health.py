"""What is wrong with an index, worst first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import SIDECARS, generated
from textloom.operators.queue import last_stage

KINDS = ("no-fragments", "generated-indexed", "missing-file", "no-pages", "job-failed", "segment-degraded", "llm-retries", "withdrawn")
_FIX = {"no-fragments": "ingest --fresh", "generated-indexed": "forget", "missing-file": "forget", "no-pages": "reread", "job-failed": "retry --match", "segment-degraded": "reread"}


def local_path(path: Column) -> Column:
    """The absolute local path that a document's path or file url names; null for remote and relative ones."""
    bare = F.when(path.startswith("file://"), F.substring(path, 8, 1 << 30)).when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(path)
    return F.when(bare.startswith("/"), bare)


def remote(path: Column) -> Column:
    return path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~path.startswith("file:")


def problems(documents: DataFrame, fragments: DataFrame, pages: DataFrame, jobs: DataFrame, stages: DataFrame, withdrawn: DataFrame, files: DataFrame | None = None, suffixes=SIDECARS) -> DataFrame:
    """(rank, kind, subject, job_id, stage, detail, fix) of all eight kinds, ranked by consequence.

    ``documents``, ``fragments`` and ``pages`` have path, ``withdrawn`` path and
    reason.  ``files`` (path) are the local files that are there; without it no file
    is called missing and no failed job's target gone.  A failed job whose document
    has fragments by now, or that is withdrawn, is history.
    """
    path = F.col("path")
    whole = documents.where(~path.contains("#p"))
    have = fragments.select("path").distinct()
    gone = withdrawn.select("path").distinct()
    docs = lambda kind, rows, detail=F.lit(""): rows.select(F.lit(kind).alias("kind"), path.alias("subject"), F.lit(0).cast("long").alias("job_id"), F.lit("").alias("stage"), detail.alias("detail"))
    parts = [
        docs("no-fragments", whole.join(have, "path", "left_anti")),
        docs("generated-indexed", documents.where(generated(path, suffixes))),
        docs("no-pages", whole.where(F.lower(path).endswith(".pdf")).join(pages.select("path").distinct(), "path", "left_anti")),
        docs("withdrawn", withdrawn, F.col("reason")),
    ]
    failed = jobs.where("state = 'error'").join(have.join(documents.select("path"), "path", "left_semi").withColumnRenamed("path", "url"), "url", "left_anti").join(gone.withColumnRenamed("path", "url"), "url", "left_anti")
    if files is not None:
        there = files.select(path.alias("local")).distinct()
        missing = whole.where(~generated(path, suffixes)).join(gone, "path", "left_anti").withColumn("local", local_path(path)).where("local is not null").join(there, "local", "left_anti")
        parts.append(docs("missing-file", missing, F.lit("the file is not where its row says")))
        failed = failed.withColumn("local", local_path(F.col("url"))).join(there.withColumn("there", F.lit(True)), "local", "left").where(remote(F.col("url")) | F.col("there"))
    told = failed.join(last_stage(stages), failed.id == F.col("job_id"), "left")
    parts.append(told.select(F.lit("job-failed").alias("kind"), F.col("url").alias("subject"), F.col("id").cast("long").alias("job_id"), F.coalesce("stage", F.lit("")).alias("stage"), F.col("error").alias("detail")))
    for kind, which in (("segment-degraded", F.col("s.state") == "degraded"), ("llm-retries", (F.col("s.name") == "llm-retries") & (F.col("s.state") == "warn"))):
        met = stages.alias("s").join(jobs.alias("j"), F.col("s.job_id") == F.col("j.id")).where(which)
        parts.append(met.select(F.lit(kind).alias("kind"), F.col("j.url").alias("subject"), F.col("j.id").cast("long").alias("job_id"), F.col("s.name").alias("stage"), F.col("s.detail").alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    fixes = F.create_map(*(F.lit(x) for pair in _FIX.items() for x in pair))[F.col("kind")]
    return out.select(rank.alias("rank"), "kind", "subject", "job_id", "stage", "detail", F.coalesce(F.concat(fixes, F.lit(" "), "subject"), F.lit("")).alias("fix"))
