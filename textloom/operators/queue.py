"""The ingest queue: enqueueing, claims, transitions, reclaiming, status with rate and ETA, retry tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import SIDECARS, generated
from textloom.operators.prefix import last_rows, running

LIVE = ("pending", "running")
ABORTED = "aborted: the worker is gone"


def enqueued(queue: DataFrame, requests: DataFrame, suffixes=SIDECARS) -> DataFrame:
    """The jobs that ``requests`` (url, title, fresh, at) add to ``queue`` (id, url, state, fresh): id, url, title, fresh, at.

    A request is absorbed by a live job of its url, or by one that an earlier
    request of the batch adds, unless it asks for a fresh read and that one does
    not.  Empty urls and the engine's own output are refused.  New ids follow the
    largest one in order of ``at``.
    """
    live = queue.where(F.col("state").isin(*LIVE)).groupBy("url").agg(F.max("fresh").alias("live"))
    asked = requests.where((F.col("url") != "") & ~generated(F.col("url"), suffixes))
    first = lambda f: F.min(F.when(F.col("fresh") == f, F.struct("at", "title", "fresh"))).alias(f"first{f}")
    per = asked.groupBy("url").agg(first(0), first(1)).join(live, "url", "left")
    plain = F.when(F.col("live").isNull() & (F.col("first1").isNull() | (F.col("first0.at") < F.col("first1.at"))), F.col("first0"))
    fresh = F.when(F.coalesce("live", F.lit(0)) < 1, F.col("first1"))
    new = per.select("url", F.explode(F.array_compact(F.array(plain, fresh))).alias("x")).select("url", "x.title", "x.fresh", "x.at")
    last = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = running(new, [], "at", F.lit(1), "n", ("url", "fresh"))
    return numbered.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("id"), "url", "title", "fresh", "at")  # one row of facts


def deduped(queue: DataFrame) -> DataFrame:
    """The queue without pending jobs whose url an older pending job has; all others stay."""
    first = queue.where("state = 'pending'").groupBy(F.col("url").alias("u")).agg(F.min("id").alias("first"))
    met = queue.join(first, F.col("url") == F.col("u"), "left")
    return met.where("state <> 'pending' or id = first").drop("u", "first")


def claimed(queue: DataFrame, owner: int, now: int) -> DataFrame:
    """The queue with its oldest pending job running under ``owner``."""
    oldest = queue.where("state = 'pending'").agg(F.min("id").alias("oldest"))
    mine = F.coalesce(F.col("id") == F.col("oldest"), F.lit(False))
    met = queue.crossJoin(F.broadcast(oldest))  # one row
    return met.withColumn("state", F.when(mine, "running").otherwise(F.col("state"))).withColumn("owner_pid", F.when(mine, owner).otherwise(F.col("owner_pid"))).withColumn("started_at", F.when(mine, now).otherwise(F.col("started_at"))).drop("oldest")


#: Which states an action starts from, and where it leads; null: the job goes.
TRANSITIONS = {"retry": (("error", "done"), "pending"), "cancel": (("pending",), None), "forget": (("error", "done"), None), "abort": (("running",), "error"), "complete": (("running",), "done"), "fail": (("running",), "error")}


def moved(queue: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """The queue after ``commands`` (id, action, note), one a job; an action from a state it does not start from is void."""
    met = queue.join(commands, "id", "left")
    allowed, goal = F.lit(False), F.col("state")
    for action, (states, to) in TRANSITIONS.items():
        here = (F.col("action") == action) & F.col("state").isin(*states)
        allowed |= here
        goal = F.when(here, F.lit(to)).otherwise(goal)
    moves = F.coalesce(allowed, F.lit(False))
    again = moves & (F.col("action") == "retry")
    ended = moves & F.col("action").isin("abort", "complete", "fail")
    error = F.when(again | (moves & (F.col("action") == "complete")), "").when(ended, F.coalesce("note", F.lit(""))).otherwise(F.col("error"))
    out = met.withColumn("error", error).withColumn("started_at", F.when(again, 0).otherwise(F.col("started_at"))).withColumn("finished_at", F.when(again, 0).when(ended, now).otherwise(F.col("finished_at"))).withColumn("state", goal)
    return out.where("state is not null").select(queue.columns)


def refused(queue: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands that have no job, or whose job is in a state they do not start from: (id, action, state)."""
    met = commands.join(queue.select("id", "state"), "id", "left")
    allowed = F.lit(False)
    for action, (states, _) in TRANSITIONS.items():
        allowed |= (F.col("action") == action) & F.col("state").isin(*states)
    return met.where(~F.coalesce(allowed, F.lit(False))).select("id", "action", "state")


def reclaimed(queue: DataFrame, alive: DataFrame, now: int, to: str = "error") -> DataFrame:
    """The queue with running jobs of workers that are not ``alive`` (owner_pid) as errors, or, for captions, pending again."""
    met = queue.join(alive.select("owner_pid", F.lit(True).alias("lives")).distinct(), "owner_pid", "left")
    orphan = (F.col("state") == "running") & F.col("lives").isNull()
    out = met.withColumn("error", F.when(orphan & F.lit(to == "error"), ABORTED).otherwise(F.col("error"))).withColumn("finished_at", F.when(orphan & F.lit(to == "error"), now).otherwise(F.col("finished_at")))
    return out.withColumn("state", F.when(orphan, to).otherwise(F.col("state"))).select(queue.columns)


def listed(queue: DataFrame, state: str = "", limit: int = 0) -> DataFrame:
    """Jobs of one state, or all, the newest first."""
    rows = queue.where(F.col("state") == state) if state else queue
    rows = rows.orderBy(F.desc("id"))
    return rows.limit(limit) if limit > 0 else rows


def mean_seconds(queue: DataFrame, last: int = 10) -> DataFrame:
    """(avg_sec, jobs): mean wall-clock seconds of the last jobs that are done."""
    done = last_rows(queue.where("state = 'done'"), [], "finished_at", last)
    return done.agg(F.avg((F.col("finished_at") - F.col("started_at")) / 1e9).alias("avg_sec"), F.count("*").alias("jobs"))


def status(queue: DataFrame) -> DataFrame:
    """One row: jobs by state and jobs a minute (0 before one is done)."""
    counts = queue.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in (("done", "done"), ("running", "running"), ("pending", "pending"), ("error", "failed"))))
    rate = mean_seconds(queue).select(F.coalesce(60 / F.nullif(F.col("avg_sec"), F.lit(0.0)), F.lit(0.0)).alias("rate_per_min"))
    return counts.crossJoin(rate)  # one row each


def status_of_all(statuses: DataFrame) -> DataFrame:
    """The statuses of several indexes as one: counts add up, the rate is the best one."""
    return statuses.agg(*(F.sum(c).alias(c) for c in ("done", "running", "pending", "failed")), F.max("rate_per_min").alias("rate_per_min"))


def active(queue: DataFrame) -> DataFrame:
    """(id, url, state, position, eta_seconds) of live jobs: running ones first, then by id; 0 seconds before one is done."""
    live = queue.where(F.col("state").isin(*LIVE)).withColumn("rank", F.when(F.col("state") == "running", F.col("id") - (1 << 60)).otherwise(F.col("id")))
    placed = running(live.select("id", "url", "state", "rank"), [], "rank", F.lit(1), "position")
    return placed.crossJoin(F.broadcast(mean_seconds(queue))).select("id", "url", "state", "position", F.coalesce(F.col("position") * F.col("avg_sec"), F.lit(0.0)).alias("eta_seconds"))  # one row of facts


def retry_tally(events: DataFrame) -> DataFrame:
    """A row a job of retry events (job_id, seq, kind, delay, elapsed, status, body, ahead): counts, waits, and the last failure.

    Kinds: 429, 5xx, transport, recovered, gave-up.  Status and body come together,
    from the last event that failed with a status.  Jobs that only recovered have no row.
    """
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    failed = (F.col("kind") != "recovered") & (F.col("status") > 0)
    rows = events.groupBy("job_id").agg(
        n("429", "n429"), n("5xx", "n5xx"), n("transport", "unreachable"), n("recovered", "recovered"), n("gave-up", "gave_up"),
        F.sum("delay").alias("waited"), F.max("elapsed").alias("worst"), F.max("ahead").alias("ahead"), F.max_by(F.when(failed, F.struct("status", "body")), F.when(failed, F.col("seq"))).alias("last"),
    )
    return rows.where("n429 + n5xx + unreachable + gave_up > 0")


def retry_detail() -> Column:
    """A tally as a stage's detail."""
    count = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(what)))
    ahead = F.when(F.col("ahead") > 0, F.concat(F.lit(" (up to "), F.col("ahead").cast("string"), F.lit(" ahead)"))).otherwise("")
    parts = F.array_compact(F.array(F.concat(count("n429", "×429"), ahead), count("n5xx", "×5xx"), count("unreachable", "×unreachable"), count("recovered", " recovered"), count("gave_up", " gave up")))
    waited = F.when(F.col("waited") > 0, F.concat(F.lit("; waited "), F.round("waited").cast("long").cast("string"), F.lit("s"))).otherwise("")
    worst = F.when(F.col("worst") > 0, F.concat(F.lit(", worst call "), F.round("worst").cast("long").cast("string"), F.lit("s"))).otherwise("")
    last = F.when(F.col("last").isNotNull(), F.concat(F.lit("; last: "), F.col("last.status").cast("string"), F.lit(" "), F.substring(F.trim("last.body"), 1, 160))).otherwise("")
    return F.concat(F.array_join(parts, ", "), waited, worst, last)


def last_stage(stages: DataFrame, state: str = "error") -> DataFrame:
    """(job_id, stage): each job's last stage of a state."""
    return stages.where(F.col("state") == state).groupBy("job_id").agg(F.max_by("name", "seq").alias("stage"))


def pool_retained(pool: DataFrame, now: int, ttl: int = 0, most_bytes: int = 0, most_entries: int = 0) -> DataFrame:
    """Entries (recipe_hash, file_hash, last_used_at, bytes) that stay: not older than ``ttl``, then the newest in bytes and number; 0 is no limit.

    A file's image bytes (``image_bytes``, if there) count with its newest entry alone: they stay while any entry names the file.
    """
    rows = pool.where(F.col("last_used_at") >= now - ttl) if ttl > 0 else pool
    size = F.col("bytes")
    if "image_bytes" in pool.columns:
        first = F.row_number().over(Window.partitionBy("file_hash").orderBy(F.desc("last_used_at"), "recipe_hash"))
        rows = rows.withColumn("_first", first)
        size = size + F.when(F.col("_first") == 1, F.col("image_bytes")).otherwise(0)
    ties = ("recipe_hash", "file_hash")
    rows = running(rows, [], "last_used_at", size, "_bytes", ties, descending=True)
    rows = running(rows, [], "last_used_at", F.lit(1), "_entries", ties, descending=True)
    if most_bytes > 0:
        rows = rows.where(F.col("_bytes") <= most_bytes)
    if most_entries > 0:
        rows = rows.where(F.col("_entries") <= most_entries)
    return rows.select(pool.columns)
