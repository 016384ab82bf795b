"""State kept in append-only rows: readings, rulings of pairs, slices, notes, withdrawals, branches, captions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.pages import SEPARATOR
from textloom.plans.tasks import spread

# ---------------------------------------------------------------- readings of pages


def versions(log: DataFrame) -> DataFrame:
    """The readings (path, page, seq, text, by) that are versions, with ``version``, ``person`` and ``active``.

    A reading with the text of the one before it is none.  Active is a person's last
    version, or without one the machine's last: a machine never unseats a person.
    """
    order = Window.partitionBy("path", "page").orderBy("seq")
    rows = log.withColumn("before", F.lag("text").over(order)).where("before is null or text <> before").drop("before")
    rows = rows.withColumn("person", ~T.machine_author(F.col("by"))).withColumn("version", F.row_number().over(order))
    seat = F.max(F.struct("person", "seq")).over(Window.partitionBy("path", "page"))
    return rows.withColumn("active", F.struct("person", "seq") == seat)


def next_versions(log: DataFrame) -> DataFrame:
    """(path, page, next_seq): the number that a new reading of a page gets."""
    return log.groupBy("path", "page").agg((F.max("seq") + 1).alias("next_seq"))


def superseded(log: DataFrame) -> DataFrame:
    """Versions that do not hold their page's seat."""
    return versions(log).where("not active")


def corrected_pages(pages: DataFrame, log: DataFrame) -> DataFrame:
    """``pages`` (path, page, text) with a person's active reading in place of the text; ``corrected`` tells."""
    held = versions(log).where("active and person").select("path", "page", F.col("text").alias("reading"))
    return pages.join(held, ["path", "page"], "left").select("path", "page", F.coalesce("reading", "text").alias("text"), F.col("reading").isNotNull().alias("corrected"))


def to_recaption(log: DataFrame, captions: DataFrame) -> DataFrame:
    """(path): documents that a person corrected and whose caption (path, name, source) a machine wrote."""
    corrected = versions(log).where("person").select("path").distinct()
    return captions.where("source <> 'person' and trim(name) <> ''").select("path").join(corrected, "path", "left_semi")


# ---------------------------------------------------------------- rulings of pairs

MARKS = ("copy", "version", "unrelated")


def mark_fault(a: Column, b: Column, kind: Column, supersedes: Column) -> Column:
    """The first thing that is wrong with a mark of a pair, or null."""
    some = F.coalesce(supersedes, F.lit("")) != ""
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "a mark needs both sides").when(a == b, "one document is no pair")
        .when(~F.coalesce(kind.isin(*MARKS), F.lit(False)), "unknown kind").when(some & (kind != "version"), "only a version supersedes").when(some & (supersedes != a) & (supersedes != b), "supersedes none of the pair")
    )


def marks(log: DataFrame) -> DataFrame:
    """The last mark of each pair (a, b, kind, supersedes, note, by, seq); the smaller side is a."""
    rows = log.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(c for c in log.columns if c not in ("a", "b")))
    rest = [c for c in rows.columns if c not in ("a", "b")]
    return rows.groupBy("a", "b").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("a", "b", "x.*")


def marks_of(log: DataFrame, path: str) -> DataFrame:
    """A document's marks, with the other side."""
    own = marks(log).where((F.col("a") == path) | (F.col("b") == path))
    return own.withColumn("other", F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")))


def unmarked(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs (a, b) that nobody ruled on: each once, the smaller side first."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.join(marks(log), ["a", "b"], "left_anti")


# ---------------------------------------------------------------- slices of documents


def slice_fault(name: Column, parent: Column, low: Column, high: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "a slice needs an id").when(F.coalesce(parent, F.lit("")) == "", "a slice needs a parent").when(~F.coalesce(low >= 1, F.lit(False)), "pages start at 1").when(~F.coalesce(high >= low, F.lit(False)), "the range runs backwards")


def slice_coverage(pages: DataFrame, slices: DataFrame) -> DataFrame:
    """(parent, pages, covered, uncovered, overlaps): how the slices (parent, low, high) of a document cover its pages (parent, pages)."""
    spread = slices.where("low >= 1 and high >= low").join(pages, "parent").select("parent", F.explode(F.sequence(F.col("low"), F.greatest(F.least("high", "pages"), "low"))).alias("page"))
    counts = spread.groupBy("parent", "page").agg(F.count("*").cast("int").alias("n"))
    every = pages.where("pages >= 1").select("parent", "pages", F.explode(F.sequence(F.lit(1), "pages")).alias("page")).join(counts, ["parent", "page"], "left")
    listed = lambda c, x: F.sort_array(F.collect_list(F.when(c, x)))
    return every.groupBy("parent", "pages").agg(F.count_if(F.col("n") > 0).alias("covered"), listed(F.col("n").isNull(), F.col("page")).alias("uncovered"), listed(F.col("n") > 1, F.struct("page", "n")).alias("overlaps"))


def slice_fragments(pages: DataFrame, slices: DataFrame) -> DataFrame:
    """(path, title, page, ord, text): slices as documents: a fragment for each page that is not blank, under the parent's page number.

    ``pages`` are true pages (path, page, text); ``slices`` have parent, low, high and title.
    """
    met = slices.join(pages.withColumnRenamed("path", "parent"), "parent").where((F.col("page") >= F.col("low")) & (F.col("page") <= F.col("high")) & (T.stripped(F.col("text")) != ""))
    name = F.concat(F.regexp_extract("parent", r"([^/]*)$", 1), F.lit(" p"), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"))
    return met.select(T.child_path(F.col("parent"), F.col("low"), F.col("high")).alias("path"), F.when(F.coalesce("title", F.lit("")) == "", name).otherwise(F.col("title")).alias("title"), "page", F.lit(0).alias("ord"), "text")


def slice_proposals(pages: DataFrame) -> DataFrame:
    """(path, low, high, form, shared): where pages (path, page, text) say "Page 1 of N", with the form named nearest before.

    A later start cuts a slice short; forms that start on one sheet are ``shared``.
    """
    flat = T.flat(F.col("text"))
    mark, form = r"(?i)\bpage\s+0*1\s+of\s+(\d{1,6})\b", r"(?i)\bform\s+([0-9]+[a-z]*)\b"
    # text up to each mark, and its number of pages
    heads = F.split(F.col("flat"), mark)
    totals = F.regexp_extract_all(F.col("flat"), F.lit(mark), 1)
    rows = pages.select("path", "page", flat.alias("flat")).where(F.col("flat").rlike(mark))
    told = rows.select("path", "page", F.regexp_extract_all("flat", F.lit(form), 1).alias("forms"), heads.alias("heads"), F.posexplode(totals).alias("at", "total"))
    before = F.regexp_extract_all(F.array_join(F.slice("heads", F.lit(1), F.col("at") + 1), " "), F.lit(form), 1)
    name = F.upper(F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at("forms", F.lit(1)), F.lit("")))
    starts = told.select("path", "page", name.alias("form"), F.col("total").cast("int").alias("total")).where("total >= 1").distinct()
    last = pages.groupBy("path").agg(F.max("page").alias("last"))
    firsts = starts.select("path", "page").distinct().withColumn("next", F.lead("page").over(Window.partitionBy("path").orderBy("page")))
    met = starts.join(firsts, ["path", "page"]).join(last, "path")
    high = F.least(F.col("page") + F.col("total") - 1, F.coalesce(F.col("next") - 1, F.col("last")), F.col("last"))
    names = starts.where("form <> ''").groupBy("path", "page").agg(F.array_sort(F.collect_set("form")).alias("names"))
    out = met.join(names, ["path", "page"], "left")
    return out.select("path", F.col("page").alias("low"), F.greatest(high, "page").alias("high"), "form", F.array_remove(F.coalesce("names", F.array().cast("array<string>")), F.col("form")).alias("shared"))


# ---------------------------------------------------------------- notes, withdrawals, branches


def notes_added(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with new ones (path, page, text, by); blank ones are refused."""
    return notes.unionByName(new.where(T.stripped(F.coalesce("text", F.lit(""))) != ""))


def withdrawn(documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that stay, withdrawals): requests (path, reason) without a reason are void."""
    good = requests.where(T.stripped(F.coalesce("reason", F.lit(""))) != "").groupBy("path").agg(F.max("reason").alias("reason"))
    return documents.join(good, "path", "left_anti"), good


def restored(withdrawals: DataFrame, paths: DataFrame) -> DataFrame:
    return withdrawals.join(paths.select("path").distinct(), "path", "left_anti")


NAME_CHARS = 16 << 20  # characters of the names that one automaton holds


def citations(names: DataFrame, fragments: DataFrame, reach: int = 80) -> DataFrame:
    """(cited, path, page, excerpt): fragments (path, page, text) of other documents that hold a withdrawn document's name, in any case.

    The different names of ``names`` (path) go into an automaton that finds all of them in
    one pass over a text.  Where names have more than NAME_CHARS characters there are
    several automata, and the fragments are read for each.  Paths that share a name are
    joined to what was found.
    """
    cited = names.select(F.col("path").alias("cited"), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name")).where("name <> ''").distinct()
    different = cited.select("name").distinct()
    blocks = max(1, -(-(different.agg(F.sum(F.length("name"))).first()[0] or 0) // NAME_CHARS))
    out = None
    for block in range(blocks):
        listed = [r["name"] for r in different.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]  # about NAME_CHARS characters
        found = _named(fragments, listed, reach)
        out = found if out is None else out.unionByName(found)
    return out.join(cited, "name").where(F.col("path") != F.col("cited")).select("cited", "path", "page", "excerpt")


def _named(fragments: DataFrame, names: list[str], reach: int) -> DataFrame:
    """(path, page, name, excerpt): each of ``names`` in each fragment that holds it, with what stands about its first place."""
    held = fragments.sparkSession.sparkContext.broadcast(names)
    kinds = [(c, fragments.schema[c].dataType.simpleString()) for c in ("path", "page")]

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in held.value:
            automaton.add_word(name, name)
        if held.value:
            automaton.make_automaton()
        for batch in batches:
            rows, found, at = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist() if held.value else []):
                first: dict[str, int] = {}
                for end, name in automaton.iter(text or ""):
                    first.setdefault(name, end - len(name) + 2)  # places count from 1
                rows += [i] * len(first)
                found += first
                at += first.values()
            if rows:
                row = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in (0, 1, 3)), pa.array(found, pa.string()), pa.array(at, pa.int32())], names=["path", "page", "text", "name", "at"])

    rows = spread(fragments.select("path", "page", F.lower("text").alias("low"), "text"))
    met = rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds) + ", text string, name string, at int")
    begin = F.greatest(F.col("at") - reach, F.lit(1))
    return met.select("path", "page", "name", T.flat(F.substr("text", begin, F.col("at") + F.length("name") + reach - begin)).alias("excerpt"))


def forked(branches: DataFrame, name: str, parent: str) -> DataFrame:
    """Branches (name, parent) with one more; a name that is taken is an error of the caller's."""
    spark = branches.sparkSession
    return branches.unionByName(spark.createDataFrame([(name, parent)], "name string, parent string"))


def deletable(branches: DataFrame) -> DataFrame:
    """Branches that no other one has as its parent."""
    return branches.join(branches.where("parent is not null").select(F.col("parent").alias("name")).distinct(), "name", "left_anti")


def ancestors(branches: dict[str, str | None], name: str) -> list[str]:
    """A branch and its parents, nearest first."""
    out: list[str] = []
    while name and name not in out:
        out.append(name)
        name = branches.get(name) or ""
    return out


def layered(layers: list[tuple[DataFrame, DataFrame | None]], key: str = "path") -> DataFrame:
    """Rows of a branch over those of its parents: ``layers`` are (rows, tombstones), nearest first.

    A row is hidden by any nearer layer that has its key or deleted it.
    """
    out, hidden = None, None
    for rows, tombs in layers:
        seen = rows if hidden is None else rows.join(hidden, key, "left_anti")
        out = seen if out is None else out.unionByName(seen)
        here = rows.select(key) if tombs is None else rows.select(key).unionByName(tombs.select(key))
        hidden = here.distinct() if hidden is None else hidden.unionByName(here).distinct()
    return out


def replaced(table: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """``table`` with all rows of each key in ``rows`` replaced by these: doing it twice changes nothing."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


# ---------------------------------------------------------------- captions


def caption_todo(documents: DataFrame, captions: DataFrame, jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, why): documents without caption, and machine captions of a text that is another by now; skipped ones are left alone.

    ``captions`` has path, name, source and text_hash, ``jobs`` path and state,
    ``texts`` path and text.  Texts under 200 letters and digits are too short to name.
    """
    skipped = jobs.where("state = 'skipped'").select("path").distinct()
    told = documents.select("path").join(captions, "path", "left").join(texts, "path", "left")
    missing = T.stripped(F.coalesce("name", F.lit(""))) == ""
    stale = ~missing & (F.coalesce("source", F.lit("")) != "person") & (F.coalesce("text_hash", F.lit("")) != T.identity_hash(F.coalesce("text", F.lit(""))))
    why = F.when(missing & (T.content_chars(F.coalesce("text", F.lit(""))) >= 200), "missing").when(stale, "stale")
    return told.withColumn("why", why).where("why is not null").join(skipped, "path", "left_anti").select("path", "why")


def captioned(captions: DataFrame, answers: DataFrame) -> DataFrame:
    """Captions with answers (same columns) in their places: what a person wrote is never replaced by a machine's, and faulty ones are void."""
    good = answers.where(T.caption_fault(F.col("name"), F.col("summary"), F.col("kind")).isNull()).withColumn("kind", T.normal_kind(F.col("kind"))).withColumn("name", T.flat(F.col("name")))
    held = captions.where("source = 'person'").select("path")
    fresh = good.where("source = 'person'").unionByName(good.where("source <> 'person'").join(held, "path", "left_anti"))
    return replaced(captions, fresh.select(captions.columns))


def caption_source(pages: DataFrame, log: DataFrame) -> DataFrame:
    """(path, text): what a caption is written from: each page's active reading, or its indexed text where that is blank."""
    active = versions(log).where("active").select("path", "page", F.col("text").alias("reading"))
    met = pages.join(active, ["path", "page"], "left")
    best = F.when(T.stripped(F.coalesce("reading", F.lit(""))) != "", F.col("reading")).otherwise(F.col("text"))
    return met.select("path", "page", best.alias("best")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "best")))["best"], SEPARATOR).alias("text"))


def caption_fragments(captions: DataFrame) -> DataFrame:
    """(path, page, ord, text, origin): one fragment for each caption, on page 0, which is searched but never taken for the document's words."""
    text = T.caption_text(F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("kind", F.lit("")), F.col("source"), F.col("model"))
    return captions.select("path", F.lit(0).alias("page"), F.lit(0).alias("ord"), text.alias("text"), F.lit("identity").alias("origin")).where("text <> ''")


# ---------------------------------------------------------------- lists


def summaries(documents: DataFrame, fragments: DataFrame, provenance: DataFrame) -> DataFrame:
    """(path, title, fragments, pages, vision_pages, engines): a row a document; generated fragments do not count.

    ``provenance`` has path, page and engine.
    """
    n = fragments.where("origin = ''").groupBy("path").agg(F.count("*").alias("fragments"))
    per = provenance.groupBy("path", "engine").agg(F.count("*").alias("n"))
    engines = per.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", "n")))).alias("engines"), F.sum("n").alias("pages"), F.sum(F.when(F.col("engine") == "vision", F.col("n")).otherwise(0)).alias("vision_pages"))
    met = documents.join(n, "path", "left").join(engines, "path", "left")
    return met.select("path", "title", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fragments", "pages", "vision_pages")), "engines")


def resolved(matches: DataFrame, most: int = 8) -> tuple[str | None, list[str]]:
    """The one path that a reference means, or None and up to ``most`` paths it could mean; none at all is an error."""
    rows = [r["path"] for r in matches.select("path").distinct().orderBy("path").limit(most + 1).collect()]
    if not rows:
        raise ValueError("no document matches")
    return (rows[0], []) if len(rows) == 1 else (None, rows[:most])


def whole_or_windows(pages: DataFrame, segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Fragments (the columns of ``segments``, and ``mode``) of which no text is missing.

    A document whose segments, which a model cut, keep too little of any page (see
    ``segment_alarms``) has its ``windows`` instead, all of them: how a document was cut
    is told of the whole document.
    """
    short = segment_alarms(pages, segments).select("path").distinct()
    good = segments.join(short, "path", "left_anti").withColumn("mode", F.lit("segments"))
    return good.unionByName(windows.select(segments.columns).join(short, "path", "left_semi").withColumn("mode", F.lit("windows")))


def segment_alarms(pages: DataFrame, fragments: DataFrame, least: int = 200, share: int = 60) -> DataFrame:
    """(path, page, given, kept): pages (path, page, text) of ``least`` letters and digits of which fragments (path, page, text) keep under ``share`` percent.

    A page that no fragment begins on is credited with what the page before has too much.
    """
    kept = fragments.groupBy("path", "page").agg(F.sum(T.content_chars(F.col("text"))).alias("emitted"))
    rows = pages.select("path", "page", T.content_chars(F.col("text")).alias("given")).join(kept, ["path", "page"], "left").withColumn("emitted", F.coalesce("emitted", F.lit(0)))
    order = Window.partitionBy("path").orderBy("page")
    extra = F.greatest(F.lag(F.col("emitted") - F.col("given")).over(order), F.lit(0))
    rows = rows.withColumn("kept", F.col("emitted") + F.when(F.col("emitted") > 0, 0).otherwise(F.coalesce(extra, F.lit(0))))
    return rows.where((F.col("given") >= least) & (F.col("kept") * 100 < F.col("given") * share)).select("path", "page", "given", "kept")


# ---------------------------------------------------------------- caption jobs and rereads


def caption_enqueued(jobs: DataFrame, paths: DataFrame, now: int, force: int = 0) -> DataFrame:
    """Caption jobs (path, state, force, error, enqueued_at, owner_pid), one a path, with ``paths`` pending; live ones stay as they are."""
    asked = paths.where("trim(path) <> ''").select("path").distinct()
    live = jobs.where("state in ('pending', 'running')").select("path")
    fresh = asked.join(live, "path", "left_anti")
    new = fresh.select("path", F.lit("pending").alias("state"), F.lit(force).alias("force"), F.lit("").alias("error"), F.lit(now).cast("long").alias("enqueued_at"), F.lit(0).cast("long").alias("owner_pid"))
    return jobs.join(fresh, "path", "left_anti").select(new.columns).unionByName(new)


def caption_jobs_in(jobs: DataFrame, state: str = "", limit: int = 0) -> DataFrame:
    """Caption jobs of a state (any where none is given), the latest first; ties by path; ``limit`` of them where one is given."""
    found = (jobs.where(F.col("state") == state) if state else jobs).orderBy(F.desc("enqueued_at"), "path")
    return found.limit(limit) if limit > 0 else found


def caption_claimed(jobs: DataFrame, owner: int, slots: int = 1) -> DataFrame:
    """The oldest pending caption jobs running under ``owner``, as many as there are slots."""
    first = jobs.where("state = 'pending'").orderBy("enqueued_at", "path").limit(slots).select("path", F.lit(True).alias("mine"))
    met = jobs.join(F.broadcast(first), "path", "left")  # slots rows
    return met.withColumn("state", F.when(F.col("mine"), "running").otherwise(F.col("state"))).withColumn("owner_pid", F.when(F.col("mine"), owner).otherwise(F.col("owner_pid"))).select(jobs.columns)


def caption_finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Caption jobs after results (path, error, short): done, an error, or skipped where the text was too short."""
    met = jobs.join(results.select("path", F.col("error").alias("fault"), "short", F.lit(True).alias("told")), "path", "left")
    over = F.coalesce(F.col("told") & (F.col("state") == "running"), F.lit(False))
    state = F.when(over & F.col("short"), "skipped").when(over & (F.coalesce("fault", F.lit("")) != ""), "error").when(over, "done").otherwise(F.col("state"))
    return met.withColumn("error", F.when(over, F.coalesce("fault", F.lit(""))).otherwise(F.col("error"))).withColumn("state", state).select(jobs.columns)


def purged(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """A page cache (sha, ...) without the images of ``pages`` (sha)."""
    return cache.join(pages.select("sha").distinct(), "sha", "left_anti")


def to_reread(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents with those of ``paths`` marked for another ingest: their hash is emptied."""
    met = documents.join(paths.select("path", F.lit(True).alias("again")).distinct(), "path", "left")
    return met.withColumn("content_hash", F.when(F.col("again"), "").otherwise(F.col("content_hash"))).select(documents.columns)


def stale(documents: DataFrame, recipe: str) -> DataFrame:
    """Documents that were cut by another recipe."""
    return documents.where(F.coalesce("frag_recipe", F.lit("")) != recipe)


def page_images(documents: DataFrame, provenance: DataFrame) -> DataFrame:
    """(path, page, engine, image_path) of pages that have an image."""
    return provenance.join(documents.select("path"), "path", "left_semi").where("coalesce(image_path, '') <> ''").select("path", "page", "engine", "image_path")


def engines_of(pages: DataFrame, provenance: DataFrame) -> DataFrame:
    """(path, page, engine): the engine that read each page; nothing is told by an empty name."""
    return pages.select("path", "page").join(provenance.select("path", "page", "engine"), ["path", "page"], "left").withColumn("engine", F.coalesce("engine", F.lit("")))


def sketched_paths(sketched: DataFrame, recipe: str) -> DataFrame:
    """Paths with a sketch of this recipe, in order."""
    return sketched.where(F.col("recipe") == recipe).select("path").distinct().orderBy("path")
