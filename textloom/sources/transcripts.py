"""Transcriptions, recognised words, audit logs, watched folders and fetched files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

NO_TEXT = "_(no text on this page)_"
MOST_BYTES = 64 << 20
_HEADING = r"(?m)^##\s+Page\s+(\d+)\s*$"


def render(pages: DataFrame) -> DataFrame:
    """(path, transcript): a ``## Page N`` section for each of the pages (path, page, text), in order, empty ones too.

    ``figures`` (array of kind and description), if there, follow a page's text; a
    page without figures that does not look like text has a warning before it.
    """
    bare = T.stripped(F.col("text"))
    has = "figures" in pages.columns
    marks = F.coalesce(F.array_join(F.transform("figures", lambda f: F.concat(F.lit("\n> **"), F.coalesce(f["kind"], F.lit("figure")), F.lit(":** "), F.trim(f["description"]), F.lit("\n"))), ""), F.lit("")) if has else F.lit("")
    none = F.size(F.coalesce("figures", F.array())) == 0 if has else F.lit(True)
    doubt = F.when(none & (T.suspicion(F.col("text")) != ""), F.concat(F.lit("\n> ⚠ Check this page against the original: "), T.suspicion(F.col("text")), F.lit("\n"))).otherwise("")
    section = F.concat(doubt, F.lit("\n## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.when(bare == "", NO_TEXT).otherwise(bare), F.lit("\n"), marks)
    head = F.concat(F.lit("# Transcription: "), F.regexp_extract("path", r"([^/]*)$", 1), F.lit("\n"))
    listed = pages.select("path", F.struct("page", section.alias("section")).alias("x")).groupBy("path").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("path", F.concat(head, F.array_join("x.section", "")).alias("transcript"))


def parse(transcripts: DataFrame) -> DataFrame:
    """(path, page, text): the pages of transcripts (path, transcript) from the first to the last number; own warnings go, figures stay."""
    texts = F.slice(F.split("transcript", _HEADING), 2, 1 << 30)
    numbers = F.regexp_extract_all("transcript", F.lit(_HEADING), 1)
    rows = transcripts.select("path", F.explode(F.arrays_zip(numbers.alias("n"), texts.alias("t"))).alias("x")).select("path", F.col("x.n").cast("int").alias("page"), F.col("x.t").alias("t"))
    clean = T.stripped(F.regexp_replace("t", r"(?m)^(?:>\s*⚠.*|_\(no text on this page\)_)$", ""))
    found = rows.where("page > 0").groupBy("path", "page").agg(F.max(clean).alias("text"))
    slots = found.groupBy("path").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).select("path", F.explode(F.sequence("lo", "hi")).alias("page"))
    return slots.join(found, ["path", "page"], "left").select("path", "page", F.coalesce("text", F.lit("")).alias("text"))


def suspect_pages(pages: DataFrame) -> DataFrame:
    """(path, page, why): pages that do not look like text, but for those that hold a figure."""
    why = T.suspicion(F.col("text"))
    return pages.where(~F.col("text").contains("> **")).select("path", "page", why.alias("why")).where("why <> ''")


def recognised(tsv: Column) -> Column:
    """(text, words, confidence, glyph) of a recogniser's table of words.

    Of rows of level 5 with a word and a confidence from 0, the words in order: a
    line break where block, paragraph or line change.  ``confidence`` is the mean
    as a share, ``glyph`` the upper median of the words' smaller sides in pixels.
    """
    rows = F.transform(F.slice(F.split(tsv, "\n"), 2, 1 << 30), lambda x: F.split(x, "\t"))
    cell = lambda r, i: F.try_element_at(r, F.lit(i + 1))
    good = F.filter(rows, lambda r: (F.size(r) >= 12) & (cell(r, 0) == "5") & (T.stripped(cell(r, 11)) != "") & F.coalesce(cell(r, 10).try_cast("double") >= 0, F.lit(False)))
    words = F.transform(good, lambda r: F.struct(F.concat_ws("/", cell(r, 2), cell(r, 3), cell(r, 4)).alias("line"), T.stripped(cell(r, 11)).alias("word"), cell(r, 10).try_cast("double").alias("conf"), F.least(cell(r, 8).try_cast("int"), cell(r, 9).try_cast("int")).alias("side"), F.least(cell(r, 8).try_cast("int"), cell(r, 9).try_cast("int")).isNotNull().alias("sized")))
    step = lambda s, w: F.struct(w["line"].alias("line"), F.concat(s["text"], F.when(s["text"] == "", "").when(s["line"] == w["line"], " ").otherwise("\n"), w["word"]).alias("text"))
    text = F.aggregate(words, F.struct(F.lit("").alias("line"), F.lit("").alias("text")), step, lambda s: s["text"])
    sides = F.array_sort(F.transform(F.filter(words, lambda w: F.coalesce(w["side"] > 0, F.lit(False))), lambda w: w["side"]))
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["conf"])
    return F.struct(text.alias("text"), F.size(words).alias("words"), F.when(F.size(words) > 0, total / F.size(words) / 100).otherwise(0.0).alias("confidence"), F.coalesce(F.try_element_at(sides, (F.size(sides) / 2).cast("int") + 1), F.lit(0)).alias("glyph"))


def render_dpi(glyph: Column, base: int = 200, want: int = 20, least: int = 14, low: int = 200, high: int = 600) -> Column:
    """Dots an inch at which to render a page again so that its letters are ``want`` pixels; ``base`` where they are large enough or none were found."""
    return F.when((glyph > 0) & (glyph < least), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(base * want) / glyph).cast("int")))).otherwise(base)


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a log of JSON lines; blank lines and those from ``#`` on are skipped, a malformed one is an error."""
    entry = F.expr("case when trim(value) <> '' and not startswith(ltrim(value), '#') then value end")  # filters may change places: comments never reach the parser
    lines = spark.read.text(path).select(entry.alias("value")).where("value is not null")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def changes(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, change): what a watched folder's listing (path, modified) has that ``seen`` has not: new, changed or gone."""
    met = seen.select("path", F.col("modified").alias("before")).join(listing.select("path", F.col("modified").alias("now")), "path", "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") != F.col("now"), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def fetched(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, modified, bytes, content, error) of local or shared files; larger ones than ``most`` have an error and no content."""
    files = spark.read.format("binaryFile").load(path)
    large = F.col("length") > most
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.when(~large, F.col("content")).alias("content"), F.when(large, "the file is too large").alias("error"))


def stored_name(path: Column) -> Column:
    """The name of a stored copy: a tag of the whole path, and the base name."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 8), F.lit("-"), F.regexp_extract(path, r"([^/]*)$", 1))


def page_image_name(path: Column, page: Column, mime: Column) -> Column:
    """Where a page's image is kept."""
    ext = F.create_map(*(F.lit(x) for pair in {"image/png": "png", "image/jpeg": "jpg", "image/tiff": "tif", "image/webp": "webp"}.items() for x in pair))[mime]
    return F.concat(F.substring(F.sha2(path, 256), 1, 8), F.lit("-p"), page.cast("string"), F.lit("."), F.coalesce(ext, F.lit("bin")))


# ---------------------------------------------------------------- pool of finished documents


def exported(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, fragments): each document's own fragments in order with their vectors (null where one has none)."""
    met = fragments.where("origin = ''").join(vectors.select("frag_id", "vector"), "frag_id", "left")
    return met.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "ord", "text", "start_off", "end_off", "vector"))).alias("fragments"))


def imported(pooled: DataFrame) -> DataFrame:
    """Fragments (path, page, ord, text, start_off, end_off, vector) of pooled documents."""
    return pooled.select("path", F.explode("fragments").alias("f")).select("path", "f.*")


def pool_hits(pool: DataFrame, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(payloads of ``wanted`` (recipe_hash, file_hash), the pool with these used ``now``)."""
    keys = ["recipe_hash", "file_hash"]
    asked = wanted.select(keys).distinct().withColumn("asked", F.lit(True))
    touched = pool.join(asked, keys, "left").withColumn("last_used_at", F.when(F.col("asked"), now).otherwise(F.col("last_used_at"))).select(pool.columns)
    return pool.join(asked, keys, "left_semi"), touched


def recipe(mode: str, window: int, stride: int, tail: int, extra: str = "") -> str:
    """The hash of how fragments were made: a change of a parameter marks what it affects."""
    import hashlib

    return hashlib.sha256(f"{mode}|{window}|{stride}|{tail}|{extra}".encode()).hexdigest()
