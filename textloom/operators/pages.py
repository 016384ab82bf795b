"""Pages of documents: windows with page spans, pages of hits, reassembly, true pages, ranges and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


def joined_pages(pages: DataFrame) -> DataFrame:
    """(path, text, spans): a document's pages in order, and where each begins in the joined text."""
    listed = pages.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["text"]) + len(SEPARATOR)).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("off"), x["page"].alias("page")))).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<off:int,page:int>>)").alias("spans"))
    return listed.select("path", F.array_join("p.text", SEPARATOR).alias("text"), F.aggregate("p", start, step, lambda s: s["spans"]).alias("spans"))


def page_at(start_page: Column, spans: Column, off: Column) -> Column:
    """The page of the last span at or before an offset; the start page where there is none."""
    before = F.filter(F.coalesce(spans, F.array()), lambda s: s["off"] <= off)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], start_page)


def spans_within(spans: Column, low: Column, high: Column) -> Column:
    """The page spans inside [low, high), moved to begin at 0; null where it lies on one page."""
    first = F.struct(F.lit(0).alias("off"), page_at(F.lit(0), spans, low).alias("page"))
    inside = F.transform(F.filter(spans, lambda s: (s["off"] > low) & (s["off"] < high)), lambda s: F.struct((s["off"] - low).cast("int").alias("off"), s["page"].alias("page")))
    return F.when(F.size(inside) > 0, F.concat(F.array(first), inside))


def plain_windows(pages: DataFrame, window: int, stride: int) -> DataFrame:
    """(path, frag_id, page, ord, start_off, end_off, text, page_spans, origin): windows of fixed length over the joined pages.

    A window begins every ``stride`` characters, until one reaches the end.  ``page``
    is where it begins, ``ord`` its number among those of its document that begin there.
    """
    whole = joined_pages(pages).where(F.length("text") > 0)
    count = F.ceil(F.greatest(F.length("text") - window, F.lit(0)) / stride).cast("int")
    at = whole.select("path", "text", "spans", F.explode(F.transform(F.sequence(F.lit(0), count), lambda i: i * stride)).alias("start_off"))
    at = at.withColumn("end_off", F.least(F.col("start_off") + window, F.length("text")))
    cut = at.select("path", page_at(F.lit(0), F.col("spans"), F.col("start_off")).alias("page"), "start_off", "end_off", F.substr("text", F.col("start_off") + 1, F.col("end_off") - F.col("start_off")).alias("text"), spans_within(F.col("spans"), F.col("start_off"), F.col("end_off")).alias("page_spans"))
    order = F.row_number().over(Window.partitionBy("path", "page").orderBy("start_off")) - 1
    return cut.select("path", F.concat("path", F.lit("@"), "start_off").alias("frag_id"), "page", order.alias("ord"), "start_off", "end_off", "text", "page_spans", F.lit("").alias("origin"))


def query_terms(query: str) -> list[str]:
    """The words of a search expression: marks and operators are no text to look for."""
    bare = "".join(" " if c in '"()*:^-+' else c for c in query).lower()
    return [w for w in bare.split() if len(w) > 1 and w not in ("and", "or", "not", "near")]


def first_term(text: Column, query: str) -> Column:
    """Offset of the first query term in a text; null without one."""
    found = [F.nullif(F.instr(F.lower(text), t), F.lit(0)) for t in query_terms(query)]
    return (F.least(*found) if len(found) > 1 else found[0] if found else F.expr("cast(null as int)")) - 1


def hit_page(start_page: Column, spans: Column, text: Column, query: str) -> Column:
    """The page that the first query term of a fragment is on."""
    off = first_term(text, query)
    return F.when((F.size(F.coalesce(spans, F.array())) > 1) & off.isNotNull(), page_at(start_page, spans, off)).otherwise(start_page)


def _fresh(fragments: DataFrame) -> DataFrame:
    """Fragments with ``skip``: how much of each an earlier one of its document has brought; wholly covered ones go.

    Fragments without offsets bring all they have.
    """
    order = Window.partitionBy("path").orderBy("start_off", "page", "ord").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end_off").over(order), F.lit(0))
    placed = F.col("end_off") > F.col("start_off")
    marked = fragments.where("origin = ''").withColumn("covered", covered)
    marked = marked.where(~placed | (F.col("end_off") > F.col("covered")))
    return marked.withColumn("skip", F.when(placed, F.greatest(F.col("covered") - F.col("start_off"), F.lit(0))).otherwise(F.lit(0))).where(F.col("skip") <= F.length("text"))


def document_text(fragments: DataFrame, low: int = 0, high: int = 0, max_chars: int = 0) -> DataFrame:
    """(path, text, truncated, pages): documents put together from their fragments on pages ``low`` to ``high`` (0: open).

    Overlap is told by offsets; without offsets pages are joined by a blank line.
    ``pages`` are runs of fragments that begin on one page.  ``max_chars`` cuts the
    text, and the pages at the same place.
    """
    rows = fragments
    if low > 0:
        rows = rows.where(F.col("page") >= low)
    if high > 0:
        rows = rows.where(F.col("page") <= high)
    rows = _fresh(rows)
    offsets = F.max((F.col("end_off") > F.col("start_off")).cast("int")).over(Window.partitionBy("path"))
    order = Window.partitionBy("path").orderBy("start_off", "page", "ord")
    new = F.coalesce((F.col("page") != F.lag("page").over(order)).cast("int"), F.lit(1))
    rows = rows.select("path", "page", "start_off", "ord", F.expr("substring(text, skip + 1)").alias("piece"), offsets.alias("offsets"), new.alias("new"))
    rows = rows.withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy("path", "offsets", "run", "page").agg(F.sort_array(F.collect_list(F.struct("start_off", "ord", "piece"))).alias("x"))
    glue = F.when(F.col("offsets") == 1, F.lit("")).otherwise(F.lit(SEPARATOR))
    runs = runs.select("path", "offsets", "run", "page", F.when(F.col("offsets") == 1, F.array_join("x.piece", "")).otherwise(F.array_join("x.piece", SEPARATOR)).alias("text"))
    docs = runs.groupBy("path", "offsets").agg(F.sort_array(F.collect_list(F.struct("run", "page", "text"))).alias("p"))
    docs = docs.withColumn("glue", glue).withColumn("text", F.when(F.col("offsets") == 1, F.array_join("p.text", "")).otherwise(F.array_join("p.text", SEPARATOR)))
    pages = F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))
    if max_chars > 0:
        pages = F.when(F.length("text") > max_chars, capped(pages, max_chars)).otherwise(pages)
    text = F.substring("text", 1, max_chars) if max_chars > 0 else F.col("text")
    return docs.select("path", text.alias("text"), (F.length("text") > max_chars).alias("truncated") if max_chars > 0 else F.lit(False).alias("truncated"), pages.alias("pages"))


def capped(pages: Column, max_chars: int) -> Column:
    """Pages up to ``max_chars`` of their joined text: whole ones, the one that straddles the cap cut, later ones gone."""
    step = lambda s, p: F.struct(
        (s["used"] + F.length(p["text"]) + len(SEPARATOR)).alias("used"),
        F.when(s["used"] < max_chars, F.concat(s["out"], F.array(F.struct(p["page"].alias("page"), F.substr(p["text"], F.lit(1), max_chars - s["used"]).alias("text"))))).otherwise(s["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<page:int,text:string>>)").alias("out"))
    return F.aggregate(pages, start, step, lambda s: s["out"])


def true_pages(fragments: DataFrame) -> DataFrame:
    """(path, page, text): documents at the grain of their real pages, from the first to the last, blank ones too.

    Each fragment's text past what earlier ones brought is cut at its page spans;
    the pieces of a page are joined by a blank line.  A fragment without spans
    belongs to the page it begins on.
    """
    rows = _fresh(fragments)
    spans = F.when(F.size(F.coalesce("page_spans", F.array())) > 1, F.col("page_spans")).otherwise(F.array(F.struct(F.lit(0).alias("off"), F.col("page").alias("page"))))
    rows = rows.withColumn("s", spans).withColumn("n", F.length("text"))
    inner = F.filter("s", lambda x: (x["off"] > F.col("skip")) & (x["off"] <= F.col("n")))
    cuts = F.concat(F.array(F.struct(F.col("skip").cast("int").alias("off"), page_at(F.col("page"), F.col("s"), F.col("skip")).alias("page"))), inner)
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts")), lambda i: F.struct(F.element_at("cuts", i)["page"].alias("page"), F.element_at("cuts", i)["off"].alias("low"), F.coalesce(F.try_element_at("cuts", i + 1)["off"], F.col("n")).alias("high")))
    cut = rows.withColumn("cuts", cuts).select("path", "text", "start_off", F.col("page").alias("from_page"), "ord", F.posexplode(pieces).alias("at", "x"))
    found = cut.select("path", F.col("x.page").alias("page"), F.struct("start_off", "from_page", "ord", "at", F.substr("text", F.col("x.low") + 1, F.col("x.high") - F.col("x.low")).alias("piece")).alias("x"))
    texts = found.groupBy("path", "page").agg(F.array_join(F.filter(F.sort_array(F.collect_list("x"))["piece"], lambda p: p != ""), SEPARATOR).alias("text"))
    bounds = texts.groupBy("path").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    slots = bounds.select("path", F.explode(F.sequence("lo", "hi")).alias("page"))
    return slots.join(texts, ["path", "page"], "left").select("path", "page", F.coalesce("text", F.lit("")).alias("text"))


def figure_rows(fragments: DataFrame) -> DataFrame:
    """(path, ord, page, frag_id, description): a row for each figure mark, numbered through its document."""
    from textloom.functions.text import figures

    marks = fragments.where("origin = ''").select("path", "page", "frag_id", F.col("ord").alias("frag_ord"), F.posexplode(figures(F.col("text"))).alias("at", "description"))
    order = Window.partitionBy("path").orderBy("page", "frag_ord", "at")
    return marks.select("path", (F.row_number().over(order) - 1).alias("ord"), "page", "frag_id", "description")


def page_review(fragments: DataFrame, provenance: DataFrame) -> DataFrame:
    """(path, page, engine, text): each page of ``provenance`` with its fragments in order."""
    texts = fragments.where("origin = ''").groupBy("path", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"], SEPARATOR).alias("text"))
    return provenance.join(texts, ["path", "page"], "left").select("path", "page", "engine", F.coalesce("text", F.lit("")).alias("text"))
