"""Retrieval: BM25, cosine, reciprocal rank fusion, scopes and representatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stem import stem
from textloom.functions.text import tokens
from textloom.plans.tasks import spread, written

K1, B, RRF = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: str, terms: Column | None = None) -> DataFrame:
    """(term, key, tf, dl), of all terms or those that ``terms`` holds for: aggregated on the map side before the one shuffle."""
    listed = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("terms"))
    rows = listed.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return (rows if terms is None else rows.where(terms)).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, cf): how many documents have each term, and how often they do.

    Rows of one key are one document, and rows without key are in none.  Terms are counted
    where the texts are, a row for each term of a batch; texts cross the network once, by key.
    """

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(batch.column(0).value_lengths(), 0).to_numpy()
            coded = batch.column(0).flatten().dictionary_encode()
            code, n = coded.indices.to_numpy(), len(coded.dictionary)
            first = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + code) if n else np.zeros(0, np.int64)
            own = batch.column(1).to_numpy(zero_copy_only=False)[first // n] if n else first
            df = np.bincount((first % n)[own], minlength=n) if n else first
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df, pa.int64()), pa.array(np.bincount(code, minlength=n), pa.int64())], names=["term", "df", "cf"])

    whole = docs.select(key, text).groupBy(key).agg(F.collect_list(text).alias("texts"))
    listed = whole.select(F.flatten(F.transform("texts", tokens)).alias("terms"), F.col(key).isNotNull().alias("keyed"))
    return spread(listed).mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _equal_to(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], stemmed: bool = False) -> DataFrame:
    """(key, score) of all rows with a query term.  Only the query's terms are counted in each text: nothing is exploded.

    With ``stemmed``, texts and query are compared by their English stems.
    """
    if stemmed:
        counts = _stem_counts(docs, key, text, [stem(t.lower()) for t in query])
    else:
        listed = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("terms"))
        counts = listed.select(key, F.size("terms").alias("dl"), *(F.size(F.filter("terms", _equal_to(t))).alias(f"tf{i}") for i, t in enumerate(query)))
    facts = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    joined = counts.where(" or ".join(f"tf{i} > 0" for i in range(len(query)))).crossJoin(F.broadcast(facts))  # one row of facts
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.select(key, score.alias("score"))


def _stem_counts(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, dl, tf0, tf1, ...) of each text: how many of its tokens have each stem of the query.

    Different words of a batch are stemmed once, where they are: no row for a token leaves its text.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [f"tf{i}" for i in range(len(query))]

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy()
            coded = batch.column(2).flatten().dictionary_encode()
            stemmed = np.array([stem(w) for w in coded.dictionary.to_pylist()], object)
            code, own = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            counts = [np.bincount(own[(stemmed == t)[code]] if len(code) else own, minlength=len(sizes)) for t in query]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in counts)], names=[key, "dl", *names])

    listed = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("terms")).select(key, F.size("terms").alias("dl"), "terms")
    return written(listed.mapInArrow(run, f"{key} {kind}, dl int, {', '.join(f'{n} int' for n in names)}"))


def top(hits: DataFrame, key: str, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), key).limit(k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, key: str, vector: str, query: DataFrame) -> DataFrame:
    """(key, score) against the one row of ``query`` (q); a zero vector scores 0."""
    both = vectors.crossJoin(F.broadcast(query.limit(1)))
    norm = F.sqrt(_dot(F.col(vector), F.col(vector))) * F.sqrt(_dot(F.col("q"), F.col("q")))
    return both.select(key, F.coalesce(_dot(F.col(vector), F.col("q")) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("score"))


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (key, score): the sum of 1 / (60 + rank), ranks from 0."""
    ranked = [x.select(key, (1 / (RRF + F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)).alias("part")) for x in lists]
    both = ranked[0]
    for x in ranked[1:]:
        both = both.unionByName(x)
    return both.groupBy(key).agg(F.sum("part").alias("score"))


def best_of_each(hits: DataFrame, group: str, key: str) -> DataFrame:
    """Each group's best hit."""
    return hits.groupBy(group).agg(F.max_by(F.struct(key, "score"), F.struct(F.col("score"), -F.col(key))).alias("x")).select(group, f"x.{key}", "x.score")


def under(path: str, prefix: str) -> Column:
    return F.startswith(F.col(path), F.lit(prefix))


def match_documents(docs: DataFrame, ref: str) -> DataFrame:
    """Exact path matches; where there are none, all whose path or title has the reference, in any case."""
    exact = docs.where(F.col("path") == ref)
    like = docs.where(F.lower("path").contains(ref.lower()) | F.lower("title").contains(ref.lower()))
    none = exact.agg(F.count("*").alias("exact"))
    return exact.unionByName(like.crossJoin(F.broadcast(none)).where("exact = 0").drop("exact"))


def overlay(main: DataFrame, branch: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """A branch over its parent: parent rows that are neither replaced nor deleted, and the branch's own."""
    shadow = branch.select(key).unionByName(tombstones.select(key)).distinct()
    return main.join(shadow, key, "left_anti").unionByName(branch)


def weighted(rows: DataFrame, facts: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, score) from postings rows (term, key, tf, dl) of the query's terms and one row of ``facts`` (n, avgdl)."""
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    times = F.create_map(*(F.lit(x) for t in set(terms) for x in (t, float(terms.count(t)))))[F.col("term")]
    met = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(facts))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy(key).agg(F.sum(part).alias("score"))


def phrases(query: str) -> list[list[str]]:
    """The tokens of each word of a query: a word that splits is a phrase."""
    import re

    return [t for t in ([x.lower() for x in re.findall(r"[^\W_]+", w)] for w in query.split()) if t]


def phrase_search(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of rows with any word of ``query``; a word that splits into several tokens counts where they follow each other."""
    wanted = phrases(query)
    # tokens with a blank on both sides: a phrase is counted where its tokens stand, overlaps too
    listed = spread(docs.select(key, text)).select(key, F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" ")).alias("line"))
    counts = listed.select(key, F.greatest(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) - 1, F.lit(0)).alias("dl"), *(F.regexp_count("line", F.lit(f"(?= {' '.join(p)} )")).alias(f"tf{i}") for i, p in enumerate(wanted)))
    facts = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    if not wanted:
        return docs.where("false").select(key, F.lit(0.0).alias("score"))
    hits = counts.where(" or ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(facts))  # one row of facts
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select(key, score.alias("score"))


def selected(index: Column, selector: str) -> Column:
    """Rows of the indexes that a selector names: all, a list with commas, ``prefix*``."""
    parts = [p.strip() for p in selector.split(",") if p.strip()]
    if selector.strip() in ("", "all"):
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | (index.startswith(p[:-1]) if p.endswith("*") else index == p)
    return out


def scoped(selector: str, own: str, shared: list[str] = (), mark: str = "__") -> str:
    """A selector in a namespace: bare names are its own, ``other:name`` must be shared; what cannot be reached matches nothing."""
    import re

    name = lambda s: re.sub("[^a-z0-9_-]", "", s.lower()) or "default"
    if not own:
        return selector.strip()
    if selector.strip() in ("", "all"):
        return ",".join(f"{n}{mark}*" for n in dict.fromkeys([own, *(s for s in shared if s)]))
    out = []
    for token in (t.strip() for t in selector.split(",")):
        space, colon, local = token.partition(":")
        if not token:
            continue
        if not colon:
            out.append(own + mark + name(token))
        elif name(space) == own or name(space) in shared:
            out.append(name(space) + mark + ("*" if local.strip() == "*" else name(local)))
    return ",".join(out) or f"{mark}nothing{mark}"


def across_indexes(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """The best of several indexes' hits (index, key, score): ranked by fused rank, with their own scores.

    Each index gives its ``2 * limit`` best; ranks count from 0 in an index.
    """
    from textloom.operators.prefix import last_rows

    best = last_rows(hits.withColumn("_order", F.struct("score", -F.col(key))), ["index"], "_order", 2 * limit)
    rank = F.row_number().over(Window.partitionBy("index").orderBy(F.desc("score"), key)) - 1
    fused = best.withColumn("fused", 1 / (RRF + rank))
    return fused.orderBy(F.desc("fused"), "index", key).limit(limit).select("index", key, "score", "fused")


def figure_search(media: DataFrame, vectors: DataFrame, documents: DataFrame, query: DataFrame, limit: int = 10, prefix: str = "") -> DataFrame:
    """(media_id, path, title, page, description, score): figures whose vectors a text query can be held against, by cosine.

    ``media`` has media_id, path, page and description, ``vectors`` media_id, space
    and vector; of the spaces only text and images aligned with it are comparable.
    """
    usable = vectors.where(F.col("space").isin("text", "image-aligned"))
    scored = cosine(usable, "media_id", "vector", query)
    rows = media.where(under("path", prefix)) if prefix else media
    met = scored.join(rows, "media_id").join(documents.select("path", "title"), "path")
    return met.orderBy(F.desc("score"), "media_id").limit(limit).select("media_id", "path", "title", "page", "description", "score")
