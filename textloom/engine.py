"""One object over an index's tables: every method is a plan and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import attest, health, jobs, overlap, pages, queue, records, search, similar

TABLES = ("documents", "fragments", "vectors", "media", "media_vectors", "provenance", "jobs", "job_stages", "readings", "marks", "slices", "notes", "withdrawals", "captions", "caption_jobs", "units", "rulings")


class Engine:
    """``tables``: names of TABLES -> DataFrames; see ``plans.model`` for their columns.  Methods fail where a table they need is missing."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self.spark, self.tables = spark, dict(tables)

    @classmethod
    def of(cls, indexes, name: str) -> "Engine":
        """An engine over a stored index (``sources.folder.Indexes``); a branch shows its parents' rows where it has none of its own."""
        from textloom.sources.folder import SCHEMAS

        own = indexes.open(name, read_only=True)
        tables = {t: indexes.overlaid(name, t) if "path string" in ddl.split(", ") and t not in ("tombstones", "withdrawals") else own.read(t) for t, ddl in SCHEMAS.items() if t in TABLES}
        tables["documents"] = tables["documents"].withColumn("index", F.lit(name))
        return cls(indexes.spark, tables)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the engine has no table {name!r}")
        return self.tables[name]

    # ---- search

    def search(self, query: str, mode: str = "bm25", limit: int = 10, path: str = "", index: str = "", vector: DataFrame | None = None) -> DataFrame:
        """(frag_id, path, title, page, score, text, origin): the best fragments; modes bm25, vec and hybrid (these need the query's ``vector``)."""
        limit = limit if limit > 0 else 10
        frags = self["fragments"]
        if mode not in ("bm25", "vec", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode != "bm25" and vector is None:
            raise ValueError(f"{mode} needs the query's vector")
        docs = self["documents"]
        docs = docs.where(search.selected(F.col("index"), index)) if index else docs
        docs = docs.where(search.under("path", path)) if path else docs
        scope = frags.join(docs.select("path", "title"), "path")
        lexical = search.phrase_search(frags, "frag_id", "text", query).join(scope.select("frag_id"), "frag_id", "left_semi") if mode != "vec" else None
        dense = search.cosine(self["vectors"], "frag_id", "vector", vector).join(scope.select("frag_id"), "frag_id", "left_semi") if mode != "bm25" else None
        if mode == "hybrid":
            scored = search.fuse([search.top(lexical, "frag_id", 4 * limit), search.top(dense, "frag_id", 4 * limit)], "frag_id")
        else:
            scored = lexical if mode == "bm25" else dense
        best = search.top(scored, "frag_id", limit)
        page = pages.hit_page(F.col("page"), F.col("page_spans"), F.col("text"), query)
        return best.join(scope, "frag_id").select("frag_id", "path", "title", page.alias("page"), "score", "text", "origin").orderBy(F.desc("score"), "frag_id")

    def find(self, query: str, limit: int = 10) -> DataFrame:
        """The best fragment of each document."""
        hits = search.phrase_search(self["fragments"], "frag_id", "text", query).join(self["fragments"].select("frag_id", "path"), "frag_id")
        best = hits.groupBy("path").agg(F.max_by(F.struct("frag_id", "score"), F.struct("score", "frag_id")).alias("x"))
        return best.select("path", "x.frag_id", "x.score").orderBy(F.desc("score"), "path").limit(limit)

    def search_figures(self, vector: DataFrame, limit: int = 10, path: str = "") -> DataFrame:
        return search.figure_search(self["media"], self["media_vectors"], self["documents"], vector, limit, path)

    # ---- documents

    def list_indexes(self) -> DataFrame:
        return self["documents"].groupBy("index").agg(F.count("*").alias("documents"))

    def list_documents(self) -> DataFrame:
        return records.summaries(self["documents"], self["fragments"], self["provenance"])

    def match_documents(self, ref: str) -> DataFrame:
        return search.match_documents(self["documents"], ref)

    def get_document(self, ref: str, low: int = 0, high: int = 0, max_chars: int = 0) -> DataFrame:
        """The text of the one document that ``ref`` means; an error where it means none or several."""
        path, others = records.resolved(self.match_documents(ref))
        if path is None:
            raise ValueError(f"{ref!r} could be {others}")
        return pages.document_text(self["fragments"].where(F.col("path") == path), low, high, max_chars)

    def true_pages(self, path: str = "") -> DataFrame:
        frags = self["fragments"]
        return pages.true_pages(frags.where(F.col("path") == path) if path else frags)

    def review(self, path: str) -> DataFrame:
        own = F.col("path") == path
        return pages.page_review(self["fragments"].where(own), self["provenance"].where(own)).orderBy("page")

    def document_detail(self, path: str) -> dict[str, DataFrame]:
        """All that is known of a document, by table."""
        own = F.col("path") == path
        out = {"pages": self.true_pages(path)}
        for name in ("media", "notes", "captions", "readings", "slices"):
            if name in self.tables:
                table = self[name]
                out[name] = table.where(F.col("parent") == path if name == "slices" else own)
        if "marks" in self.tables:
            out["marks"] = records.marks_of(self["marks"], path)
        if "jobs" in self.tables:
            out["jobs"] = self["jobs"].where((F.col("url") == path) & F.col("state").isin(*queue.LIVE))
        out["copies"] = overlap.copies(self["documents"], "path", "text").where(own) if "text" in self["documents"].columns else self["documents"].where("false")
        return out

    def ingest(self, requests: DataFrame) -> DataFrame:
        """The jobs that requests (url, title, fresh, at) add; withdrawn paths are refused."""
        if "withdrawals" in self.tables:
            requests = requests.join(self["withdrawals"].select(F.col("path").alias("url")), "url", "left_anti")
        return queue.enqueued(self["jobs"], requests)

    def forget(self, paths: DataFrame) -> "Engine":
        """An engine without these documents and all that hangs on them."""
        gone = paths.select("path").distinct()
        keep = {n: t.join(gone, "path", "left_anti") if "path" in t.columns and n != "withdrawals" else t for n, t in self.tables.items()}
        return Engine(self.spark, keep)

    def withdraw(self, requests: DataFrame) -> "Engine":
        """An engine without the documents of requests (path, reason), which are kept as withdrawals."""
        _, good = records.withdrawn(self["documents"], requests)
        out = self.forget(good)
        out.tables["withdrawals"] = records.replaced(self["withdrawals"], good)
        return out

    def restore(self, paths: DataFrame) -> "Engine":
        return Engine(self.spark, self.tables | {"withdrawals": records.restored(self["withdrawals"], paths)})

    # ---- likeness

    def similar(self, least_cover: float = 0.0, **options) -> DataFrame:
        """All similar pairs of documents."""
        docs = self["documents"]
        return similar.similar_pairs(docs, docs, "path", "text", least_cover=least_cover, **options)

    def todo(self, pairs: DataFrame) -> DataFrame:
        """Pairs nobody ruled on, with what could be ruled."""
        open_ = records.unmarked(pairs, self["marks"])
        told = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(open_.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").drop("x", "y")
        return told.withColumn("proposal", similar.proposal(F.col("relation"), F.col("only_in_a"), F.col("only_in_b"), F.col("a_cover"), F.col("b_cover"), F.col("jaccard"), F.col("matched_chars")))

    def diff(self, a: str, b: str) -> DataFrame:
        """Each page of document ``a`` with its best page of ``b``; nothing is masked."""
        side = lambda p: self.true_pages(p).select(F.lit(0).alias("pair"), "page", "text")
        return similar.page_matches(side(a), side(b))

    def same_bytes(self) -> DataFrame:
        return overlap.copies(self["documents"], "path", "text")

    # ---- queue and health

    def index_status(self) -> DataFrame:
        return queue.status(self["jobs"])

    def active_jobs(self) -> DataFrame:
        return queue.active(self["jobs"])

    def list_jobs(self, state: str = "", limit: int = 0) -> DataFrame:
        return queue.listed(self["jobs"], state, limit)

    def command_jobs(self, commands: DataFrame, now: int) -> "Engine":
        """An engine after retry, cancel, forget, abort, complete and fail commands (id, action, note)."""
        return Engine(self.spark, self.tables | {"jobs": queue.moved(self["jobs"], commands, now)})

    def problems(self, files: DataFrame | None = None) -> DataFrame:
        return health.problems(self["documents"], self["fragments"], self["provenance"], self["jobs"], self["job_stages"], self["withdrawals"], files).orderBy("rank", "subject", "job_id")

    # ---- people's words

    def active_readings(self) -> DataFrame:
        return records.versions(self["readings"]).where("active")

    def reading_history(self, path: str) -> DataFrame:
        return records.versions(self["readings"].where(F.col("path") == path)).orderBy("page", "seq")

    def marks_of(self, path: str) -> DataFrame:
        return records.marks_of(self["marks"], path)

    def slice_coverage(self) -> DataFrame:
        last = self.true_pages().groupBy(F.col("path").alias("parent")).agg(F.max("page").alias("pages"))
        return records.slice_coverage(last, self["slices"])

    def materialize_slices(self) -> DataFrame:
        return records.slice_fragments(self.true_pages(), self["slices"])

    def propose_slices(self) -> DataFrame:
        return records.slice_proposals(self.true_pages())

    def attestations(self) -> DataFrame:
        return attest.states(self["units"], self["rulings"])

    def provenance_sentences(self) -> DataFrame:
        return attest.provenance(attest.stats(self["units"], self["rulings"]), self["documents"])

    def caption_todo(self) -> DataFrame:
        texts = pages.document_text(self["fragments"]).select("path", "text")
        return records.caption_todo(self["documents"], self["captions"], self["caption_jobs"], texts)

    def notes_of(self, path: str) -> DataFrame:
        return self["notes"].where(F.col("path") == path)

    def citations(self) -> DataFrame:
        return records.citations(self["withdrawals"], self["fragments"])

    def unsuited(self) -> DataFrame:
        """Documents whose text is too long for one line of code to be prose: generated or minified."""
        docs = self["documents"]
        return docs.where(T.generated(F.col("path")) | F.coalesce(T.minified(F.col("text")), F.lit(False))).select("path")

    def latest(self, table: str, keys: list[str], order: str, *columns: str) -> DataFrame:
        return jobs.latest(self[table], keys, F.col(order), *columns)


def search_all(engines: Mapping[str, Engine], query: str, selector: str = "", limit: int = 10, **options) -> DataFrame:
    """The best hits of the selected indexes by fused rank, with their own scores: each gives twice the limit."""
    names = [n for n in engines if _named(n, selector)]
    found = None
    for name in names:
        hits = engines[name].search(query, limit=2 * limit, **options).withColumn("index", F.lit(name))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError(f"no index matches {selector!r}")
    rank = F.row_number().over(Window.partitionBy("index").orderBy(F.desc("score"), "frag_id")) - 1
    return found.withColumn("fused", 1 / (search.RRF + rank)).orderBy(F.desc("fused"), "index", "frag_id").limit(limit).drop("fused")


def _named(name: str, selector: str) -> bool:
    """Whether a selector (all, a list with commas, ``prefix*``) names an index."""
    parts = [p.strip() for p in selector.split(",") if p.strip()]
    return selector.strip() in ("", "all") or any(name.startswith(p[:-1]) if p.endswith("*") else name == p for p in parts)
