"""Segments of pages put together to fragments, and fragments cut to a token budget, where they lie."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.segments import Budget, assembled, split_to_budget

SPANS = "array<struct<off:int,page:int>>"


def _spans(pairs) -> list[dict] | None:
    return [{"off": off, "page": page} for off, page in pairs] or None


def assemble(pages: DataFrame, least: int = 3000, most: int = 9000) -> DataFrame:
    """(path, page, ord, text, page_spans) from pages (path, page, segments, continues), in order of the page.

    A document is one row of its pages: what is open goes on from page to page.
    Null segments have no text.
    """
    docs = pages.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "segments", "continues"))).alias("pages"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, listed in zip(batch["path"], batch["pages"]):
                parts = [(p["page"], [s or "" for s in (p["segments"] if p["segments"] is not None else [])], bool(p["continues"])) for p in listed]
                rows += [(path, f["page"], f["ord"], f["text"], _spans(f["spans"])) for f in assembled(parts, least, most)]
            yield pd.DataFrame(rows, columns=["path", "page", "ord", "text", "page_spans"])

    return docs.mapInPandas(run, f"path string, page int, ord int, text string, page_spans {SPANS}")


def fitted(fragments: DataFrame, budget: Budget) -> DataFrame:
    """(path, page, ord, piece, start_off, end_off, text, page_spans): fragments cut to what an embedder takes; offsets and spans move along."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                spans = [(s["off"], s["page"]) for s in r["page_spans"]] if r["page_spans"] is not None else []
                placed = r["end_off"] > r["start_off"]
                for i, p in enumerate(split_to_budget(r["text"] or "", budget, spans, r["start_off"] if placed else None)):
                    rows.append((r["path"], r["page"], r["ord"], i, p.get("start_off", 0), p.get("end_off", 0), p["text"], _spans(p["spans"])))
            yield pd.DataFrame(rows, columns=["path", "page", "ord", "piece", "start_off", "end_off", "text", "page_spans"])

    columns = ["path", "page", "ord", "start_off", "end_off", "text", "page_spans"]
    return fragments.select(columns).mapInPandas(run, f"path string, page int, ord int, piece int, start_off int, end_off int, text string, page_spans {SPANS}")
