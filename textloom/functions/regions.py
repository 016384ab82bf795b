"""Regions of pages: flattened trees, reading order, transcripts, quotes, and measures of a region's reading."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions import text as T

SAME_ROW = 0.02


def reading_order(boxes: list[tuple[float, float]]) -> list[int]:
    """Places of (x, y) in order of reading: rows from the top, within a row from the left.

    Two boxes are of one row if their tops differ by SAME_ROW at most: that is no
    order that a sort key could give, so the rule itself is what the sort asks.
    """

    def earlier(i: int, j: int) -> int:
        (ax, ay), (bx, by) = boxes[i], boxes[j]
        a, b = (ay, by) if abs(ay - by) > SAME_ROW else (ax, bx)
        return (a > b) - (a < b)

    return sorted(range(len(boxes)), key=cmp_to_key(earlier))


def ordered(regions: DataFrame) -> DataFrame:
    """Regions (page_id, region, parent, x, y) with ``place``: their place among their siblings."""
    import pandas as pd

    kind = regions.schema["page_id"].dataType.simpleString()
    listed = regions.groupBy("page_id", "parent").agg(F.sort_array(F.collect_list(F.struct("region", "x", "y"))).alias("r"))

    def run(batches):
        for batch in batches:
            rows = [(p, r[i]["region"], n) for p, r in zip(batch["page_id"], batch["r"]) for n, i in enumerate(reading_order([(q["x"], q["y"]) for q in r]))]
            yield pd.DataFrame(rows, columns=["page_id", "region", "place"])

    return listed.select("page_id", "r").mapInPandas(run, f"page_id {kind}, region string, place int")


def leaves(regions: DataFrame) -> DataFrame:
    """Regions that hold no other one."""
    return regions.join(regions.where("parent is not null").select("page_id", F.col("parent").alias("region")).distinct(), ["page_id", "region"], "left_anti")


def transcript(regions: DataFrame) -> DataFrame:
    """(page_id, text, spans): the texts of a page's regions (page_id, seq, region, text) in order, a blank line between, and where each is."""
    rows = regions.select("page_id", "seq", "region", T.stripped(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    order = Window.partitionBy("page_id").orderBy("seq")
    end = F.sum(F.length("t") + 2).over(order) - 2
    placed = rows.select("page_id", F.struct("seq", "region", "t", (end - F.length("t")).alias("from"), end.alias("to")).alias("x"))
    return placed.groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("page_id", F.array_join("x.t", "\n\n").alias("text"), F.transform("x", lambda r: F.struct(r["region"].alias("region"), r["from"].alias("from"), r["to"].alias("to"))).alias("spans"))


def quoted(regions: DataFrame, quote: str) -> DataFrame:
    """Regions whose folded text holds a folded quote, the deepest first; an empty quote is in none."""
    needle = "".join(c.lower() for c in quote if c.isalnum())
    folded = F.lower(F.regexp_replace("text", r"[^\p{L}\p{Nd}]", ""))
    return regions.where(folded.contains(needle) if needle else F.lit(False)).orderBy(F.desc("depth"), "region")


def grafted(regions: DataFrame, fresh: DataFrame) -> DataFrame:
    """A tree with the subtree of each root in ``fresh`` (page_id, root, region, parent, ...) replaced: paths are told by the region's name (``1.2.3``)."""
    roots = fresh.select("page_id", "root").distinct()
    met = regions.join(roots, "page_id", "left")
    below = F.coalesce((F.col("region") == F.col("root")) | F.col("region").startswith(F.concat("root", F.lit("."))), F.lit(False))
    hidden = met.where(below).select("page_id", "region").distinct()
    return regions.join(hidden, ["page_id", "region"], "left_anti").unionByName(fresh.select(regions.columns))


def normal_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.upper(T.flat(x))), lambda x: F.octet_length(x) > 3)


def repetition(text: Column) -> Column:
    """One less the share of lines that differ."""
    lines = normal_lines(text)
    return F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0)


def distinct_length(text: Column) -> Column:
    """Characters of all lines that differ."""
    return F.aggregate(F.array_distinct(normal_lines(text)), F.lit(0), lambda s, x: s + F.length(x))


WINDOW = 5


def _upper(text: str) -> str:
    """Upper case, one character for one."""
    return text.upper() if text.isascii() else "".join(u if len(u := c.upper()) == 1 else c for c in text)


@F.pandas_udf(DoubleType())
def _share(text: pd.Series, expected: pd.Series) -> pd.Series:
    def one(got: str | None, want: str | None) -> float:
        windows = lambda t: [t[i : i + WINDOW] for i in range(len(t) - WINDOW + 1)]
        wanted, there = windows(_upper(want or "")), set(windows(_upper(got or "")))
        return sum(w in there for w in wanted) / len(wanted) if wanted else 0.0

    return pd.Series([one(*x) for x in zip(text, expected)], dtype="float64")


def expected_share(text: Column, expected: Column) -> Column:
    """The share of the windows of WINDOW characters of an expected text that are in a text, case aside; each place counts, 0 without one."""
    return _share(text, expected)


def clears(before: Column, after: Column) -> Column:
    """Whether a new reading drops a flag that tells more than that the reader gave up."""
    return F.size(F.array_except(F.array_except(before, F.array(F.lit("exhausted"), F.lit("budget"))), after)) > 0
