"""A corpus pipeline of five operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fresh_name, materialize, quoted, table
from textloom.llm.mixing import mixed_documents
from textloom.llm.near import near_duplicates
from textloom.llm.packing import pack_documents
from textloom.llm.rules import STATS, quality_rules
from textloom.llm.toxicity import fit, scan, score_column


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, written so that it stays the same (doc_id can be null or repeated), and its name."""
    key = fresh_name(docs.columns, "_textloom_row")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _kept(keyed: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``keyed`` whose key is in ``keys``, without it."""
    return keyed.join(keys.hint("merge"), key, "left_semi").drop(key)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.7; the model learns from all labelled rows of ``docs``.

    Null and empty texts have no passage and stay.  Rows without doc_id are judged and teach nothing.
    """
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table(spark, sf_dir, "labels"))
    rest = fresh_name(docs.columns, "_rest")
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")))
    scored = scan(docs.select("doc_id", "text", whole.alias(rest)) if len(docs.columns) > 2 else docs.select("doc_id", "text"), model, [rest] if len(docs.columns) > 2 else [], with_text=True)
    columns = [c if c in ("doc_id", "text") else F.col(rest)[c].alias(c) for c in docs.columns]
    return scored.where(score_column(model) < 0.7).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the learned decision list, each judged by its own text (null: no words, so it goes)."""
    whole = fresh_name([*docs.columns, *STATS], "_whole_row")
    rows = docs.select("doc_id", "text", F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(whole))
    judged, _ = quality_rules(rows, table(spark, sf_dir, "labels"), (whole,))
    return judged.where("kept").select(*(F.col(whole).getField(c).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (rows without doc_id come last), then hash of its text.

    Rows are compared by their texts alone, whatever their ids; rows without words are like nothing and stay.
    """
    keyed, key = _keyed(docs)
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), width=5)
    groups = found.select(F.col("doc_id").alias("row"), "component_id")
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"))
    order = F.struct(F.col("id").isNull(), "id", "print", "row")
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min_by("row", order).alias(key)).select(key)
    return _kept(keyed, first, key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; rows without words are never taken."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place; null and empty texts are one end id."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
