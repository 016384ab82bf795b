"""Mixing sources to target weights by pivotal dependent rounding, in SQL expressions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, fresh_name, materialize, quoted, scratch_path, split_table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
GROUP = 64  # rows that one fold pairs, on average
STRATUM = 3  # powers of two that the sizes of one stratum span
ALIKE = 1000  # rows that are alike and numbered by one task at a time
_TINY = 1e-12


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copy) of every row; ``copy`` numbers rows that are alike."""
    spread = split_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), docs.sparkSession.sparkContext.defaultParallelism)
    sized = spread.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("m"))
    few = alike.where(F.col("m") <= ALIKE).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), "m")).alias("copy"))
    # what is alike in great numbers is numbered in parts
    parts = alike.where(F.col("m") > ALIKE).select("doc_id", "source", "size", "m", F.explode(F.expr(f"sequence(0, cast((m - 1) div {ALIKE} as int))")).alias("part"))
    parts = parts.repartition("doc_id", "source", "size", "part")
    many = parts.select("doc_id", "source", "size", F.explode(F.expr(f"sequence(part * {ALIKE} + 1, least(m, (part + 1) * {ALIKE}))")).alias("copy"))
    return few.unionByName(many)


def targets(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target): shares of the total by weight, capped, the excess reshared until none is above."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    now = materialize(found.withColumn("w", weight).withColumn("capped", F.lit(False)), "sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        spent = now.agg(F.sum(F.when(F.col("capped"), cap * F.col("source_size"))), F.sum(F.when(~F.col("capped"), F.col("w")))).first()
        rest, open_weight = total - (spent[0] or 0), spent[1] or 0.0
        if not open_weight:
            break
        share = F.lit(float(rest)) * F.col("w") / F.lit(float(open_weight))
        now = now.withColumn("target", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share))
        over = ~F.col("capped") & (F.col("target") > cap * F.col("source_size"))
        if now.where(over).isEmpty():
            break
        now = materialize(now.withColumn("capped", F.col("capped") | over).drop("target"), "sources")
    if "target" not in now.columns:
        now = now.withColumn("target", (cap * F.col("source_size")).cast("double"))
    return now.select("source", "source_size", "n", "target")


def _uniform(*columns: str) -> str:
    """A number in (0, 1) from a hash of the columns: the same in every run."""
    return f"((xxhash64({', '.join(columns)}) & 4503599627370495L) + 0.5D) / 4503599627370496D"


def _fold(seed: int, level: int) -> str:
    """SQL that folds ``items`` (size, ord, doc_id, copy, part), largest first: the pivot meets one item after the other.

    Of the pair (a, b), mass moves so that ``size * part`` keeps its sum: either a
    rises and b falls or the reverse, until one of them is 0 or 1; the two moves have
    the odds that keep both expectations.  What became integral joins ``done``.  As
    small items come last, what is left fractional in the end is mostly small.
    """
    item = "struct(b.size, b.ord, b.doc_id, b.copy, {part} as part)"
    pivot = "struct(s.a.size, s.a.ord, s.a.doc_id, s.a.copy, {part} as part)"
    up, down = "least((1D - s.a.part) * s.a.size, b.part * b.size)", "least(s.a.part * s.a.size, (1D - b.part) * b.size)"
    raise_a = f"{_uniform('s.a.doc_id', 's.a.copy', 's.a.size', 'b.doc_id', 'b.copy', 'b.size', str(seed), str(level))} * ({up} + {down}) < {down}"
    clean = lambda x: f"if({x} < {_TINY}D, 0D, if({x} > 1D - {_TINY}D, 1D, {x}))"
    moved = f"if({raise_a}, {up}, -{down})"
    a, b = pivot.format(part=clean(f"(s.a.part + s.move / s.a.size)")), item.format(part=clean("(b.part - s.move / b.size)"))
    step = f"""
      if(s.a is null, struct(b as a, s.done as done),
        aggregate(array(struct(s.a as a, s.done as done, {moved} as move)), s, (ignored, s) ->
          aggregate(array(struct({a} as x, {b} as y)), struct(s.a as a, s.done as done), (t, p) ->
            struct(
              if(p.x.part > 0D and p.x.part < 1D, p.x, if(p.y.part > 0D and p.y.part < 1D, p.y, null)) as a,
              concat(t.done, filter(array(p.x, p.y), z -> z.part = 0D or z.part = 1D)) as done))))
    """
    kind = "struct<size:bigint,ord:bigint,doc_id:bigint,copy:int,part:double>"
    return f"aggregate(items, struct(cast(null as {kind}) as a, cast(array() as array<{kind}>) as done), (s, b) -> {step})"


def _folded(rows: DataFrame, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """(bits of all rows but one a source, that one with its fraction) for rows with ``part`` strictly between 0 and 1.

    A tree of folds: rows meet in groups of about GROUP within their source, each group
    leaves one fractional row at most, and these meet on the next level.  Groups are
    made by hash: a source of any size is many groups.
    """
    counts = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    groups = F.ceil(F.col("n") / F.lit(GROUP)).cast("long")
    now = rows.join(counts, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "size", "copy", "part", F.xxhash64("doc_id", "size", "copy", F.lit(seed)).alias("ord"), groups.alias("groups"))
    now = now.withColumn("g", F.pmod("ord", "groups"))
    done, level, open_groups = [], 0, math.ceil(most / GROUP)
    while most:
        items = now.groupBy("source", "g").agg(F.sort_array(F.collect_list(F.struct("size", "ord", "doc_id", "copy", "part")), asc=False).alias("items"))
        folded = materialize(items.select("source", "g", F.expr(_fold(seed, level)).alias("r")).select("source", "g", "r.a", "r.done"), "fold")
        done.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.copy", F.col("d.part").cast("int").alias("bit")))
        now = folded.where("a is not null").select("source", "a.doc_id", "a.size", "a.copy", "a.part", "a.ord", F.floor(F.col("g") / F.lit(GROUP)).cast("long").alias("g"))
        if open_groups <= 1:
            break
        level, open_groups = level + 1, math.ceil(open_groups / GROUP)
    return done, now.select("source", "doc_id", "size", "copy", "part")


def rounded(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(source, doc_id, size, copy, bit) for rows whose ``part`` is between 0 and 1, the same for all of a source.

    Sources are rounded by strata of size, the largest documents first.  A pivot that
    survives a fold is about the largest of its stratum; it is rounded alone, by its
    fraction, and what that missed is taken up by the fractions of the source's smaller
    documents, all by the same amount.  As such a miss is zero in expectation, every
    fraction stays the chance of its document.  Only a last pivot whose miss the smaller
    ones could not take up, if there are any, goes to the nearer side instead.  What a
    source misses in the end is about half of one of its smallest documents; one of few
    documents can miss half of its largest.
    """
    rows, path = rows.withColumn("stratum", F.floor(F.log2("size") / STRATUM).cast("int")), scratch_path(rows.sparkSession, "strata")
    rows.write.partitionBy("stratum").parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    mass = _small(rows.groupBy("source", "stratum").agg(F.sum("size").alias("mass"), F.first("part").alias("part")), "masses")  # a row a source and power of two
    strata = sorted((r[0] for r in mass.select("stratum").distinct().collect()), reverse=True)
    parts = mass.groupBy("source").agg(F.first("part").alias("part"))
    out = rows.where("false").select("source", "doc_id", "size", "copy", F.lit(0).alias("bit"))
    for stratum in strata:
        now = parts.select(F.col("source").alias("p"), "part")
        here = rows.where(F.col("stratum") == stratum).drop("part", "stratum").join(now, F.col("source").eqNullSafe(F.col("p"))).drop("p")
        whole = here.where("part <= 0 or part >= 1")
        done, last = _folded(here.where("part > 0 and part < 1"), seed + stratum)
        # what a source's smaller documents weigh, whether it has some of this stratum or not, and their fraction so far
        below = mass.where(F.col("stratum") < stratum).groupBy(F.col("source").alias("b")).agg(F.sum("mass").alias("below"))
        rest = parts.join(below, F.col("source").eqNullSafe(F.col("b"))).select("b", "below", F.col("part").alias("common"))
        last = last.join(rest, F.col("source").eqNullSafe(F.col("b")), "left").drop("b")
        # a chance is taken where smaller documents have room for either miss; else the nearer side, as they allow
        taken_fits, left_fits = F.expr("size * (1 - part) <= below * common"), F.expr("size * part <= below * (1 - common)")
        drawn = F.expr(f"{_uniform('doc_id', 'copy', 'size', str(seed), '-1')} < part")
        bit = F.when(taken_fits & left_fits, drawn).when(taken_fits != left_fits, taken_fits).otherwise(F.col("part") >= 0.5)
        last = materialize(last.withColumn("bit", bit.cast("int")), "last")
        for part in (whole.withColumn("bit", F.col("part").cast("int")), last, *done):
            out = out.unionByName(part.select("source", "doc_id", "size", "copy", "bit"))
        if stratum == strata[-1]:
            break
        missed = last.select(F.col("source").alias("l"), (F.col("size") * (F.col("part") - F.col("bit"))).alias("miss"))
        met = rest.join(missed, F.col("b").eqNullSafe(F.col("l")), "left")
        moved = F.col("common") + F.coalesce("miss", F.lit(0.0)) / F.col("below")
        clean = F.when(moved < _TINY, F.lit(0.0)).when(moved > 1 - _TINY, F.lit(1.0)).otherwise(moved)
        parts = materialize(met.select(F.col("b").alias("source"), clean.alias("part")), "parts")
    return out


def _small(rows: DataFrame, label: str) -> DataFrame:
    """A written table of a row or a few for each source, in as few files as its size asks for: Spark broadcasts it where that is small."""
    rows = materialize(rows, label)
    return materialize(rows.repartition(1 + rows.count() // 100_000), label)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """doc_id, source, size, copy, source_size, target and copies for every row of ``docs`` (doc_id, source, text).

    A row is copied target / source_size times in expectation, at most ``cap`` times:
    the whole part for sure, the fraction by pivotal rounding weighted by size
    (``rounded``).  Each source's taken words miss its target by about one of its
    smallest documents.  The random numbers are hashes of the rows, so reruns agree.  Null texts have size 0 and are
    not copied; null sources are one source, the last; rows that are alike (doc_id,
    source, size) are rounded each on its own.  An empty table gives an empty result.
    """
    rows = materialize(sizes(docs), "sizes")
    goal = targets(rows, weights, cap)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = _small(goal.withColumn("whole", F.floor(times + _TINY).cast("int")).withColumn("part", F.when(times - F.col("whole") > _TINY, times - F.col("whole")).otherwise(F.lit(0.0))), "targets")
    open_rows = rows.where("size > 0").join(goal.where("part > 0").select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sure = rows.join(goal.where("part > 0").select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_anti").unionByName(rows.where("size = 0").join(goal.where("part > 0").select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_semi"))
    bits = rounded(open_rows, seed).unionByName(sure.select("source", "doc_id", "size", "copy", F.lit(0).alias("bit")))
    facts = goal.select(F.col("source").alias("s"), "source_size", "target", "whole")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("bit")).otherwise(F.lit(0)).cast("int")
    return bits.join(facts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "copy", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all their columns, under any names), each as many times as the mix takes it."""
    names = docs.columns
    at, n, copies, again = (fresh_name(names, x) for x in ("_place", "_words", "_copies", "_again"))
    keys = [fresh_name([*names, at, n, copies, again], x) for x in ("_key_id", "_key_source", "_key_size", "_key_copy")]
    chosen = mix(docs, **options).where("copies > 0").select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "size", "copy"), keys)), F.col("copies").alias(copies))
    chosen = materialize(chosen, "taken")
    sized = docs.withColumn(n, F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn(at, F.row_number().over(Window.partitionBy("doc_id", "source", n).orderBy(F.xxhash64("text"))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(keys[0])) & F.col("source").eqNullSafe(F.col(keys[1])) & (F.col(n) == F.col(keys[2])) & (F.col(at) == F.col(keys[3]))
    met = sized.join(chosen.hint("merge"), same)
    return met.select(*(F.col(quoted(c)) for c in names), F.explode(F.sequence(F.lit(1), F.col(copies))).alias(again)).drop(again)
