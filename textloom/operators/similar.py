"""Similar documents end to end: sketches, candidates, masks, and the exact comparison of each pair."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.functions import text as T
from textloom.operators.overlap import GENERIC, candidates, generic, merged, taken
from textloom.plans.tasks import spread

GAP = "struct<a_page:int,b_page:int,a_text:string,b_text:string>"
BLOCK = f"struct<a_from:int,a_to:int,b_from:int,b_to:int,runs:int,matched_chars:int,span_chars:int,a_from_page:int,a_to_page:int,b_from_page:int,b_to_page:int,gaps:array<{GAP}>>"
MATCH = f"relation string, jaccard double, a_in_b double, b_in_a double, a_cover double, b_cover double, shared int, a_shingles int, b_shingles int, generic_chars int, matched_chars int, blocks array<{BLOCK}>, only_in_a array<string>, only_in_b array<string>"
MASK = "array<struct<lo:int,hi:int>>"


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def sketches(docs: DataFrame, key: str, text: str, width: int = folding.WIDTH, modulus: int = folding.MODULUS) -> DataFrame:
    """(key, chars, total, at, hash): folded length and distinct shingles of each text, with its sampled shingles and their places.

    A text without sampled shingle has one row with null ``at``; null texts are empty.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in taken(batch.num_rows, lambda i, batch=batch: sketched(batch.column(1)[i].as_py() or "")):
                sizes = [len(x[0]) for _, x in group]
                keys, chars, total = (np.repeat(c, sizes) for c in ([i for i, _ in group], [x[2] for _, x in group], [x[3] for _, x in group]))
                at, value = (np.concatenate([x[k] for _, x in group]) for k in (0, 1))
                none = at < 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(chars, pa.int32()), pa.array(total, pa.int32()), pa.array(at, pa.int32(), mask=none), pa.array(value, mask=none)], names=[key, "chars", "total", "at", "hash"])

    def sketched(t):
        """Places (one of -1 if there is none), hashes, length and number of distinct shingles of one text."""
        body = folding.fold(t).body
        hashes = folding.shingles(body, width)
        place = np.flatnonzero(hashes % np.uint64(modulus) == 0) if modulus > 1 else np.arange(len(hashes))
        value = hashes[place].view(np.int64)
        return (place, value, len(body), folding.kinds(hashes)) if len(place) else (np.array([-1]), np.zeros(1, np.int64), len(body), folding.kinds(hashes))

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, chars int, total int, at int, hash long")


MOST_CHARS = 1 << 18  # folded characters that are hashed together


def sampled(docs: DataFrame, key: str, text: str, width: int = folding.WIDTH, modulus: int = folding.MODULUS) -> DataFrame:
    """(key, h, chars, at, hash), a row a text: its print as in ``prints``, in bytes, its folded length, and places and hashes of its sampled shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in taken(batch.num_rows, lambda i, batch=batch: folded(batch.column(1)[i].as_py() or ""), MOST_CHARS):
                bodies = [x[0] for _, x in group]
                at, value, bounds = folding.sampled(bodies, width, modulus)
                lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, t)) for v, t in ((at, pa.int32()), (value, pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in group])), pa.array([x[1] for _, x in group], pa.binary()), pa.array([len(b) for b in bodies], pa.int32()), *lists], names=[key, "h", "chars", "at", "hash"])

    def folded(t):
        whole = folding.lowered(t)
        return folding.body(t), hashlib.sha256(whole).digest() if whole else None

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, h binary, chars int, at array<int>, hash array<long>")


def prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): a hash of each folded text, null without letters and digits."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = (folding.lowered(t.as_py() or "") for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(x).hexdigest() if x else None for x in found], pa.string())], names=[key, "h"])

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, h string")


def classes(docs: DataFrame, key: str, text: str, write=None) -> DataFrame:
    """(key, first, members): documents with equal folded texts, under the smallest key; texts without letters and digits are alone."""
    write = write or (lambda df: df)
    return classed(write(prints(docs, key, text)), key, write)


def classed(hashed: DataFrame, key: str, write=None) -> DataFrame:
    """The classes of texts by their prints (key, h): those of one member, most of them, are told without a group."""
    groups = hashed.where("h is not null").groupBy("h").agg(F.min(key).alias("first"), F.count("*").alias("members")).where("members > 1")
    return hashed.join((write or (lambda df: df))(groups), "h", "left").select(key, F.coalesce("first", key).alias("first"), F.coalesce("members", F.lit(1)).alias("members"))


def firsts(docs: DataFrame, key: str, text: str, write) -> DataFrame:
    """(key, chars, at, hash) of ``sampled``, of the texts that stand first in their class: the keys of the others, which are few, are told and left out."""
    rows = write(sampled(docs.where(F.col(key).isNotNull()), key, text))
    own = classed(rows.select(key, "h"), key, write).groupBy(key).agg(F.max(F.col("first") == F.col(key)).alias("own"))
    others = write(own.where("not own").select(key))
    return rows.where(F.size("at") > 0).select(key, "chars", "at", "hash").join(others, key, "left_anti")


def generic_masks(sketched: DataFrame, key: str, hashes: DataFrame, width: int = folding.WIDTH, slack: int = folding.MODULUS) -> DataFrame:
    """(key, mask): what lies under generic shingles, each widened by ``slack`` inside the text, as merged intervals."""
    hits = sketched.join(hashes.select("hash"), "hash", "left_semi")
    hits = hits.select(key, F.greatest(F.col("at") - slack, F.lit(0)).alias("lo"), F.least(F.col("at") + width + slack, F.col("chars")).alias("hi"))
    return merged(hits, key, "lo", "hi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("mask"))


def anchors(rows: DataFrame, key: str, text: str, width: int = folding.WIDTH, least: int = folding.LEAST_RUN) -> DataFrame:
    """(key, free, anchors) of ``rows`` (key, text, mask): characters in stretches of ``least`` beside the mask, and the least hash of each such stretch.

    Texts with an equal passage of ``least`` characters beside both masks have one of these hashes in common.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in taken(batch.num_rows, lambda i, batch=batch: found(batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or [])):
                kept, sizes = [x[0] for _, x in group], [len(x[0]) for _, x in group]
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(kept), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in group])), pa.array([x[1] for _, x in group], pa.int32()), listed], names=[key, "free", "anchors"])

    def found(t, mask):
        body = folding.body(t)
        if len(body) < least:
            return np.zeros(0, np.int64), 0
        under = np.zeros(len(body) + 1, np.int64)
        for m in mask:
            under[m["lo"] : m["hi"]] = 1
        before = np.append(0, np.cumsum(under[:-1]))
        bare = np.flatnonzero(before[least:] == before[: len(body) - least + 1])
        lowest = np.lib.stride_tricks.sliding_window_view(folding.shingles(body, width), least - width + 1).min(axis=1)
        return np.unique(lowest[bare]).view(np.int64), int(np.minimum(np.diff(bare), least).sum()) + least if len(bare) else 0

    return spread(rows.select(key, text, "mask")).mapInArrow(run, f"{key} {kind}, free int, anchors array<long>")


def crowded(docs: DataFrame, key: str, text: str, index: DataFrame, listed: DataFrame, common: DataFrame, pairs: DataFrame, least_chars: int, write, shared: int = 3) -> DataFrame:
    """(a, b) with a < b, beside ``pairs``: texts that share sampled shingles only if generic ones count, and have something to measure beside their masks.

    What is measured lies in passages beside both masks, so texts without such a
    passage in common, nearly all that share generic shingles, need not meet.  The
    texts of a passage that many have are dealt to parts.
    """
    met = write(listed.join(common, "hash", "left_semi").select(key).distinct())
    own = write(index.join(met, key, "left_semi"))
    spots = own.select(key, "chars", F.explode(F.arrays_zip("at", "hash")).alias("s")).select(key, "chars", "s.at", "s.hash")
    free = write(anchors(docs.select(key, text).join(generic_masks(spots, key, common), key), key, text))
    flat = free.select(key, "free", F.explode("anchors").alias("h"))
    several = flat.groupBy("h").agg(F.count("*").alias("n"), F.max("free").alias("most")).where((F.col("n") > 1) & (F.col("most") >= least_chars))
    dealt = write(flat.join(several.select("h", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")), "h"))
    left = dealt.select("h", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).alias("a"), F.col("free").alias("free_a"))
    right = dealt.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias("b"), F.col("free").alias("free_b"))
    found = left.join(right, ["h", "part"]).where((F.col("a") < F.col("b")) & (F.greatest("free_a", "free_b") >= least_chars)).select("a", "b").distinct()
    side = lambda c: own.select(F.col(key).alias(c), F.col("hash").alias(f"of_{c}"))
    sharing = found.join(pairs, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    return sharing.where(F.size(F.array_intersect("of_a", "of_b")) >= shared).select("a", "b")


MEMBERS = 256  # texts that pass by one copy of their leader's


def led(pairs: DataFrame, mutual: bool) -> DataFrame:
    """(leader, member, part): pairs (a, b) under a leader, whose members are dealt to parts of about MEMBERS.

    The leader is ``a``, or, where pairs have no sides, the one that is in more of them:
    its text is sent once for each of its parts, the members' once for each pair.
    """
    if mutual:
        degree = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))
        side = lambda c: degree.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"))
        met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        first = F.col("n_a") >= F.col("n_b")
        rows = met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"))
    else:
        rows = pairs.select(F.col("a").alias("leader"), F.col("b").alias("member"))
    parts = rows.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    return rows.join(parts, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"))


def compared(pairs: DataFrame, probes: DataFrame, docs: DataFrame, mutual: bool = False, width: int = folding.WIDTH) -> DataFrame:
    """All measures (a, b, MATCH) of ``pairs`` (a, b) of texts: ``probes`` and ``docs`` have key, text, mask, and spans if pages are known.

    Each pair is compared once.  With ``mutual``, where both sides are of ``docs`` and a
    pair is listed once, its measures are told from either side: two rows.  A leader's
    text comes first, is folded and hashed once, and its members' pass by.
    """
    spanned = "spans" in docs.columns and "spans" in probes.columns
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, {MATCH}"
    arrow = _arrow(pairs.sparkSession, schema)
    columns = ["text", "mask", *(["spans"] if spanned else [])]

    def prepared(r):
        spans = [(s["off"], s["page"]) for s in r["spans"] or []] or None if spanned else None
        return folding.Prepared(folding.fold(r["text"] or "", spans), [(m["lo"], m["hi"]) for m in r["mask"] or []], width)

    def run(batches):
        key, leader = None, None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["turn"] == 0:
                    key, leader = r["leader"], prepared(r)
                    continue
                found = folding.compared(leader, prepared(r), mutual)
                rows += [{"a": a, "b": b, **f} for (a, b), f in zip(((key, r["member"]), (r["member"], key)), found)]
                if len(rows) >= MEMBERS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    listed = led(pairs, mutual)
    leaders = listed.select("leader", "part").distinct().join(probes.select(F.col("key").alias("leader"), *columns), "leader").select("leader", "part", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("member"), *columns)
    members = listed.join(docs.select(F.col("key").alias("member"), *columns), "member").select("leader", "part", F.lit(1).alias("turn"), "member", *columns)
    rows = leaders.unionByName(members).repartition("leader", "part").sortWithinPartitions("leader", "part", "turn", "member")
    return rows.mapInArrow(run, schema)


def similar_pairs(probes: DataFrame, docs: DataFrame, key: str, text: str, cutoff: int = GENERIC, least_chars: int = 250, least_cover: float = 0.0, write=None, crowds: bool = False) -> DataFrame:
    """(a, b, MATCH): every text of ``probes`` against those of ``docs`` that share three usual sampled shingles with it.

    A pair is kept from ``least_chars`` matched characters on, and from
    ``least_cover`` of one side.  Where probes are the documents themselves, a pair is
    compared once and told from both sides.  Texts that are equal when folded are compared
    once, under their first key: see ``classes`` for the members.  Shingles of
    ``cutoff`` documents or more are generic: they make no candidates, and what lies
    under them is masked.  With ``crowds``, where probes are the documents, they make
    candidates as any others do; what is masked stays so.  ``write`` cuts the lineage
    of a table that is used twice.
    """
    write = write or (lambda df: df)
    mutual = probes is docs
    if crowds and not mutual:
        raise ValueError("crowds are told where probes are the documents")
    among = lambda rows, few, name: rows.join(few, name, "left_semi")
    hashes = lambda rows: rows.select(key, F.explode("hash").alias("hash"))
    index = firsts(docs, key, text, write)
    probe = index if mutual else firsts(probes, key, text, write)
    # most shingles are in one text alone: they make no candidates and are not generic
    again = hashes(index).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min(2, cutoff)).select("hash") if mutual else write(hashes(probe).select("hash").distinct())
    listed = write(among(hashes(index), again, "hash").distinct())
    own = listed if mutual else hashes(probe).distinct()
    pairs = candidates(own.withColumnRenamed(key, "a"), listed.withColumnRenamed(key, "b"), cutoff)
    pairs = write((pairs.where("a < b") if mutual else pairs).select("a", "b"))
    common = write(generic(listed, key, cutoff).select("hash")) if mutual else None
    if crowds:
        pairs = write(pairs.unionByName(crowded(docs, key, text, index, listed, common, pairs, least_chars, write)))
    # masks and texts of what is in a pair only
    left, right = (pairs.select(F.col(c).alias(key)) for c in ("a", "b"))
    index_met = write((left.unionByName(right) if mutual else right).distinct())
    probe_met = index_met if mutual else write(left.distinct())
    index_own = write(among(index, index_met, key))
    probe_own = index_own if mutual else write(among(probe, probe_met, key))
    if not mutual:
        asked = write(hashes(index_own).unionByName(hashes(probe_own)).select("hash").distinct())
        listed = among(hashes(index), asked, "hash").distinct()
        common = write(generic(listed, key, cutoff).select("hash"))

    def side(rows, met, sketch):
        spots = sketch.select(key, "chars", F.explode(F.arrays_zip("at", "hash")).alias("s")).select(key, "chars", "s.at", "s.hash")
        return write(among(rows.select(key, text), met, key).join(generic_masks(spots, key, common), key, "left").select(F.col(key).alias("key"), F.col(text).alias("text"), "mask"))

    index_side = side(docs, index_met, index_own)
    found = compared(pairs, index_side if mutual else side(probes, probe_met, probe_own), index_side, mutual)
    return found.where((F.col("matched_chars") >= least_chars) & ((F.col("a_cover") >= least_cover) | (F.col("b_cover") >= least_cover)))


def proposal(relation: Column, only_a: Column, only_b: Column, a_cover: Column, b_cover: Column, jaccard: Column, matched: Column) -> Column:
    """(kind, why, confident): what a person could rule about a pair: copy, version, or nothing."""
    dated = (F.size(T.dates(only_a)) > 0) & (F.size(T.dates(only_b)) > 0)
    both = (F.size(only_a) > 0) & (F.size(only_b) > 0)
    one = (F.size(only_a) > 0) | (F.size(only_b) > 0)
    where = F.when(relation == "contained", F.concat(F.lit("the whole probe is in the match: "), T.percent(b_cover), F.lit(" of it"))).when(relation == "contains", F.concat(F.lit("the whole match is in the probe: "), T.percent(a_cover), F.lit(" of it"))).otherwise("each is most of the other")
    versus = lambda x, y: F.concat(F.lit(": "), T.few(x), F.lit(" against "), T.few(y))
    ruling = lambda kind, why, sure=F.lit(False): F.struct(F.lit(kind).alias("kind"), why.alias("why"), sure.alias("confident"))
    close = relation.isin("duplicate", "contained", "contains")
    return (
        F.when(relation == "identical", ruling("copy", F.lit("equal texts"), F.lit(True)))
        .when(close & dated, ruling("version", F.concat(where, F.lit("; a date differs"), versus(T.dates(only_a), T.dates(only_b)))))
        .when(close & both, ruling("version", F.concat(where, F.lit("; numbers differ on both sides"), versus(only_a, only_b))))
        .when(close & one, ruling("copy", F.concat(where, F.lit("; one side lacks numbers: "), T.few(F.concat(only_a, only_b)))))
        .when(close, ruling("copy", F.concat(where, F.lit("; no number differs")), (relation == "duplicate") & (jaccard > 0.9)))
        .otherwise(ruling("", F.concat(F.lit("shared passages of "), matched.cast("string"), F.lit(" characters"))))
    )


def page_matches(a_pages: DataFrame, b_pages: DataFrame, width: int = folding.WIDTH) -> DataFrame:
    """(pair, a_page, b_page, rate, a_chars, b_chars, identical): each page of side a with its best page of side b.

    Both tables have pair, page and text.  ``rate`` is the share of the page's
    distinct shingles that the other has; of equal rates the first page wins; a page
    without any match has page 0 and rate 0.
    """
    from textloom.operators.overlap import shingles

    def side(rows, name):
        keyed = rows.select(F.struct("pair", "page").alias("k"), "text")
        hashed = shingles(keyed, "k", "text", width).select("k.pair", F.col("k.page").alias(f"{name}_page"), "hash").distinct()
        facts = rows.select("pair", F.col("page").alias(f"{name}_page"), F.length(T.fold(F.col("text"))).alias(f"{name}_chars"), F.sha2(T.fold(F.col("text")), 256).alias(f"{name}_print"))
        return hashed, facts

    (a, a_facts), (b, b_facts) = side(a_pages, "a"), side(b_pages, "b")
    sizes = a.groupBy("pair", "a_page").agg(F.count("*").alias("n"))
    hits = a.join(b, ["pair", "hash"]).groupBy("pair", "a_page", "b_page").agg(F.count("*").alias("hit"))
    best = hits.groupBy("pair", "a_page").agg(F.max(F.struct("hit", (-F.col("b_page")).alias("m"))).alias("x")).select("pair", "a_page", (-F.col("x.m")).alias("b_page"), "x.hit")
    met = a_facts.join(sizes, ["pair", "a_page"], "left").join(best, ["pair", "a_page"], "left").join(b_facts, ["pair", "b_page"], "left")
    return met.select("pair", "a_page", F.coalesce("b_page", F.lit(0)).alias("b_page"), F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)).alias("rate"), "a_chars", F.coalesce("b_chars", F.lit(0)).alias("b_chars"), F.coalesce(F.col("a_print") == F.col("b_print"), F.lit(False)).alias("identical"))


def diff_shape(matches: DataFrame) -> DataFrame:
    """(pair, pages, clean, noisy, divergent, missing) of page matches."""
    none = (F.col("b_page") == 0) | (F.col("rate") == 0)
    kind = F.when(none, "missing").when(F.col("rate") >= 0.999, "clean").when(F.col("rate") >= 0.6, "noisy").otherwise("divergent")
    return matches.withColumn("kind", kind).groupBy("pair").agg(F.count("*").alias("pages"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("clean", "noisy", "divergent", "missing")))


def sketch_status(docs: DataFrame, sketched: DataFrame, recipe: str) -> DataFrame:
    """(sketched, stale, unsketched, rows): documents (path) by their sketch rows (path, recipe): of this recipe, of others only, of none."""
    per = sketched.groupBy("path").agg(F.count_if(F.col("recipe") == recipe).alias("now"), F.count("*").alias("rows"))
    met = docs.select("path").join(per, "path", "left")
    return met.agg(F.count_if(F.col("now") > 0).alias("sketched"), F.count_if(F.col("now") == 0).alias("stale"), F.count_if(F.col("now").isNull()).alias("unsketched"), F.coalesce(F.sum("now"), F.lit(0)).alias("rows"))


def unsketched(docs: DataFrame, sketched: DataFrame, recipe: str) -> DataFrame:
    """Documents without sketch rows of this recipe."""
    return docs.join(sketched.where(F.col("recipe") == recipe), "path", "left_anti")
