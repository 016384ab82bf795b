"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks, giving_back, materialize, mix64, reduce_by_text, shingle_hashes, split_table, unique_by_text, word_hashes
from textloom.llm.graph import components

BANDS, ROWS = 24, 4
STAR = 256  # members that one copy of a leader's set is compared with
BLOCK = 512  # members of a crowd that are compared with as many others in one step
EXPANDED = 1 << 20  # meetings of two members in a shingle that are counted at a time
_CROWDED = "strays * members > 100"


def _second_permutation(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    np.right_shift(x, 16, out=spare)
    x ^= spare
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, 15, out=spare)
    x ^= spare
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, 16, out=spare)
    x ^= spare
    return x


def circulant_signature(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima per text from two permutations of the 32-bit integers.

    The first permutation (the upper half of ``mix64``) scatters the shingles; the
    second is applied after a circular shift by k, and gives coordinate k.
    """
    first = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, size), np.uint32)
    work, spare = np.empty_like(first), np.empty_like(first)
    stride = 0x9E3779B1  # shifts k * stride modulo 2**32 keep neighbours apart
    with np.errstate(over="ignore"):
        for k in range(size):
            np.add(first, np.uint32(k * stride & 0xFFFFFFFF), out=work)
            out[:, k] = reduce_by_text(np.minimum, _second_permutation(work, spare), bounds, np.uint32(0xFFFFFFFF))
    return out


def _shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = word_hashes(texts)
    return unique_by_text(*shingle_hashes(hashes, at, width))


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two digest halves of the shingle set, and its band hashes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, bounds = _shingle_sets(part.column("text"), width)
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    halves = [reduce_by_text(np.add, mix64(sets ^ np.uint64(salt)), bounds, np.uint64(0)) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                    signature = circulant_signature(sets, bounds, bands * rows).astype(np.uint64)
                    keys = np.empty((len(n), bands), np.uint64)
                    for j in range(bands):
                        key = np.full(len(n), np.uint64(j + 1))
                        for k in range(rows):
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, j * rows + k])
                        keys[:, j] = key
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array(h.view(np.int64)) for h in halves), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(giving_back(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, bounds = _shingle_sets(part.column("text"), width)
                blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], names=["node", "grams"])

    return docs.mapInArrow(giving_back(run), "node long, grams binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets (node, grams) have 100 * intersection >= percent * union.

    Pairs share leaders (a), so one copy of a leader's set travels for every STAR
    members.  Rows arrive sorted, leader first, and are compared as a stream: a
    task holds one leader and one member at a time.
    """
    members = pairs.groupBy("a").agg(F.count("*").alias("c"))
    pairs = pairs.join(members, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / STAR)).cast("int").alias("salt"))
    pairs = materialize(pairs, "pairs")
    heads = pairs.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "grams")
    members = pairs.join(sets, F.col("b") == F.col("node")).select("a", "salt", "b", "grams")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        at, leaders = None, []
        for batch in batches:
            left, right = [], []
            for a, salt, b, grams in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if (a, salt) != at:
                    at, leaders = (a, salt), []
                if b is None:
                    leaders.append(own.copy())
                    continue
                for leader in leaders:
                    small, large = (leader, own) if len(leader) < len(own) else (own, leader)
                    place = np.searchsorted(large, small)
                    place[place == len(large)] = 0
                    common = int(np.count_nonzero(large[place] == small)) if len(large) else 0
                    if common and 100 * common >= percent * (len(own) + len(leader) - common):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(giving_back(run), "a long, b long").distinct()


def _close(percent: int, a: str = "n_a", b: str = "n_b"):
    """Sets whose sizes differ too much cannot reach the similarity."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    A document is the set of its ``width``-word shingles (A-Z lower-cased; a
    shorter text is one shingle).  Texts with equal sets collapse to the smallest
    doc_id first.  Every band bucket then compares its members with its smallest
    member; what verification links is one component and is not compared again.
    In buckets that still hold several components, the members outside the largest
    one are compared with those of all others: pair by pair where they are few, else
    in blocks of all documents that such buckets join.
    So no group of copies is expanded into its pairs and no bucket is dropped.  A pair at exactly 0.8 misses all 24 bands of 4 with
    probability 3e-6.

    Null or empty texts have no shingles and link with nothing.  Rows with equal
    doc_id are one node, and each row is returned.  A row without doc_id is
    returned unlinked, with null component_id, and kept.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = split_table(docs, docs.sparkSession.sparkContext.defaultParallelism)
    signed = materialize(signatures(source, width), "signatures")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    distinct = live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min("bands").alias("bands"))
    distinct = materialize(distinct, "distinct")
    entries = distinct.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    bucket = materialize(entries.join(shared, "key"), "buckets")
    members = bucket.select(F.col("rep").alias("doc_id")).distinct()
    state = _Links(materialize(_set_rows(docs.join(members.hint("merge"), "doc_id", "left_semi"), width), "sets"), percent)
    # every bucket's members against its smallest member
    lead = bucket.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.max("c").alias("c"))
    state.test(_pairs(_by_key(bucket, lead).select(F.col("lead.rep").alias("a"), F.col("lead.n").alias("n_a"), F.col("rep").alias("b"), F.col("n").alias("n_b")), percent))
    # what is left: members outside the largest component against the members of all others
    mixed = state.mixed(bucket)
    rest = mixed.where(f"not ({_CROWDED})")
    one = rest.where(F.col("component") != F.col("largest")).select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("own"))
    other = rest.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), "component")
    state.test(_pairs(one.join(other, "key").where("own <> component"), percent), more=state.crowd_links(mixed.where(_CROWDED)))
    linked = state.linked
    named = signed.join(distinct.select("d1", "d2", "rep"), ["d1", "d2"], "left").join(linked, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


AT_ONCE = 512  # members of a bucket that one task joins


def _by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (key, rep, c and others) joined to ``facts``, a row a key, with its c: how many rows the key has.

    A key of many rows is met in parts of about AT_ONCE, each with a copy of its facts.
    """
    parts = F.ceil(F.col("c") / AT_ONCE)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(5)), parts))
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("c")
    return dealt.join(copies, ["key", "salt"]).drop("salt")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) whose set sizes allow the similarity; the smaller id leads."""
    close = rows.where("a <> b").where(_close(percent))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Links:
    """Verified links and the components they make so far."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        spark = sets.sparkSession
        self.tested = spark.createDataFrame([], "a long, b long")
        self.linked = spark.createDataFrame([], "node long, component long")

    def test(self, pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Verify pairs that were not tested yet; they and the links in ``more`` join the components."""
        pairs = materialize(pairs.join(self.tested, ["a", "b"], "left_anti"), "candidates")
        self.tested = self.tested.unionByName(pairs)
        fresh = verify(pairs, self.sets, self.percent)
        fresh = materialize(fresh if more is None else fresh.unionByName(more), "links")
        if not fresh.isEmpty():
            self.linked = materialize(components(self.linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh)), "components")

    def crowd_links(self, bucket: DataFrame) -> DataFrame | None:
        """Compare, in blocks, the members of crowded buckets that are in different components.

        Buckets that share a member are one crowd.  Its largest component's members
        need not meet each other: their blocks only meet the blocks of the others.
        Members of one bucket stand in the same blocks as far as these hold them, and
        two blocks meet only if a bucket has members in both: so a crowd that many
        small buckets chain together costs what these buckets cost.
        """
        if bucket.isEmpty():
            return None
        heads = bucket.groupBy("key").agg(F.min("rep").alias("b"), F.max("c").alias("c"))
        crowds = materialize(components(_by_key(bucket, heads).select(F.col("rep").alias("a"), "b")), "crowds").select(F.col("node").alias("rep"), F.col("component").alias("crowd"))
        rows = bucket.groupBy("rep").agg(F.min("component").alias("component"), F.min("key").alias("home")).join(crowds, "rep")
        parts = rows.groupBy("crowd", "component").agg(F.count("*").alias("c"))
        top = parts.groupBy("crowd").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
        rows = rows.join(top, "crowd").withColumn("stray", F.col("component") != F.col("top.component"))
        homes = rows.groupBy("home", "stray").agg(F.count("*").alias("m"))
        share = F.ceil(F.when(F.col("stray"), F.col("all") - F.col("top.c")).otherwise(F.col("top.c")) / BLOCK)
        alone = F.xxhash64("home", F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("m") / BLOCK)))
        block = F.when(F.col("m") > BLOCK, alone).otherwise(F.pmod(F.xxhash64("home", F.lit(3)), share))
        rows = materialize(rows.join(homes, ["home", "stray"]).select("crowd", "rep", "component", "stray", block.cast("long").alias("block")), "crowd-rows")
        held = materialize(bucket.select("key", "rep").join(rows, "rep").select("key", "crowd", "stray", "block").distinct(), "held")
        left = held.where("stray").select("key", "crowd", F.col("block").alias("i"))
        right = held.select("key", F.col("stray").alias("s"), F.col("block").alias("j"))
        meet = left.join(right, "key").where("not s or i <= j").select("crowd", "i", "s", "j").distinct()
        sides = meet.select("crowd", "i", "s", "j", F.explode(F.array(F.struct(F.lit(True).alias("stray"), F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("s").alias("stray"), F.col("j").alias("block"), F.lit(1).alias("side")))).alias("x"))
        sides = sides.select("crowd", "i", "s", "j", "x.stray", "x.block", "x.side")
        placed = rows.join(self.sets, F.col("rep") == F.col("node")).join(sides, ["crowd", "stray", "block"])
        placed = placed.select(F.xxhash64("crowd", "i", "s", "j").alias("task"), "crowd", "i", "s", "j", "side", "rep", "component", "grams")
        dealt = placed.repartition("crowd", "i", "s", "j").sortWithinPartitions("crowd", "i", "s", "j", "side")
        return dealt.select("task", "side", "rep", "component", "grams").mapInArrow(giving_back(_compare_blocks(self.percent)), "a long, b long")

    def mixed(self, bucket: DataFrame) -> DataFrame:
        """The buckets with several components: rows with ``component``, the bucket's ``largest`` and its ``strays``."""
        now = bucket.select("key", "rep", "n", "c").join(self.linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        parts = now.groupBy("key", "component").agg(F.count("*").alias("c"))
        facts = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
        facts = facts.select("key", F.col("top.component").alias("largest"), F.col("all").alias("members"), (F.col("all") - F.col("top.c")).alias("strays"), F.col("all").alias("c"))
        return materialize(_by_key(now, facts), "mixed")


def _compare_blocks(percent: int):
    """Links between the two sides of each block pair; rows of one pair follow each other.

    Common shingles are counted for all pairs of a block at once: those in many
    members by a matrix product, the others by expanding their short lists.  Only
    links that join components are emitted, so there are fewer than members.
    """

    def links(sides):
        (a_ids, a_parts, a_sets), (b_ids, b_parts, b_sets) = sides
        if not a_ids or not b_ids:
            return []
        a_n, b_n = (np.array([len(x) for x in sets]) for sets in (a_sets, b_sets))
        a_rows, b_rows = np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)
        both = np.unique(np.concatenate(a_sets + b_sets), return_inverse=True)[1]
        a_cols, b_cols = both[: len(a_rows)], both[len(a_rows) :]
        width = int(both.max()) + 1 if len(both) else 0
        per_a, per_b = np.bincount(a_cols, minlength=width), np.bincount(b_cols, minlength=width)
        common = np.zeros(len(a_n) * len(b_n), np.int64)
        dense = np.flatnonzero(per_a * per_b > 256)
        for at in range(0, len(dense), 4096):
            column = np.full(width, -1, np.int64)
            part = dense[at : at + 4096]
            column[part] = np.arange(len(part))
            grids = []
            for rows, cols, n in ((a_rows, a_cols, len(a_n)), (b_rows, b_cols, len(b_n))):
                grid, live = np.zeros((n, len(part)), np.float32), column[cols] >= 0
                grid[rows[live], column[cols[live]]] = 1
                grids.append(grid)
            common += np.rint(grids[0] @ grids[1].T).astype(np.int64).reshape(-1)
        order = np.argsort(b_cols, kind="stable")
        starts = np.append(0, np.cumsum(per_b))
        use = (per_a * per_b <= 256)[a_cols] & (per_b[a_cols] > 0)
        rows, cols = a_rows[use], a_cols[use]
        times = per_b[cols]
        reached = np.cumsum(times)
        cuts = np.searchsorted(reached, np.arange(EXPANDED, int(reached[-1]) if len(rows) else 0, EXPANDED))
        for at, to in zip([0, *cuts], [*cuts, len(rows)]):
            r, c, t = rows[at:to], cols[at:to], times[at:to]
            inside = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            common += np.bincount(np.repeat(r, t) * len(b_n) + b_rows[order[np.repeat(starts[c], t) + inside]], minlength=len(common))
        union = a_n[:, None] + b_n[None, :] - common.reshape(len(a_n), len(b_n))
        near = 100 * common.reshape(union.shape) >= percent * union
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(near & (np.array(a_parts)[:, None] != np.array(b_parts)[None, :])):
            x, y = find(a_parts[i]), find(b_parts[j])
            if x != y:
                parent[x] = y
                out.append((a_ids[i], b_ids[j]))
        return out

    def run(batches):
        at, sides = None, [([], [], []), ([], [], [])]
        for batch in batches:
            found = []
            for task, side, rep, component, grams in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if task != at:
                    found += links(sides)
                    at, sides = task, [([], [], []), ([], [], [])]
                for column, value in zip(sides[side], (rep, component, np.frombuffer(grams.as_buffer(), np.uint64).copy())):
                    column.append(value)
            yield _edges(found)
        yield _edges(links(sides))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])
