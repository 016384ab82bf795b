"""Nearest vectors by inner product: lists around centroids, scanned by column blocks of rotated vectors with early abandoning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import giving_back, materialize, slices, split_table

SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 16 << 20  # vectors that the centroids are fitted on
MOST_LISTS = 1024
TRIAL_QUERIES = 128  # queries that are also searched exhaustively, to choose the number of lists
TRIAL_RECALL = 0.98
PART_ROWS = 8192  # vectors of a list that one task scans at a time
CELLS = 1 << 21  # of a matrix of partial distances
BLOCK = 16  # dimensions that are added before candidates are tested again
DOUBT = 2.1  # deviations that the test allows a partial distance
SPARSE = 0.25  # share of candidates left from which on pairs are followed one by one


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, the terms added in their order, so that equal vectors always have equal ones."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Space:
    """Centroids and a rotation.  A coordinate that fills all vectors to one norm makes the largest inner product the least distance.

    With |x|^2 + f^2 = m for each vector, |q|^2 + m - 2 qx is the squared distance of
    (q, 0) and (x, f).
    """

    def __init__(self, sample: np.ndarray, norm: float, lists: int, rounds: int = 8, seed: int = 7):
        self.norm = norm
        rng, points = np.random.default_rng(seed), self.filled(sample)
        size = points.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(rounds):
            own = self.order(points, 1)[:, 0]
            sums, count = np.zeros_like(self.centroids), np.bincount(own, minlength=len(self.centroids))
            np.add.at(sums, own, points)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centroids)

    def filled(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm - np.einsum("ij,ij->i", x, x), 0.0)
        return np.column_stack([x, np.sqrt(rest)])

    @staticmethod
    def asking(q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))])

    def order(self, points: np.ndarray, most: int) -> np.ndarray:
        """The nearest ``most`` centroids of each point, nearest first; ties to the smaller number."""
        out = []
        for at in range(0, len(points), 4096):
            far = np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * points[at : at + 4096] @ self.centroids.T
            out.append(np.argsort(far, axis=1, kind="stable")[:, :most])
        return np.concatenate(out) if out else np.zeros((0, most), np.int64)


class Part:
    """Vectors of a list, rotated, in blocks of columns."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: pa.ListArray):
        self.space, self.vectors = space, vectors
        self.ids, self.bounds = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        turned = space.filled(vectors) @ space.rotation
        self.cuts = [*range(0, turned.shape[1], BLOCK), turned.shape[1]]
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(self.cuts, self.cuts[1:])]
        self.squares = [np.einsum("ij,ij->i", b, b) for b in self.blocks]

    def candidates(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, vector) that no test abandoned, with their squared distances.

        After each block of columns a pair's partial distance d, over a share s of all
        columns, estimates the whole as d / s.  It is abandoned where even that estimate's
        usual error leaves it beyond the distance that the score ``least`` stands for.
        """
        turned = Space.asking(queries) @ self.space.rotation
        total = turned.shape[1]
        limit = np.einsum("ij,ij->i", queries, queries) + self.space.norm - 2 * least
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0)))
        far, rows, cols = np.zeros((len(queries), len(self.vectors))), None, None
        for block, square, a, b in zip(self.blocks, self.squares, self.cuts, self.cuts[1:]):
            part = turned[:, a:b]
            if rows is None:
                far += np.einsum("ij,ij->i", part, part)[:, None] + square - 2 * part @ block.T
            else:
                gap = part[rows] - block[cols]
                far += np.einsum("ij,ij->i", gap, gap)
            allowed = limit * (b / total) * (1 + DOUBT / np.sqrt(b)) ** 2 if b < total else limit
            allowed = allowed + slack
            if rows is None:
                left = far <= allowed[:, None]
                if b == total or left.mean() < SPARSE:
                    rows, cols = np.nonzero(left)
                    far = far[rows, cols]
            else:
                left = far <= allowed[rows]
                rows, cols, far = rows[left], cols[left], far[left]
        return rows, cols, far

    def nearest(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query at most ``k`` (query, id, score) of at least ``least``, by score, ties to the smaller id."""
        rows, cols, far = self.candidates(queries, least)
        order = np.lexsort((far, rows))
        rows, cols, far = rows[order], cols[order], far[order]
        first = np.searchsorted(rows, np.arange(len(queries) + 1))
        bar = np.full(len(queries), np.inf)
        many = np.flatnonzero(np.diff(first) > k)
        bar[many] = far[first[many] + k - 1]
        keep = far <= bar[rows] + 1e-9 * (1 + np.abs(far))
        rows, cols = rows[keep], cols[keep]
        score = dot(queries[rows], self.vectors[cols])
        count = self.bounds[cols + 1] - self.bounds[cols]
        pair = np.repeat(np.arange(len(rows)), count)
        ids = self.ids[self.bounds[cols][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)]
        rows, score = rows[pair], score[pair]
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[keep], ids[keep], score[keep]


# ---------------------------------------------------------------- tables


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not zero and has finite components only, of the commonest number of them."""
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = "vec_id is not null and forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.where(fine)
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"))  # rows of one id count once
    rows = materialize(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """Each different vector once, with its ``k`` smallest ids; no result of k needs another of them."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _first_rows(rows: DataFrame, key: Column, most: int) -> np.ndarray:
    """A sample of at most ``most`` vectors, the same each time: those with the least hashes of their keys."""
    return _matrix(rows.orderBy(F.xxhash64(key)).limit(most).select("v").toArrow().column(0))


def _in_lists(rows: DataFrame, space, most: int | None) -> DataFrame:
    """``rows`` (v and others) with the list of each vector, or with the ``most`` lists that a query asks first."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(batch.schema.get_field_index("v")))
            points = space.value.filled(vectors) if most is None else space.value.asking(vectors)
            lists = space.value.order(points, most or 1)
            column = pa.array(lists[:, 0], pa.int32()) if most is None else pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), pa.array(lists.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return split_table(rows, rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(giving_back(run), f"{kinds}, `list` {'int' if most is None else 'array<int>'}")


def _lists_asked(listed: DataFrame, trial: np.ndarray, space, k: int) -> int:
    """How many lists hold TRIAL_RECALL of the nearest ``k`` of the trial queries, which are searched here among all vectors."""
    queries = listed.sparkSession.sparkContext.broadcast(trial)  # at most TRIAL_QUERIES

    def run(batches):
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            if batch.num_rows:
                vectors, lists = _matrix(batch.column(0)), batch.column(1).to_numpy()
                scores = queries.value @ vectors.T
                top = np.argpartition(-scores, min(k, len(vectors)) - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(scores)), top.shape[1])
                best = [np.append(x, y) for x, y in zip(best, (rows, scores[rows, top.ravel()], lists[top.ravel()]))]
                order = np.lexsort((-best[1], best[0]))
                best = [x[order] for x in best]
                keep = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) < k
                best = [x[keep] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2], pa.int32())], names=["query", "score", "list"])

    found = listed.select("v", "list").mapInArrow(run, "query int, score double, list int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    rows = found.withColumn("place", place).where(F.col("place") <= k).select("query", "list").collect()  # k for each trial query
    order = space.order(Space.asking(trial), len(space.centroids))
    ranks = sorted(int(np.flatnonzero(order[r["query"]] == r["list"])[0]) for r in rows)
    return ranks[int(np.ceil(TRIAL_RECALL * len(ranks))) - 1] + 1


def _scanned(vectors: DataFrame, queries: DataFrame, parts: DataFrame, space, k: int) -> DataFrame:
    """(query_key, vec_id, score) of the best ``k`` in each asked list: its vectors come first, a part at a time, then the queries pass by."""
    vectors = vectors.join(parts, "list").select("list", F.expr("cast(pmod(xxhash64(ids[0]), parts) as int)").alias("part"), F.lit(0).alias("turn"), "v", "ids")
    queries = queries.join(parts, "list").select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(1).alias("turn"), "v", "query_key", "least")

    def run(batches):
        at, held, ids, part = None, [], [], None
        for (list_, piece, turn), rows in slices(batches, "list", "part", "turn"):
            column = lambda name: rows.column(rows.schema.get_field_index(name))
            if (list_, piece) != at:
                at, held, ids, part = (list_, piece), [], [], None
            if turn == 0:
                held.append(_matrix(column("v")))
                ids.append(column("ids"))
                continue
            if not held:
                continue
            part = part or Part(space.value, np.concatenate(held), pa.concat_arrays(ids))
            asked, least, keys = _matrix(column("v")), column("least").to_numpy(zero_copy_only=False), column("query_key").to_numpy()
            step = max(1, CELLS // len(part.vectors))
            for a in range(0, len(asked), step):
                found, of, score = part.nearest(asked[a : a + step], least[a : a + step], k)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a + found]), pa.array(of), pa.array(score)], names=["query_key", "vec_id", "score"])

    rows = vectors.unionByName(queries, allowMissingColumns=True).repartition("list", "part").sortWithinPartitions("list", "part", "turn")
    return rows.mapInArrow(giving_back(run), "query_key long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id ``every`` divides, among all other rows: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product, in double precision; ties go to the smaller id.  The
    centroids are fitted on at most SAMPLE_ROWS vectors, every vector is in a list, and
    the number of lists that a query asks is the least that holds TRIAL_RECALL of what
    an exhaustive search finds for TRIAL_QUERIES of them.  A query's nearest list gives
    it a bar, and candidates of the other lists are abandoned as soon as a test on their
    first columns puts them beyond it.

    Rows without id, and vectors that are null, empty, zero, or hold a null or non-finite
    component, take no part, nor do those whose number of components is not the
    commonest.  Of rows with one id, the vector that sorts last counts.  Equal vectors
    are searched once, so that many copies, as queries or candidates, cost no more than
    one.  An empty table, or no query, gives no rows; fewer candidates give fewer ranks.
    """
    spark, most = vectors.sparkSession, k + 1  # one more, as a query finds itself
    rows = usable(vectors, key, vector)
    asking = rows.where(F.col("vec_id") % every == 0)
    different = materialize(_distinct(rows, most), "different")
    queries = materialize(asking.groupBy("v").agg(F.min("vec_id").alias("query_key")), "queries")
    facts = different.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("norm"), F.max(F.size("v")).alias("size")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _first_rows(different, F.col("ids")[0], min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * facts["size"]))))
    found_space = Space(sample, facts["norm"], max(1, min(MOST_LISTS, round(facts["n"] ** 0.5 / 2))))
    space = spark.sparkContext.broadcast(found_space)  # MOST_LISTS centroids and the rotation
    listed = materialize(_in_lists(different, space, None), "listed")
    trial = _first_rows(queries, F.col("query_key"), TRIAL_QUERIES)
    if not len(trial):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialize(_in_lists(queries, space, _lists_asked(listed, trial, found_space, most)), "asked")
    parts = F.broadcast(listed.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {PART_ROWS}) as int)").alias("parts")))  # a row a list
    none = F.lit(float("-inf")).alias("least")
    near = materialize(_best(_scanned(listed, asked.select("query_key", "v", F.col("list")[0].alias("list"), none), parts, space, most), most), "near")
    bars = near.where(F.col("place") == most).select("query_key", F.col("score").alias("least"))
    others = asked.join(bars, "query_key", "left").select("query_key", "v", F.explode(F.slice("list", 2, 1 << 30)).alias("list"), F.coalesce("least", none).alias("least"))
    found = _best(near.drop("place").unionByName(_scanned(listed, others, parts, space, most)), most)
    lists = found.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")).join(queries, "query_key")
    result = asking.withColumnRenamed("vec_id", "query_id").join(lists, "v").select("query_id", F.expr(f"slice(filter(found, f -> f.vec_id <> query_id), 1, {k})").alias("found"))
    return result.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), "f.vec_id", "f.score")
