import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, query_id int"


def plain(rows, every=20, k=20):
    """(query_id, rank, vec_id, score) by all inner products, terms added in order, of rows that take part."""
    kept = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            kept[i] = max(kept.get(i, v), v)
    ids = sorted(kept)
    if not ids:
        return []
    x = np.array([kept[i] for i in ids]).reshape(len(ids), -1)
    out = []
    for i in ids:
        if i % every == 0:
            score = np.zeros(len(ids))
            for c in range(x.shape[1]):
                score += x[:, c] * kept[i][c]
            order = [o for o in np.lexsort((ids, -score)) if ids[o] != i][:k]
            out += [(i, n + 1, ids[o], score[o]) for n, o in enumerate(order)]
    return out


def clustered(n, size, seed, norms=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((12, size))[rng.integers(0, 12, n)] + rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x * rng.uniform(0.2, 3, (n, 1)) if norms else x


def share(found, wanted):
    return len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in wanted}) / len(wanted)


def checked(found, rows, wanted):
    """Ranks, order and scores of what was found are exact."""
    vector = {}
    for i, v, *_ in rows:
        if i is not None and v:
            vector[i] = max(vector.get(i, list(v)), list(v))
    assert sorted((q, r) for q, r, *_ in found) == sorted((q, r) for q, r, *_ in wanted)
    by_rank = sorted(found)
    for (q, r, v, s), following in zip(by_rank, [*by_rank[1:], None]):
        exact = 0.0
        for a, b in zip(vector[q], vector[v]):
            exact += float(np.float32(a)) * float(np.float32(b))
        assert v != q and s == exact
        if following and following[0] == q:
            assert (-s, v) < (-following[3], following[2])


@pytest.mark.parametrize("norms", [False, True])
def test_nearest_vectors(spark, norms):
    from textloom.llm.nearest import nearest_vectors

    rows = [(i, v, 1) for i, v in enumerate(clustered(3000, 24, 1, norms).tolist())]
    found = [tuple(r) for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    wanted = plain(rows)
    checked(found, rows, wanted)
    assert share(found, wanted) > 0.95


def test_odd_vectors(spark, monkeypatch):
    """Copies, ties, odd values and repeated rows, over lists in several parts and sparse pairs."""
    from textloom.llm import nearest

    monkeypatch.setattr(nearest, "PART_ROWS", 40)
    monkeypatch.setattr(nearest, "TRIAL_RECALL", 1.0)
    nan, inf = float("nan"), float("inf")
    base = clustered(400, 8, 2).tolist()
    rows = [(i, v, 0) for i, v in enumerate(base)]
    rows += [(1000 + i, base[3], 0) for i in range(300)]  # a third of all rows
    rows += [(2000 + i, [1.0 if k == i % 8 else 0.0 for k in range(8)], 0) for i in range(40)]
    rows += [(3000, [0.0] * 8, 0), (3020, None, 0), (3040, [nan] + [1.0] * 7, 0), (3060, [inf] + [1.0] * 7, 0), (3080, [None] + [1.0] * 7, 0), (3100, [], 0), (3120, [1.0] * 9, 0)]
    rows += [(None, base[0], 0), (40, base[40], 0), (40, base[40], 0), (-20, base[7], 0)]
    found = [tuple(r) for r in nearest.nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    wanted = plain([r for r in rows if r[0] != 3120])
    checked(found, rows, wanted)
    assert share(found, wanted) > 0.99


def test_few_vectors(spark):
    from textloom.llm.nearest import nearest_vectors

    for rows in ([], [(20, [1.0, 2.0], 0)], [(21, [1.0, 2.0], 0), (22, [2.0, 1.0], 0)], [(20, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (5, [-1.0, 0.5], 0)], [(20, [0.0], 0)]):
        found = nearest_vectors(spark.createDataFrame(rows, SCHEMA))
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, found.collect())) == sorted(plain(rows))


def test_abandoned_candidates_are_far(spark):
    """With a bar, hardly any vector beyond it stays, and hardly any within is lost."""
    import pyarrow as pa

    from textloom.llm.nearest import Part, Space

    x = clustered(4000, 96, 3)
    space = Space(x[:1000], 1.0, 20)
    part = Part(space, x, pa.array([[i] for i in range(len(x))], pa.list_(pa.int64())))
    scores = x[:50] @ x.T
    bar = np.sort(scores, axis=1)[:, -21]
    rows, cols, far = part.candidates(x[:50], bar)
    assert np.allclose(far, 2 - 2 * scores[rows, cols])
    assert len(rows) <= 50 * 21 and len(rows) >= 0.97 * 50 * 21
