"""What a task holds and hands on does not grow with its input; each result against a plain version."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.functions.stem import stem
from textloom.operators import overlap, search, similar
from textloom.plans.tasks import spread
from textloom.sources import mbox
from textloom.sources.textindex import TextIndex


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["run", "running", "Runs", "idiots", "idiot", "été", "relation", "x1", "plain"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_stemmed_search_explodes_nothing(spark):
    """no row for a token; every row a document, as the SQL has it, two of one key too."""
    data = [*texts(60), (3, "running idiots"), (3, "runs plain")]
    hits = search.bm25(spark.createDataFrame(data, "id long, text string"), "id", "text", ["running", "idiots"], stemmed=True)
    assert "Generate" not in hits._jdf.queryExecution().toString()
    split = [(i, (t or "").lower().split(), t) for i, t in data]
    counts = [(i, len(w), [sum(stem(x) == s for x in w) for s in ("run", "idiot")]) for i, w, _ in split]
    n, mean = len(data), sum(d for (_, d, _), (_, _, t) in zip(counts, split) if t is not None) / sum(t is not None for _, t in data)
    df = [sum(c[2][k] > 0 for c in counts) for k in (0, 1)]
    idf = [max(np.log((n - d + 0.5) / (d + 0.5)), 1e-6) for d in df]
    want = sorted((i, round(sum(idf[k] * f[k] * 2.2 / (f[k] + 1.2 * (0.25 + 0.75 * d / mean)) for k in (0, 1)), 9)) for i, d, f in counts if sum(f))
    assert sorted((r["id"], round(r["score"], 9)) for r in hits.collect()) == want


def test_term_stats(spark):
    """rows of one key are one document, rows without key are in none; no row for each term of each document is shuffled."""
    data = [*texts(80), (3, "run run odd"), (None, "run new"), (None, "new")]
    found = search.term_stats(spark.createDataFrame(data, "id long, text string"), "id", "text")
    assert "Generate" not in found._jdf.queryExecution().toString()
    tokens = [(i, w) for i, t in data for w in (t or "").lower().split()]
    want = {w: (len({i for i, x in tokens if x == w and i is not None}), sum(x == w for _, x in tokens)) for _, w in tokens}
    assert {r["term"]: (r["df"], r["cf"]) for r in found.collect()} == want


def test_taken_by_size():
    """F3 to F8, F11, F13, F14: what is derived from texts is handed on by size, whole and in order."""
    sizes = [3, 0, 50, 1, 1, 9, 2]
    groups = list(overlap.taken(len(sizes), lambda i: (np.full(sizes[i], i),), 10))
    assert [i for g in groups for i, _ in g] == list(range(7)) and [len(x[0]) for g in groups for _, x in g] == sizes
    assert all(sum(len(x[0]) for _, x in g[:-1]) < 10 for g in groups) and len(groups) == 3
    assert list(overlap.taken(0, None)) == []


def test_batches_of_long_texts_are_short(spark):
    """Arrow hands over fewer rows at once where the session has Spark's own number; facts are as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.createDataFrame([(i, (t or "") * 3) for i, t in texts(40)], "id long, text string")
        found = {r["id"]: (r["total"], r["sampled"]) for r in overlap.sketch_facts(docs, "id", "text").collect()}
        spread(docs)
        assert int(spark.conf.get(key)) <= 2000
        hashes = {r["id"]: set(folding.shingles(folding.fold(r["text"]).body).tolist()) for r in docs.collect()}
        assert found == {i: (len(h), sum(x % 32 == 0 for x in h)) for i, h in hashes.items() if h}
    finally:
        spark.conf.set(key, before)


def test_masks_from_the_sketch_alone(spark):
    """the sampled shingles and the lengths give the masks of all shingles."""
    docs = spark.createDataFrame([(i, "of one passage that is in every text of these, word for word, and long " * 2 + f"and its own end {i} " * (i % 3)) for i in range(6)], "id long, text string")
    whole, some = overlap.shingles(docs, "id", "text"), overlap.shingles(docs, "id", "text", modulus=32)
    common = overlap.generic(overlap.sketch(whole, "id"), "id", 3)
    lengths = docs.select("id", F.length(F.lower(F.regexp_replace("text", r"[^\p{L}\p{Nd}]", ""))).alias("length"))
    want = sorted(map(tuple, overlap.masks(whole, "id", common).collect()))
    assert sorted(map(tuple, overlap.masks(some, "id", common, length=lengths).collect())) == want != []


def test_sketches_with_and_without_samples(spark):
    """a text without sampled shingle keeps its one row."""
    rows = similar.sketches(spark.createDataFrame([(1, "a passage that is long enough to have some shingles, twenty times over " * 20), (2, "short"), (3, None)], "id long, text string"), "id", "text").collect()
    assert {(r["id"], r["at"], r["hash"], r["chars"]) for r in rows if r["id"] > 1} == {(2, None, None, 5), (3, None, None, 0)} and sum(r["id"] == 1 for r in rows) > 5


def test_rows_of_terms_carry_no_digest(spark, tmp_path):
    """a document's digest is with its facts, not with each of its terms."""
    index = TextIndex(spark, f"file://{tmp_path}")
    index.update(spark.createDataFrame(texts(20), "id long, text string"), "id", "text")
    stored = index._read(index.manifest(), None)
    assert stored.count() > 20 and stored.where("text_hash is not null").count() == 0 and index.documents().where("text_hash is null").count() == 0


def test_small_ranges_are_read_together(tmp_path):
    """the number of tasks stays when an archive grows; the ranges cover it, and messages come once."""
    data = "".join(f"From x\nSubject: {i}\n\nbody {i}\n\n" for i in range(4000)).encode()
    (tmp_path / "a.mbox").write_bytes(data)
    parts = mbox.MboxReader(str(tmp_path), 16).partitions()
    assert len(parts) <= mbox.MANY and [p.start for p in parts] == [0, *(p.end for p in parts[:-1])] and parts[-1].end == len(data)
    with open(tmp_path / "a.mbox", "rb") as file:
        assert sum(1 for p in parts for _ in mbox.messages_in(file, p.start, p.end)) == 4000
    few = mbox.MboxReader(str(tmp_path), 1 << 12).partitions()
    assert len(few) == -(-len(data) // (1 << 12))
