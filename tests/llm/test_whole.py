"""Operators that learn from all of their input, however it is split."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from tests.llm import brute


def tree_scores(rows):
    """doc -> score of a tree of depth two, from counts over all training rows."""
    words = {d: brute.words(brute.lower(t)) + ["</s>"] for d, t in rows}
    uni, one, two = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    before = lambda ws, i: (ws[i - 1] if i else "<s>", ws[i - 2] if i > 1 else "<s>")
    for d, ws in words.items():
        if brute.fold(d, 5) != 1:
            for i, w in enumerate(ws):
                w1, w2 = before(ws, i)
                uni[w] += 1
                one[w1][w] += 1
                two[w2, w1][w] += 1
    n, v = sum(uni.values()), len(uni)

    def tested(counts, parent):
        total = sum(counts.values())
        return total >= 2 and sum(c * (math.log(c / total) - parent(w)) + parent(w) for w, c in counts.items()) > 3

    kept1 = {s: tested(c, lambda w: math.log(uni[w] / n)) for s, c in one.items()}

    def mixed(table, state, kept, w, below):
        if not kept.get(state):
            return below
        total = sum(table[state].values())
        return max(table[state][w] - 0.5, 0) / total + 0.5 * len(table[state]) / total * below

    kept2 = {s: tested(c, lambda w: math.log(mixed(one, s[1], kept1, w, uni[w] / n))) for s, c in two.items()}
    out = {}
    for d, ws in words.items():
        out[d] = 0
        for i, w in enumerate(ws):
            w1, w2 = before(ws, i)
            low = (uni[w] + 0.5) / (n + 0.5 * (v + 1))
            out[d] += math.log10(mixed(two, (w2, w1), kept2, w, mixed(one, w1, kept1, w, low)))
    return out


def test_frequent_contexts_learn_from_all_documents(spark, monkeypatch):
    from textloom.llm import suffix_tree

    rng = random.Random(3)
    names = ["the", "of", "and", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(names, [20, 12, 8, *[1] * 60], k=rng.randint(0, 60)) + ["of", "the"] * rng.randint(0, 3))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = tree_scores(rows)
    for chars, frequent in ((suffix_tree.BUCKET_CHARS, suffix_tree.FREQUENT), (2000, suffix_tree.FREQUENT), (2000, 12)):
        monkeypatch.setattr(suffix_tree, "BUCKET_CHARS", chars)
        monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)  # with few frequent words the others come to the root by themselves
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs).collect()}
        assert max(abs(got[d] - wanted[d]) for d in wanted) < 1e-6


def test_word_vectors_cover_all_documents(spark):
    from textloom.llm import quality

    rows = [(i if i % 3 else None, " ".join(f"w{(i * k) % 40}," for k in range(i % 9))) for i in range(90)]
    docs = spark.createDataFrame([*rows, (100, "unlabelled zebra crossing Now!"), (101, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    index = quality.index_vectors().astype(int)
    wanted = np.zeros(index.shape)
    for row in docs.collect():
        symbols = quality._symbols(pa.array([row["text"]], pa.string()))[0]
        for i, own in enumerate(symbols):
            for j in range(max(0, i - 2), min(len(symbols), i + 3)):
                if j != i:
                    for r in own:
                        wanted[r] += index[symbols[j]].sum(0)
    assert np.array_equal(quality.context_sums(docs), wanted)
    vectors = quality.fit(docs, labels, sample=5).vectors
    for r in quality._symbols(pa.array(["unlabelled zebra crossing Now!"]))[0].ravel():
        assert np.allclose(vectors[r], wanted[r] / np.linalg.norm(wanted[r]), atol=1e-6)


def test_pipeline_stages_keep_rows_without_or_with_equal_doc_id(spark, tmp_path):
    from corpus_pipeline import near_duplicate_stage, quality_stage

    rng = random.Random(5)
    text = lambda: " ".join(f"word{rng.randint(0, 9999)}" for _ in range(60))
    a, b, c, d, e, bad = text(), text(), text(), text(), text(), "spam " * 300
    rows = [(None, a), (None, b), (None, bad), (7, c), (7, d), (7, bad), (9, e), (None, a), (8, a), (7, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    order = lambda found: sorted(((r["doc_id"], r["text"]) for r in found), key=str)
    good = quality_stage(spark, docs, str(tmp_path))
    assert order(good.collect()) == sorted((r for r in rows if r[1] != bad), key=str)
    assert order(near_duplicate_stage(spark, good, str(tmp_path)).collect()) == sorted([(None, b), (7, c), (7, d), (8, a), (9, e)], key=str)


def test_all_tested_words_are_in_the_lexicon(spark):
    from textloom.llm.toxicity import fit

    words = lambda kind: " ".join(f"{kind}{k}" for k in range(5000))
    rows = [(i, f"{words('bad' if i < 30 else 'good')} own{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(model.words) == 5000 and (np.diff(model.words.astype(object)) > 0).all()


def test_a_worker_gives_back_a_group_s_memory(spark):
    """Workers live on: what they hold after the scores of 24 MB of text is little more than before them."""
    import re

    from textloom.llm.common import BATCH
    from textloom.llm.suffix_tree import score_documents

    def held(batches):
        import ctypes
        import os
        import time

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        mb = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
        for _ in batches:
            before = mb()
            ctypes.CDLL(None).malloc_trim(0)
            time.sleep(0.5)  # so that each task has a worker of its own
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "before": [before], "trimmed": [mb()]})

    look = lambda: {r["pid"]: r for r in spark.range(0, 8, 1, 8).mapInArrow(held, "pid long, before long, trimmed long").collect()}
    rows = spark.range(0, 12_000, 1, 8).selectExpr("id as doc_id", "array_join(transform(sequence(1, 300), i -> conv(abs(xxhash64(id, i)) % (1 + abs(xxhash64(i, id)) % 90000), 10, 26)), ' ') as text")
    spark.conf.set(BATCH, "2000")
    look()
    score_documents(rows).write.format("noop").mode("overwrite").save()
    assert max(r["before"] - r["trimmed"] for r in look().values()) < 60
