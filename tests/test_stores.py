"""Stores in segments: sketches and the positional index, against joins of whole tables and plain counts."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import folding
from textloom.functions.stem import stem
from textloom.operators import overlap
from textloom.sources import segmented
from textloom.sources.segmented import FACTS
from textloom.sources.sketches import SketchStore
from textloom.sources.textindex import TextIndex


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def passages():
    base = [words(k, 120) for k in range(8)]
    rng = random.Random(4)
    docs = [(i, base[i % 8] + " " + words(100 + i, rng.randint(1, 80))) for i in range(40)]
    return docs + [(90, None), (91, ""), (92, "short"), (93, "é漢字 " * 40)]


def plain_probe(probes, docs, cutoff, shared):
    kept = lambda t: {int(h) for h in folding.shingles(folding.fold(t or "").body) if int(h) % 32 == 0}
    index = {k: kept(t) for k, t in docs}
    df = collections.Counter(h for s in index.values() for h in s)
    usual = {h for h, n in df.items() if n < cutoff}
    return {(a, b, n) for a, t in probes for b, s in index.items() if (n := len(kept(t) & s & usual)) >= shared}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_sketch_store(spark, tmp_path):
    docs = passages()
    df = spark.createDataFrame(docs, "id long, text string")
    probes = spark.createDataFrame([(k, t) for k, t in docs[:6]] + [(7, None), (8, words(3, 60))], "id long, text string")
    plain = [(r["id"], r["text"]) for r in probes.collect()]
    store = SketchStore(spark, str(tmp_path / "s"))
    assert store.probe(probes, "id", "text").collect() == [] and store.facts().collect() == []
    assert store.update(df, "id", "text") == {"changed": 44, "gone": 0} and store.update(df, "id", "text") == {"changed": 0, "gone": 0}
    assert store.manifest()["version"] == 0
    for cutoff in (3, 12):
        assert rows(store.probe(probes, "id", "text", cutoff)) == plain_probe(plain, docs, cutoff, 3)
    # the same as the join of all sketches
    sketch = lambda d, name: overlap.sketch(overlap.shingles(d, "id", "text").withColumnRenamed("id", name), name)
    assert rows(store.probe(probes, "id", "text")) == rows(overlap.candidates(sketch(probes, "a"), sketch(df, "b"))) != set()
    # one changed text, one new, some gone: the changed and the new one alone are sketched again
    later = [(i, t) if i != 5 else (5, words(5, 200)) for i, t in docs if i not in (8, 90)] + [(200, docs[3][1])]
    assert store.update(spark.createDataFrame(later, "id long, text string"), "id", "text", whole=True) == {"changed": 2, "gone": 2}
    manifest = store.manifest()
    assert store._segment(manifest["segments"][1], [FACTS]).where("not gone").count() == 2
    assert rows(store.probe(probes, "id", "text")) == plain_probe(plain, later, 12, 3)
    facts = {r["key"]: (r["chars"], r["total"], r["sampled"]) for r in store.facts().collect()}
    for k, t in later:
        h = set(folding.shingles(folding.fold(t or "").body).tolist())
        assert facts[k] == (len(folding.fold(t or "").body), len(h), sum(x % 32 == 0 for x in h))
    before = rows(store.masks(4))
    assert before == rows(overlap.masks(overlap.shingles(spark.createDataFrame(later, "id long, text string"), "id", "text"), "id", overlap.generic(sketch(spark.createDataFrame(later, "id long, text string"), "b"), "b", 4))) != set()
    store.merge()
    assert len(store.manifest()["segments"]) == 1 and rows(store.masks(4)) == before
    assert len(store._names(f"{store.path}/segments")) == 3
    store.vacuum()
    assert len(store._names(f"{store.path}/segments")) == 1 and rows(store.probe(probes, "id", "text")) == plain_probe(plain, later, 12, 3)
    assert store.recipes() == ["w32-m32"]
    store.clear()
    assert store.probe(probes, "id", "text").collect() == []
    with pytest.raises(PermissionError):
        SketchStore(spark, str(tmp_path / "s"), read_only=True).update(df, "id", "text")


def test_a_probe_opens_its_buckets_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SketchStore, "CHARS", 150)
    docs = [(i, words(i, 300)) for i in range(30)]
    store = SketchStore(spark, str(tmp_path / "s"))
    store.update(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    assert store.manifest()["buckets"] > 300
    probe = spark.createDataFrame([(1, docs[0][1][:400])], "id long, text string")
    wanted = store.sketch_of(probe, "id", "text")
    opened, all_files = store.postings(wanted).inputFiles(), store.postings().inputFiles()
    assert 0 < len(opened) <= wanted.count() < len(all_files) / 10
    assert rows(store.probe(probe, "id", "text")) == plain_probe([(1, docs[0][1][:400])], docs, 12, 3) != set()


def test_builds_that_break_or_meet(spark, tmp_path):
    docs = spark.createDataFrame(passages(), "id long, text string")
    store, other = SketchStore(spark, str(tmp_path / "s")), SketchStore(spark, str(tmp_path / "s"))
    store.update(docs.where("id < 20"), "id", "text")
    seen = rows(store.facts())
    manifest = other.manifest()
    other._write(other.derived(other._prepared(docs, "id", "text")).withColumn("gone", F.lit(False)).select(*other.schema.names), 1)  # a build that ended before its manifest
    assert rows(store.facts()) == seen
    store.update(docs.where("id < 30"), "id", "text")
    with pytest.raises(Exception, match="(?i)already exists"):
        other._commit(manifest, [], 0)
    assert store.documents().count() == 30
    repeated = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "x"), (3, "~ the text that sorts last by digest or not")], "id long, text string"))
    store.update(repeated, "id", "text")
    assert store.documents().count() == store.documents().select("key").distinct().count() == 44
    assert store.rows().groupBy("key", "hash").count().where("count > 1").count() == 0
    empty = SketchStore(spark, str(tmp_path / "e"))
    assert empty.update(docs.limit(0), "id", "text", whole=True) == {"changed": 0, "gone": 0} and empty.documents().collect() == []


# ---------------------------------------------------------------- text index


def plain_scores(docs, query, stemmed=False):
    """BM25 of each phrase by counting where its tokens follow each other."""
    form = stem if stemmed else (lambda t: t)
    listed = {k: [form(t) for t in re.findall(r"[^\W_]+", (t or "").lower())] for k, t in docs}
    asked = [[form(t.lower()) for t in re.findall(r"[^\W_]+", w)] for w in query.split()]
    n, mean = len(docs), sum(map(len, listed.values())) / len(docs)
    out = collections.defaultdict(float)
    for p in (p for p in asked if p):
        tf = {k: sum(t[i : i + len(p)] == p for i in range(len(t))) for k, t in listed.items()}
        df = sum(x > 0 for x in tf.values())
        for k, x in tf.items():
            if x:
                out[k] += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(listed[k]) / mean))
            elif any(sum(t[i : i + len(q)] == q for i in range(len(t))) for q in asked for t in [listed[k]] if q):
                out[k] += 0
    return out


VOCABULARY = "state states stately art arts of the running runs run plan planning planned é über naïve 42 7th".split()


def sentences(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([" ", "-", ". "]).join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("stemmed", [False, True])
def test_text_index(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(TextIndex, "CHARS", 400)
    docs = sentences(1, 60) + [(70, None), (71, "")]
    index = TextIndex(spark, str(tmp_path / "i"), stemmed=stemmed)
    assert index.search("state").collect() == []
    index.update(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    queries = ["state-of-the-art planning", "running", "the-the the", "art's 42", "nowhere", "Über-naïve É state state"]
    def same(queries=[queries[0] + " Über-naïve É state state"]):
        for q in queries:
            got = {r["key"]: r["score"] for r in index.search(q).collect()}
            wanted = {k: s for k, s in plain_scores(list(live.items()), q, stemmed).items()}
            assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k]) for k in got), q
    live = dict(docs)
    same(queries if stemmed else queries[:4])
    assert index.search(" ").collect() == [] == index.search([]).collect()
    assert {r["key"] for r in index.search(["art", "of"]).collect()} == {r["key"] for r in index.search("art of").collect()}
    # a changed document alone is written; deletions; a merge
    assert index.update(spark.createDataFrame([(5, "state of the art state of the art"), (6, live[6])], "id long, text string"), "id", "text") == {"changed": 1, "gone": 0}
    live[5] = "state of the art state of the art"
    assert index._segment(index.manifest()["segments"][1], None).select("key").distinct().collect() == [(5,)]
    same()
    index.delete(spark.createDataFrame([(5,), (9,), (999,)], "key long"))
    del live[5], live[9]
    index.merge()
    index.vacuum()
    assert len(index.manifest()["segments"]) == 1
    same()
    index.update(spark.createDataFrame([(9, "planned art")], "id long, text string"), "id", "text")
    live[9] = "planned art"
    same()


def test_builds_and_merges_leave_little_behind(spark, tmp_path, monkeypatch):
    """Shuffled rows go with the build; a merge with marks alone shuffles no rows, unless too many documents went; the rows are the same."""
    sc = spark.sparkContext
    no = sc._jvm.java.util.ArrayList()
    manager = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = sc._jsc.sc().statusStore().stageList(no, False, False, sc._gateway.new_array(sc._jvm.double, 0), no)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    def kept():
        files = manager.getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    monkeypatch.setattr(TextIndex, "CHARS", 100_000)
    docs = [(i, words(i, 4000)) for i in range(60)]
    text = sum(len(t) for _, t in docs)
    took, found, settings = {}, {}, {k: spark.conf.get(k, None) for k in segmented.WRITING}
    for most in (0, 1 << 20):
        monkeypatch.setattr(segmented, "MOST_DEAD", most)
        index = TextIndex(spark, str(tmp_path / f"i{most}"))
        there = kept()
        index.update(spark.createDataFrame(docs, "id long, text string"), "id", "text")
        assert kept() - there < 0.2 * text
        index.delete(spark.createDataFrame([(3,), (8,)], "key long"))
        wanted, before = {(r["key"], r["term"], tuple(r["positions"]), r["dl"]) for r in index.rows().collect()}, shuffled()
        index.merge()
        took[most] = shuffled() - before
        index.vacuum()
        found[most] = {(r["key"], r["term"], tuple(r["positions"]), r["dl"]) for r in index.rows().collect()}
        assert found[most] == wanted and {k for k, *_ in wanted} == {i for i, _ in docs} - {3, 8} and index.documents().count() == 58
    assert took[1 << 20] < took[0] / 10
    assert {k: spark.conf.get(k, None) for k in segmented.WRITING} == settings


def test_index_opens_its_terms_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TextIndex, "CHARS", 100)
    index = TextIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([(i, words(i, 100)) for i in range(30)], "id long, text string"), "id", "text")
    buckets = index.manifest()["buckets"]
    opened = index.rows([3, 5]).inputFiles()
    assert buckets > 100 and len(opened) <= 2 and len(index.rows().inputFiles()) > 50


def test_places_of_terms():
    import pyarrow as pa

    from textloom.sources.textindex import placed

    own, terms, at = placed(pa.array([["b", "a", "b"], [], ["runs", "run", "a"]]), True)
    assert list(zip(own.tolist(), terms.to_pylist(), at.to_pylist())) in ([(0, "b", [0, 2]), (0, "a", [1]), (2, "a", [2]), (2, "run", [0, 1])],)
    assert placed(pa.array([[], []], pa.list_(pa.string())), False)[0].tolist() == []


def test_rolled_hash_is_the_windows(spark):
    text = "Recorded under Auditor's File No. 200806030039, Volume 12 of Plats, ÉCOLE, page 44; King County."
    found = overlap.shingles(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, text string"), "id", "text").orderBy("at").collect()
    body = folding.fold(text).body
    assert [r["hash"] for r in found] == folding.shingles(body).view(np.int64).tolist() and [r["at"] for r in found] == list(range(len(body) - 31))
