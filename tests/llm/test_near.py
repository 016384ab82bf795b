import random

import pytest

from tests.llm import brute
from textloom.llm import near
from textloom.llm.near import near_duplicates


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [4, 5])
def test_like_brute_force_with_crowds(spark, width):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.08])))) for i in range(160)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 30])))) for i in range(60)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(40)]
    rows += [(3000, ""), (3001, None), (3002, " \n\t "), (3003, "one"), (3004, "ONE"), (3005, "a  b\nc"), (3006, "a b c")]
    got = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width))
    assert got == brute.near(rows, width)


def test_crowd_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.02, 0.03, 0.05])))) for i in range(300)]
    monkeypatch.setattr(near, "BLOCK", 40)
    got = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5))
    assert got == brute.near(rows, 5)


def test_odd_rows(spark):
    rows = [(None, "x y z", 1), (5, "x y z", 2), (5, "x y z", 3), (6, None, 4)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int"), 5).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(5, 5, True), (5, 5, True), (6, 6, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 5).collect() == []
