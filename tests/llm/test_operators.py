import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute

ODD = [
    (1, "The cat  sat.\nThe cat  sat.\n", "a", "x"), (2, "", "a", None), (3, None, None, "y"), (None, "no id here at all", "b", "z"),
    (4, "word " * 5000, "b", "x"), (5, " \n\t", "b", "x"), (6, "ééé 漢字 😀 <|endoftext|> it's 12,345.6", "c", "x"), (6, "ééé 漢字 😀 <|endoftext|> it's 12,345.6", "c", "x"), (7, "THE CAT sat", "c", "n_words"),
]
SCHEMA = "doc_id long, text string, source string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 8)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def ids_of(text, end):
    from tokenizers import Tokenizer

    from textloom.llm.common import tokenizer_file

    t = Tokenizer.from_file(tokenizer_file())
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, odd, tmp_path):
    from textloom.llm import store
    from textloom.llm.store import read_documents, store_root, verify_store, write_store

    path = f"{tmp_path}/store"
    write_store(odd, path)
    rows = sorted(verify_store(spark, path).collect(), key=lambda r: r["start"])
    assert all(r["verified"] for r in rows)
    wanted = sorted((d is None, d or 0, crc(ids_of(t, 2)), len(ids_of(t, 2))) for d, t, *_ in ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in rows) == wanted
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 5, 6, 6, 7, None]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    rebuilt = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in read_documents(spark, path).collect()}
    assert rebuilt == {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows}
    root = store_root(spark, path)
    assert root != store.merkle_root([]).hex()
    first = spark.read.parquet(f"{path}/manifest").orderBy("file").first()
    spark.createDataFrame([(first["file"], 1, 1, b"x")], "file int, documents long, ids long, root binary").write.mode("overwrite").parquet(f"{path}/manifest")
    assert store_root(spark, path) != root and not any(r["verified"] for r in verify_store(spark, path).collect())
    spark.createDataFrame([(999, 1, 1, b"x")], "file int, documents long, ids long, root binary").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError):
        verify_store(spark, path)
    write_store(odd.limit(0), f"{path}-empty")
    assert verify_store(spark, f"{path}-empty").collect() == []


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    from textloom.llm import encode
    from textloom.llm.common import tokenizer_file

    rng, plain = random.Random(1), Tokenizer.from_file(tokenizer_file())
    marks = [" ", "\n", "\t", "a", "B", "é", "漢", "😀", "\u00a0", "\u3000", "\u2003", "\x85", "\x1c", "1", "'s", ".", "<|endoftext|>", "<|endof", "\r", "  ", "of the", " the", "x" * 70]
    texts = [None, "", " ", *("".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(1500))]
    own = encode.Encoder()
    for at in range(0, len(texts), 100):
        ids, bounds = own.encode(pa.array(texts[at : at + 100], pa.string()))
        for k, text in enumerate(texts[at : at + 100]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
        own._trim()


def test_packing(spark, odd):
    from textloom.llm.packing import best_fit, pack_documents

    rows = pack_documents(odd, capacity=512).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    four = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 4)
    ids = ids_of(ODD[4][1], 0)
    assert sum(x[2] for x in four) == len(ids) and all(x[3] == crc(ids[x[1] : x[1] + x[2]]) for x in four)
    assert len(rows) == 8 + len(four)
    assert best_fit([6, 5, 4, 4, 1], 10) == [0, 1, 0, 1, 1]
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rules(odd, labels):
    from textloom.llm.rules import quality_rules

    rows = quality_rules(odd, labels)[0].collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["n_words"], got[1]["n_dup_lines"], got[1]["n_repeat_words"], got[1]["base_failed"]) == (6, 1, 0, True)
    assert (got[4]["n_words"], got[4]["n_repeat_words"], got[4]["kept"]) == (5000, 5000, False)
    assert got[3]["n_words"] == 0 and not got[3]["kept"] and got[6]["n_symbols"] == 4


def test_mixing(spark):
    from textloom.llm.mixing import mix, mixed_documents

    rng = random.Random(1)
    rows = [(i if i % 10 else None, "w " * rng.randint(0, 60), rng.choice("abc") if i % 7 else None, "x") for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA)
    first, again = (sorted(map(str, mix(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 920
    got = mix(docs).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["copies"] <= 3 for r in own)
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_of_odd_rows(spark, odd, labels):
    from textloom.llm.quality import quality
    from textloom.llm.suffix_tree import score_documents
    from textloom.llm.toxicity import toxicity

    for rows in (quality(odd, labels).collect(), toxicity(odd, labels).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    rows = score_documents(odd).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0 for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[4] == 5001
    empty = spark.createDataFrame([], SCHEMA)
    for rows in (quality(empty, labels), toxicity(empty, labels), score_documents(empty)):
        assert rows.collect() == []


def test_segments_like_brute_force():
    from textloom.llm.toxicity import segments

    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(1, 14))]

        def best(lo, hi):
            found = [(sum(s[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            top = max(found, default=(0,))
            if top[0] <= 0:
                return []
            _, _, i, j = top
            return [*best(lo, i), (i, j, top[0]), *best(j, hi)]

        assert sum(x[2] for x in segments(np.array(s))) == sum(x[2] for x in best(0, len(s)))


def test_phrases(odd):
    from textloom.llm.phrases import parse, phrase_fingerprints

    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice("abé") for _ in range(rng.randint(0, 80)))
        known, ends, at, plain = set(), [], 0, set()
        parse(text, known, 0, ends)
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in plain:
                end += 1
            plain.add(text[at : min(end, len(text))])
            at = end
        assert known == plain
    rows = phrase_fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 6}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_preference(spark):
    from textloom.llm.preference import preference_pairs, preference_turns, swapped_answers

    schema = "pair_id long, side string, turn long, role string, text string, prompt string"
    sides = [(0, "chosen", 0, "user", "q"), (0, "chosen", 1, "assistant", "good"), (0, "rejected", 0, "user", "q"), (0, "rejected", 1, "assistant", "bad"), (0, "rejected", 1, "assistant", "bad"), (1, "chosen", 0, None, None)]
    rows = preference_turns(spark.createDataFrame([(*s, "x") for s in sides], schema)).collect()
    assert sorted((r["pair_id"], r["part"], r["turn"], r["trained"]) for r in rows) == [(0, "chosen", 1, True), (0, "prompt", 0, False), (0, "rejected", 1, True), (1, "chosen", 0, False)]
    line = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t} é") for c in (4, 5) for t in range(200)] + [(4, 200, "user", "bye"), (6, 0, "user", None), (None, 0, "user", "x"), (8, None, "user", "x"), (9, 0, "assistant", "lone")]
    found = {r["pair_id"]: r for r in preference_pairs(swapped_answers(spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, side string"))).collect()}
    assert set(found) == {4, 5, 6, 9}
    four, own = found[4], [t for t in turns if t[0] == 4]
    assert four["prompt"] == "".join(line(r, x) for _, t, r, x in own if t < 199) and four["prompt_turns"] == 199
    assert four["chosen"] == line("assistant", "c4 t199 é") + line("user", "bye") and four["rejected"] == line("assistant", "c5 t199 é") + line("user", "bye")
    assert [four["rejected"][a:b] for a, b in four["rejected_mask"]] == ["c5 t199 é<|end|>\n"]
    assert (found[6]["chosen"], found[6]["prompt"], found[6]["chosen_mask"]) == ("", line("user", ""), []) and found[9]["prompt"] == line("assistant", "lone")
    assert preference_pairs(swapped_answers(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_base_score(spark):
    from textloom.llm.suffix_tree import score_documents

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["A", "b", "c", "d e f g h"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    words = {d: brute.words(brute.lower(t)) + [None] for d, t in rows}
    counts = collections.Counter(w for d, ws in words.items() if brute.fold(d, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6
