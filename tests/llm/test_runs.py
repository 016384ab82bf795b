import hashlib
import random
import re
import zlib

import numpy as np
import pytest


def plain_runs(words, least=12):
    """Every maximal stretch of period q for each q, kept where q is its smallest period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, loop=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if loop and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def odd_texts():
    rng = random.Random(5)
    yield from (None, "", " \n\t", "one", "w " * 11, "w " * 12, "W w " * 6, "a b " * 40, "a b c d e f " * 2, "a b c d e f " * 2 + "a", fibonacci(300))
    yield "x" + " y" * 30 + " z" + " y" * 30 + " z"
    yield " ".join(["a"] * 10 + ["b"]) + " " + " ".join((["a"] * 10 + ["b"]) * 5)
    for size, alphabet in [(60, 2), (200, 2), (200, 3), (300, 1)] * 8:
        yield rng.choice([" ", "\n", " \x0b "]).join(rng.choice("abcdé漢"[:alphabet]) for _ in range(size))
    for _ in range(30):  # long periods, broken and whole, with neighbours that repeat them
        root = [rng.choice("abcdefghij") for _ in range(rng.randint(9, 40))]
        words = root * rng.randint(2, 5) + root[: rng.randint(0, 8)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "q"
        yield " ".join([*"xyz", *words, *(words if rng.random() < 0.3 else "uvw")])


@pytest.mark.parametrize("wide", [1, 3, 8])
def test_refinement_finds_all_runs(monkeypatch, wide):
    from textloom.llm import runs

    monkeypatch.setattr(runs, "WIDE", wide)
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in odd_texts()]
    names = {w: i for i, w in enumerate({w for t in texts for w in t})}
    keys = np.array([names[w] for t in texts for w in t], np.uint64)
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    got = [[] for _ in texts]
    for text, *run in zip(*(x.tolist() for x in runs._runs(keys, bounds, 2))):
        got[text].append(tuple(run))
    for t, found in zip(texts, got):
        assert found == plain_runs(t, 2)


def test_run_digests(spark):
    from textloom.llm.runs import looped, repeated_runs, run_digests

    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(i, " ".join(f"w{k * k % 97 % (5 + i % 40)}" for k in range(i % 150))) for i in range(1000, 1200)]
    rows += [(None, "a b " * 20), (None, None), (7, "a b " * 20), (7, "a b " * 20), (-4, "c d " * 9)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and t) > 15
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, runs string, h int")
    got = [tuple(r)[:8] for r in run_digests(repeated_runs(looped(docs))).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)
    assert run_digests(repeated_runs(docs.limit(0))).collect() == []


def test_collapsed_texts(spark):
    from textloom.llm.runs import repeated_runs

    docs = spark.createDataFrame([(1, "say  it\n" + "again and " * 10 + "stop"), (2, None), (3, "é " * 4)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeated_runs(docs).collect()}
    assert got[1]["collapsed"] == "say it again and stop" and [tuple(r) for r in got[1]["runs"]] == [(2, 20, 2)]
    assert got[2]["collapsed"] == "" and got[2]["runs"] == [] and got[2]["n_words"] == 0
    assert got[3]["collapsed"] == "é é é é"


def test_a_long_run_takes_time_by_its_length(spark):
    """A text of 60,000 words that goes round after 9,000: places leave their classes one by one."""
    from textloom.llm.runs import _runs

    rng = np.random.default_rng(1)
    root = rng.integers(0, 500, 9000).astype(np.uint64)
    keys = np.tile(root, 7)[:60_000]
    text, start, length, period = _runs(keys, np.array([0, len(keys)]), 12)
    assert (0, 60_000, 9000) in set(zip(start.tolist(), length.tolist(), period.tolist()))
