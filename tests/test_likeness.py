"""Likeness of texts against a comparison written plainly: strings, dictionaries and loops, one pair at a time."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from textloom.functions import folding
from textloom.operators import similar

WIDTH, LEAST, SLACK, CROWD = 32, 40, 600, 24


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def folded(text):
    kept = [(i, c) for i, c in enumerate(text) if c.isalpha() or c.isdecimal()]
    return "".join(c.lower() if len(c.lower()) == 1 else c for _, c in kept), [i for i, _ in kept]


def length_of_union(spans):
    return len({x for lo, hi in spans for x in range(lo, hi)})


def plain_runs(a, b, a_mask, b_mask):
    """(a from, a to, b from, b to) where the bodies agree, anchored on windows that are not crowded in b, less what masks cover."""
    places = collections.defaultdict(list)
    for j in range(len(b) - WIDTH + 1):
        places[b[j : j + WIDTH]].append(j)
    diagonals = collections.defaultdict(list)
    for i in range(len(a) - WIDTH + 1):
        found = places.get(a[i : i + WIDTH], [])
        for j in found if len(found) <= CROWD else []:
            diagonals[j - i].append(i)
    runs = []
    for d, at in diagonals.items():
        lo = at[0]
        for x, following in zip(at, [*at[1:], None]):
            if following is None or following - x > WIDTH:
                runs.append((lo, x + WIDTH, d))
                lo = following
    out = []
    for lo, hi, d in runs:
        if hi - lo < LEAST:
            continue
        if not a_mask and not b_mask:
            out.append((lo, hi, lo + d, hi + d))
            continue
        bare = [x for x in range(lo, hi) if not any(s <= x < e for s, e in a_mask) and not any(s <= x + d < e for s, e in b_mask)]
        pieces = []
        for x in bare:
            if pieces and pieces[-1][1] == x:
                pieces[-1][1] = x + 1
            else:
                pieces.append([x, x + 1])
        out += [(s, e, s + d, e + d) for s, e in pieces if e - s >= LEAST]
    return out


def plain_blocks(runs):
    """Chains of runs, in the order of side a: each goes to the open chain whose ends are nearest before it on both sides, if any is near."""
    blocks = []
    for run in runs:
        best = None
        for k, block in enumerate(blocks):
            step_a, step_b = run[0] - block["a_to"], run[2] - block["b_to"]
            if -WIDTH <= step_a <= SLACK and -WIDTH <= step_b <= SLACK and (best is None or abs(step_a) + abs(step_b) < best[0]):
                best = (abs(step_a) + abs(step_b), k)
        if best is None:
            blocks.append({"a_from": run[0], "a_to": run[1], "b_from": run[2], "b_to": run[3], "spans": [run], "gaps": []})
            continue
        block = blocks[best[1]]
        if run[0] > block["a_to"] and run[2] > block["b_to"]:
            block["gaps"].append((block["a_to"], run[0], block["b_to"], run[2]))
        block["spans"].append(run)
        block["a_to"], block["b_to"] = max(block["a_to"], run[1]), max(block["b_to"], run[3])
    return blocks


def numbers(text):
    return {t for t in re.findall(r"\d+(?:\.\d+)?", re.sub(r"(?<=\d),(?=\d)", "", text)) if len(t) > 1}


def raw(text, at, lo, hi):
    return text[at[lo] : at[hi] if hi < len(at) else len(text)] if lo < min(hi, len(at)) else ""


def plain_compare(a_text, b_text, a_mask=(), b_mask=()):
    (a, a_at), (b, b_at) = folded(a_text), folded(b_text)
    runs = sorted(plain_runs(a, b, a_mask, b_mask))
    if a_mask or b_mask:  # pieces keep the order of the runs that they were cut from
        whole = sorted(plain_runs(a, b, (), ()), key=lambda r: (r[0], r[2]))
        runs = sorted(runs, key=lambda p: (next(k for k, r in enumerate(whole) if r[2] - r[0] == p[2] - p[0] and r[0] <= p[0] and p[1] <= r[1]), p[0]))
    else:
        runs.sort(key=lambda r: (r[0], r[2]))
    blocks = plain_blocks(runs)
    matched = length_of_union([r[:2] for r in runs])
    a_cover, b_cover = (len({x for r in runs for x in range(r[s], r[s + 1])}) / n if n else 0.0 for s, n in ((0, len(a)), (2, len(b))))
    kind = "overlap"
    if matched >= 250 and max(a_cover, b_cover) >= 0.55:
        kind = "duplicate" if min(a_cover, b_cover) >= 0.55 else "contained" if a_cover >= 0.55 else "contains"
    grams = [{t[i : i + WIDTH] for i in range(len(t) - WIDTH + 1)} for t in (a, b)]
    in_a = set().union(*(numbers(raw(a_text, a_at, k["a_from"], k["a_to"])) for k in blocks))
    in_b = set().union(*(numbers(raw(b_text, b_at, k["b_from"], k["b_to"])) for k in blocks))
    shown = []
    for k in blocks:
        kept = 0
        for lo, hi, b_lo, b_hi in k["gaps"]:
            x, y = (t if len(t := " ".join(s.split())) <= 240 else t[:240] + "…" for s in (raw(a_text, a_at, lo, hi), raw(b_text, b_at, b_lo, b_hi)))
            kept += numbers(x) != numbers(y) or max(len(x), len(y)) >= 12
        shown.append((k["a_from"], k["a_to"], k["b_from"], k["b_to"], len(k["spans"]), length_of_union([r[:2] for r in k["spans"]]), min(kept, 8)))
    return {
        "relation": kind, "jaccard": len(grams[0] & grams[1]) / (len(grams[0] | grams[1]) or 1), "a_cover": a_cover, "b_cover": b_cover, "matched_chars": matched,
        "only_in_a": sorted(in_a - in_b), "only_in_b": sorted(in_b - in_a), "blocks": sorted(shown),
    }


def plain_pairs(probes, docs, mutual, least_chars, cutoff=12):
    """All pairs of texts that share three usual sampled shingles, by ``plain_compare``, with generic shingles masked."""
    def first(rows):
        seen = {}
        for k, t in sorted(rows.items()):
            seen.setdefault(folded(t)[0] or ("alone", k), k)
        return {k: rows[k] for k in seen.values()}

    docs = first(docs)
    probes = docs if mutual else first(probes)
    hashes = {side: {k: folding.shingles(folding.fold(t).body).tolist() for k, t in rows.items()} for side, rows in (("p", probes), ("d", docs))}
    kept = {side: {k: {h for h in hs if h % 32 == 0} for k, hs in rows.items()} for side, rows in hashes.items()}
    df = collections.Counter(h for s in kept["d"].values() for h in s)
    generic = {h for h, n in df.items() if n >= cutoff}

    def mask(side, k):
        size = len(folded((probes if side == "p" else docs)[k])[0])
        return [(max(i - 32, 0), min(i + 64, size)) for i, h in enumerate(hashes[side][k]) if h in generic]

    out = {}
    for a in probes:
        for b in docs:
            if (not mutual or a != b) and len((kept["p"][a] & kept["d"][b]) - generic) >= 3:
                found = plain_compare(probes[a], docs[b], mask("p", a), mask("d", b))
                if found["matched_chars"] >= least_chars:
                    out[a, b] = found
    return out


def corpus():
    rng = random.Random(11)
    base = [words(k, 130) for k in range(4)]
    footer = " this message is confidential and intended only for the person to whom it is addressed please notify the sender at once"
    docs = {}
    for i in range(26):
        text = base[i % 4]
        if i >= 4:
            text = " ".join(w if rng.random() > 0.04 else f"{rng.randint(1, 3000)}.{i}" for w in text.split())
        if i % 3 == 0:
            text = words(50 + i, rng.randint(5, 150)) + "\n" + text
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + words(70 + i, 90) + " " + text[len(text) // 2 :]
        docs[i] = text + (footer if i % 2 else "")
    docs |= {40: base[1].upper(), 41: base[1], 42: "", 43: "...", 44: "ab" * 400, 45: "ab" * 500 + base[2], 46: base[3] + " " + base[3] + " ab" * 100}
    return docs


def test_compare_is_the_plain_one():
    docs = corpus()
    some = [0, 1, 4, 5, 9, 10, 13, 40, 42, 44, 45, 46]
    for a in some:
        for b in some:
            masks = [[], []] if (a + b) % 3 else [[(40, 130), (300, 330)], [(10, 90)]]
            sides = [folding.Prepared(folding.fold(docs[k]), m) for k, m in zip((a, b), masks)]
            there, back = folding.compared(*sides, mirrored=True)
            for found, x, y, mx, my in ((there, a, b, *masks), (back, b, a, *masks[::-1])):
                wanted = plain_compare(docs[x], docs[y], mx, my)
                shown = sorted((k["a_from"], k["a_to"], k["b_from"], k["b_to"], k["runs"], k["matched_chars"], len(k["gaps"])) for k in found["blocks"])
                assert shown == wanted.pop("blocks") and {k: found[k] for k in wanted} == wanted, (x, y)


def test_each_pair_is_compared_once(spark, monkeypatch):
    """Parts of a leader with many members; either side's rows are those of a comparison of its own."""
    monkeypatch.setattr(similar, "MEMBERS", 3)
    docs = {i: words(1, 60) + words(100 + i, 5) for i in range(12)} | {20: None}
    pairs = [(0, i) for i in range(1, 12)] + [(3, 4), (4, 5), (3, 20)]
    p = spark.createDataFrame(pairs, "a long, b long")
    rows = spark.createDataFrame([(k, t, None) for k, t in docs.items()], "key long, text string, mask array<struct<lo:int,hi:int>>")
    listed = similar.led(p, True).collect()
    assert len(listed) == len(pairs) and {r["leader"] for r in listed if 0 in (r["leader"], r["member"])} == {0}
    assert len({r["part"] for r in listed if r["leader"] == 0}) > 1
    got = {(r["a"], r["b"]): (r["matched_chars"], r["jaccard"], len(r["blocks"])) for r in similar.compared(p, rows, rows, True).collect()}
    assert got.keys() == {x for a, b in pairs for x in ((a, b), (b, a))}
    for (a, b), found in got.items():
        one = folding.compare(folding.fold(docs[a] or ""), folding.fold(docs[b] or ""))
        assert found == (one["matched_chars"], one["jaccard"], len(one["blocks"]))
    assert len(similar.compared(p, rows, rows, False).collect()) == len(pairs)
    assert similar.compared(p.limit(0), rows, rows, True).collect() == []


def test_likeness_queries_are_the_plain_ones(spark, tmp_path):
    from textloom import index_queries as queries

    docs = corpus()
    passages = {i: docs[i][20:400] for i in (0, 1, 6, 9)} | {90: words(500, 60), 91: "", 92: docs[10][-120:]}
    table = lambda name, rows, key: pq.write_table(pa.table({key: pa.array(list(rows), pa.int64()), "text": pa.array(list(rows.values()))}), f"{tmp_path}/{name}.parquet")
    table("documents", docs, "doc_id"), table("benchmark", passages, "item_id")
    full = pq.read_table(f"{tmp_path}/documents.parquet")
    for name in ("source", "lang"):
        full = full.append_column(name, pa.array(["x"] * len(docs)))
    pq.write_table(full.append_column("n_chars", pa.array([len(t) for t in docs.values()])), f"{tmp_path}/documents.parquet")
    wanted = plain_pairs(docs, docs, True, 250)
    assert len(wanted) > 60 and any(w["only_in_a"] for w in wanted.values())
    near = lambda x: round(x, 6)
    got = {(r["a"], r["b"]): r.asDict() for r in queries.similar_pairs(spark, str(tmp_path)).collect()}
    assert got.keys() == wanted.keys()
    for k, r in got.items():
        for name in (r.keys() & wanted[k].keys()) - {"blocks"}:
            one = wanted[k][name]
            assert (near(r[name]) if isinstance(one, float) else r[name]) == (near(one) if isinstance(one, float) else " ".join(one) if isinstance(one, list) else one), (k, name)
    blocks = collections.defaultdict(list)
    for r in queries.masked_blocks(spark, str(tmp_path)).collect():
        blocks[r["a"], r["b"]].append(tuple(r)[2:])
    assert {k: sorted(v) for k, v in blocks.items()} == {k: w["blocks"] for k, w in wanted.items() if w["blocks"]}
    told = {(r["a"], r["b"]): r["kind"] for r in queries.ruling_proposals(spark, str(tmp_path)).collect()}
    for k, w in wanted.items():
        close = w["relation"] != "overlap"
        both = bool(w["only_in_a"]) and bool(w["only_in_b"])
        assert told[k] == ("" if not close else "version" if both else "copy"), k
    found = {(r["item_id"], r["doc_id"]): (r["relation"], r["matched_chars"], near(r["a_cover"]), near(r["b_cover"])) for r in queries.similar_passages(spark, str(tmp_path)).collect()}
    assert found == {k: (w["relation"], w["matched_chars"], near(w["a_cover"]), near(w["b_cover"])) for k, w in plain_pairs(passages, docs, False, 40).items()} != {}
    assert np.mean([r["a_cover"] for r in got.values()]) > 0.3


def test_proposals_of_pairs_that_share_what_is_generic(spark, tmp_path, monkeypatch):
    """Pairs with fewer than three usual sampled shingles in common, but with generic ones three: all of them that have enough beside their masks."""
    from textloom import index_queries as queries

    monkeypatch.setattr(similar, "MEMBERS", 3)  # passages of many texts are dealt to parts
    kept = lambda t: {h for h in folding.shingles(folding.fold(t).body).tolist() if h % 32 == 0}
    passages = [t for t in (words(k, 60)[:330] for k in range(2000, 4000)) if len(kept(t)) < 3][:3]
    assert len(passages) == 3
    footer, form = words(9, 90), words(10, 1800)
    docs = {i: f"{words(300 + i, 40)} {passages[i % 5] if i % 5 < 3 else words(400 + i, 60)} {words(500 + i, 40)} {footer}" for i in range(14)}
    docs |= {20 + i: f"{words(600 + i, 20)} {form} {i}{i}" for i in range(13)}  # all that they share is generic, what is not sampled is not masked
    docs |= {40: docs[0].upper(), 41: "", 42: None, 43: footer}
    rows = [(k, t, "x", "x", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {k: t for k, t in docs.items() if t and k != 40}
    sketch = {k: kept(t) for k, t in texts.items()}
    df = collections.Counter(h for s in sketch.values() for h in s)
    generic = {h for h, n in df.items() if n >= 12}

    def mask(t):
        body, out = folding.fold(t).body, []
        for i, h in enumerate(folding.shingles(body).tolist()):
            if h in generic:
                lo, hi = max(i - 32, 0), min(i + 64, len(body))
                out = [*out[:-1], (out[-1][0], hi)] if out and lo <= out[-1][1] else [*out, (lo, hi)]
        return out

    masks, wanted, before = {k: mask(t) for k, t in texts.items()}, {}, set()
    for a in texts:
        for b in texts:
            if a != b and len(sketch[a] & sketch[b]) >= 3:
                found = plain_compare(texts[a], texts[b], masks[a], masks[b])
                if found["matched_chars"] >= 250:
                    wanted[a, b] = found["relation"]
                    before |= {(a, b)} if len((sketch[a] & sketch[b]) - generic) >= 3 else set()
    told = {(r["a"], r["b"]): r["kind"] for r in queries.ruling_proposals(spark, str(tmp_path)).collect()}
    assert told.keys() == wanted.keys() and all((told[k] == "") == (w == "overlap") for k, w in wanted.items())
    crowd = wanted.keys() - before
    assert any(a < 20 for a, _ in crowd) and any(20 <= a < 40 for a, _ in crowd)


def test_texts_without_a_pair_do_not_travel(spark):
    """Of texts that share nothing, similar_pairs shuffles less than their length: neither the texts nor all of their shingles over and over."""
    from textloom.plans.tasks import written

    sc = spark.sparkContext
    no = sc._jvm.java.util.ArrayList()

    def shuffled():
        found = sc._jsc.sc().statusStore().stageList(no, False, False, sc._gateway.new_array(sc._jvm.double, 0), no)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    texts = {i: words(i, 3000) for i in range(160)}
    texts[160] = texts[0][:9000] + words(900, 600)
    rows = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8))
    before = shuffled()
    found = similar.similar_pairs(rows, rows, "doc_id", "text", write=written).select("a", "b").collect()
    assert {tuple(r) for r in found} == {(0, 160), (160, 0)}
    assert shuffled() - before < sum(map(len, texts.values()))


def test_texts_are_not_written_again(spark, tmp_path):
    """similar_passages writes of texts that meet no passage their sketch alone: less than half of their length."""
    from textloom import index_queries as queries

    sc = spark.sparkContext
    no = sc._jvm.java.util.ArrayList()

    def put():
        found = sc._jsc.sc().statusStore().stageList(no, False, False, sc._gateway.new_array(sc._jvm.double, 0), no)
        return sum(found.apply(i).outputBytes() + found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    texts = {i: words(i, 3000) for i in range(160)} | {160: words(0, 3000).upper(), 161: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([7], pa.int64()), "text": [texts[3][500:1500]]}), f"{tmp_path}/benchmark.parquet")
    before = put()
    found = queries.similar_passages(spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["doc_id"], r["relation"]) for r in found] == [(7, 3, "contained")]
    assert put() - before < 0.5 * sum(len(t or "") for t in texts.values())


def test_sampled_shingles_are_those_of_each_text(spark, monkeypatch):
    """Texts hashed as one: no window over an end, whatever the blocks; Latin-1 or not, the folded texts are those of ``fold``."""
    texts = ["", "...", "a" * 31, "b" * 32, words(1, 300), "Straße ÀÉÎ ²³ ªº µ ÿ Ÿ " * 9, "ΟΔΟΣ İ ٣ 漢字 \ud800" * 20, words(2, 40) + " é", "", words(3, 900), ""]
    bodies = [folding.body(t) for t in texts]
    assert all(b.tolist() == folding.fold(t).body.tolist() for b, t in zip(bodies, texts))
    whole = [folding.shingles(b) for b in bodies]
    for block in (1, 7, 1 << 15):
        monkeypatch.setattr(folding, "BLOCK", block)
        assert all(folding.shingles(b).tolist() == h.tolist() for b, h in zip(bodies, whole))
        for modulus in (1, 3, 32):
            at, value, bounds = folding.sampled(bodies, modulus=modulus)
            for k, h in enumerate(whole):
                hit = np.flatnonzero(h % np.uint64(modulus) == 0)
                part = slice(bounds[k], bounds[k + 1])
                assert at[part].tolist() == hit.tolist() and value[part].tolist() == h[hit].view(np.int64).tolist()
    monkeypatch.setattr(similar, "MOST_CHARS", 50)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if "\ud800" not in t] + [(50, None)], "id long, text string")
    prints = {r["id"]: r["h"] for r in similar.prints(rows, "id", "text").collect()}
    for r in similar.sampled(rows, "id", "text").collect():
        h = whole[r["id"]] if r["id"] < 50 else whole[0]
        hit = np.flatnonzero(h % np.uint64(32) == 0)
        assert (r["h"].hex() if r["h"] else None) == prints[r["id"]] and r["chars"] == len(folding.body(texts[r["id"]] if r["id"] < 50 else ""))
        assert r["at"] == hit.tolist() and r["hash"] == h[hit].view(np.int64).tolist()


def test_prints_are_those_of_sql(spark):
    rows = spark.createDataFrame([(1, "ΟΔΟΣ a"), (2, "οδος A!"), (3, "οδοσ A"), (4, "İ x"), (5, "i x"), (6, "-- "), (7, None), (8, "É1²"), (9, "é1"), (10, "")], "id long, text string")
    sql = {r["id"]: r["h"] for r in rows.selectExpr("id", r"case when length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '')) > 0 then sha2(lower(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '')), 256) end as h").collect()}
    assert {r["id"]: r["h"] for r in similar.prints(rows, "id", "text").collect()} == sql
    assert len({h for h in sql.values() if h}) < 7
