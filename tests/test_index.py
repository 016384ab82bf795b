"""The document index: folds, pages, likeness, queue, records, sources and providers, against plain versions and known facts."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import folding, images, segments
from textloom.functions import regions as R
from textloom.functions import text as T
from textloom.operators import attest, pages, queue, records, search, similar
from textloom.operators import segments as spark_segments
from textloom.sources import files, mail, transcripts
from textloom.sources.textindex import TextIndex

DEED = "Beginning at the northeast corner of lot 7, thence south 25.00 feet along the east line, recorded under auditor file 200806030039 in volume 12 of plats at page 44, county of king. "


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


# ---------------------------------------------------------------- attestations

KINDS = ["confirmed", "corrected", "unclear", "unsupported", "retract", "affirmed"]
LOG = "path string, seq long, unit string, kind string, blanket boolean, text string, label string, by string, statement string"


def random_log(rng, path, n):
    out = []
    for i in range(n):
        blanket = rng.random() < 0.2
        kind = rng.choice(["affirmed", "retract"]) if blanket else rng.choice(KINDS)
        out.append((path, i, "" if blanket else f"u{rng.randint(0, 6)}", kind, blanket, f"t{i}" if kind == "corrected" else "", "", f"p{rng.randint(0, 2)}", f"s{i}"))
    return out


def test_states_like_the_plain_fold(spark):
    rng = random.Random(1)
    paths = [f"d{k}" for k in range(60)]
    units = [(p, f"u{k}", k, f"own {k}", "") for p in paths for k in range(5)]
    log = [e for p in paths for e in random_log(rng, p, rng.randint(0, 25))]
    u, l = spark.createDataFrame(units, "path string, unit string, ord int, text string, label string"), spark.createDataFrame(log, LOG)
    got = {(r["path"], r["unit"]): (r["kind"], r["swept"], r["by"], r["text"]) for r in attest.states(u, l).collect()}
    names = LOG.replace(",", "").split()[::2]
    lost = 0
    for p in paths:
        order, orphans = attest.resolve([{"unit": x[1], "text": x[3], "label": ""} for x in units if x[0] == p], [dict(zip(names, e)) for e in log if e[0] == p])
        lost += len(orphans)
        for s in order:
            assert got[p, s["unit"]] == (s["kind"], s["swept"], s["by"], s["text"])
    assert attest.orphans(u, l).count() == lost > 0


def test_resegment_splices_in_place(spark):
    schema = LOG + ", retires array<string>, adds array<struct<unit:string,text:string,label:string>>"
    log = [("d", 1, "b", "confirmed", False, "", "", "p", "", None, None), ("d", 2, "", "resegment", False, "", "", "p", "", ["b"], [("b1", "x", ""), ("b2", "y", "")]), ("d", 3, "b1", "unclear", False, "", "", "p", "", None, None)]
    units = spark.createDataFrame([("d", u, i, u, "") for i, u in enumerate("abc")], "path string, unit string, ord int, text string, label string")
    got = attest.resegmented(units, spark.createDataFrame(log, schema)).orderBy("ord").collect()
    assert [(r["unit"], r["kind"]) for r in got] == [("a", ""), ("b1", "unclear"), ("b2", ""), ("c", "")]


def test_unit_ids():
    span = {"parent": "d", "span": {"from": 3, "to": 9}, "label": "x", "text": "é\n"}
    assert attest.unit_id(span).startswith("b3-") and attest.unit_id(span) != attest.unit_id({**span, "text": "é"})
    assert attest.unit_id({"area": {"page": 3, "x": 0.1, "y": 0.25, "w": 0.5, "h": 1.0, "rotation": 0, "dpi": 200}}).startswith("p3-")
    assert attest.unit_id({"time": {"start": 142.5, "end": 143.0}}).startswith("t142.50-")
    a, b = attest.sealed([{"id": "x", "text": "one"}, {"id": "y", "parent": "x", "text": "two"}])
    assert b["parent"] == a["id"]
    with pytest.raises(ValueError):
        attest.sealed([{"id": "y", "parent": "x", "text": "two"}])
    with pytest.raises(ValueError):
        attest.sealed([{"text": "one"}, {"text": "one"}])


# ---------------------------------------------------------------- likeness


def test_altered_copy_tells_its_numbers():
    text = words(1, 60) + " " + DEED + words(2, 60)
    other = text.replace("25.00", "30.00")
    found = folding.compare(folding.fold(text), folding.fold(other))
    assert found["relation"] == "duplicate" and found["only_in_a"] == ["25.00"] and found["only_in_b"] == ["30.00"]
    assert found["blocks"][0]["gaps"][0]["a_text"].startswith("25") and found["a_cover"] < 1
    same = folding.compare(folding.fold(text), folding.fold(text.upper()))
    assert same["jaccard"] == same["a_cover"] == 1 and len(same["blocks"]) == 1


def test_deed_inside_a_filing():
    deed, parts = DEED * 3, [words(3, 400), words(4, 400), words(5, 400)]
    whole = parts[0] + "\n" + parts[1] + "\n" + deed + "\n" + parts[2]
    starts = [0, len(parts[0]) + 1, len(parts[0]) + len(parts[1]) + 2, len(parts[0]) + len(parts[1]) + len(deed) + 3]
    found = folding.compare(folding.fold(deed), folding.fold(whole, list(zip(starts, (1, 2, 3, 4)))))
    assert found["relation"] == "contained" and found["jaccard"] <= 0.25
    assert all((b["b_from_page"], b["b_to_page"]) == (3, 3) for b in found["blocks"])


def test_masks_and_crowded_shingles():
    footer = "this message is confidential and intended only for the person to whom it is addressed please notify the sender " * 3
    a, b = folding.fold(words(6, 80) + footer), folding.fold(words(7, 80) + footer)
    at = len(folding.fold(words(6, 80)).body)
    assert folding.compare(a, b)["matched_chars"] > 200
    assert folding.compare(a, b, [(at - 32, len(a.body))])["matched_chars"] == 0
    filler = folding.fold("ab" * 4000)
    assert len(folding.seeds(folding.shingles(filler.body), folding.shingles(filler.body))[0]) == 0
    runs = np.array([[0, 200, 10, 210]])
    assert folding.masked(runs, [(50, 60)], [(160, 400)]).tolist() == [[0, 50, 10, 60], [60, 150, 70, 160]]


def test_corruption_sweep():
    base = folding.fold(words(8, 600)).raw
    def corrupt(every):
        return "".join("0" if i % every == every - 1 else c for i, c in enumerate(base))

    relation = {k: folding.compare(folding.fold(base), folding.fold(corrupt(k)))["relation"] for k in (120, 60, 15)}
    assert relation == {120: "duplicate", 60: "duplicate", 15: "overlap"}


def test_similar_pairs_like_all_pairs(spark):
    rng = random.Random(9)
    base = [words(k, 150) for k in range(4)]
    docs = [(i, base[i % 4] if i < 8 else " ".join(w if rng.random() > 0.03 else "zzz" for w in base[i % 4].split()) if i < 20 else words(100 + i, rng.randint(1, 150))) for i in range(34)] + [(50, None), (51, ""), (52, "...")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {(r["a"], r["b"]): (r["relation"], r["matched_chars"]) for r in similar.similar_pairs(df, df, "id", "text").collect()}
    first = {}
    for i, t in docs:
        first.setdefault(folding.fold(t or "").body.tobytes() or i, i)
    ids = sorted(first.values())
    texts = dict(docs)
    folded = {i: folding.fold(texts[i] or "") for i in ids}
    kept = {i: set(h[h % np.uint64(32) == 0].tolist()) for i in ids for h in [folding.shingles(folded[i].body)]}
    df_of = collections.Counter(h for s in kept.values() for h in s)
    generic = {h for h, n in df_of.items() if n >= 12}
    wanted = {}
    for a in ids:
        for b in ids:
            if a != b and len((kept[a] & kept[b]) - generic) >= 3:
                found = folding.compare(folded[a], folded[b])
                if found["matched_chars"] >= 250:
                    wanted[a, b] = (found["relation"], found["matched_chars"])
    assert not generic and got == wanted and len(wanted) > 20
    groups = {r["id"]: (r["first"], r["members"]) for r in similar.classes(df, "id", "text").collect()}
    assert groups[4] == groups[0] == (0, 2) and groups[50] == (50, 1) and groups[52] == (52, 1)


def test_proposals(spark):
    rows = [("duplicate", ["2008"], ["2010"], 0.95), ("duplicate", ["25.00"], ["30.00"], 0.95), ("contained", ["7x"], [], 0.5), ("duplicate", [], [], 0.95), ("overlap", [], [], 0.1), ("identical", [], [], 1.0)]
    df = spark.createDataFrame(rows, "r string, a array<string>, b array<string>, j double")
    got = df.select(similar.proposal(F.col("r"), F.col("a"), F.col("b"), F.lit(0.9), F.lit(0.004), F.col("j"), F.lit(300)).alias("p")).select("p.*").collect()
    assert [(r["kind"], r["confident"]) for r in got] == [("version", False), ("version", False), ("copy", False), ("copy", True), ("", False), ("copy", True)]
    assert "2008 against 2010" in got[0]["why"] and "0.4%" in got[2]["why"]


# ---------------------------------------------------------------- pages

FRAGMENTS = "path string, frag_id string, page int, ord int, start_off int, end_off int, text string, page_spans array<struct<off:int,page:int>>, origin string"


def test_true_pages_of_stitched_fragments(spark):
    rows = [
        ("d", "f0", 1, 0, 0, 0, "one\n\ntwo", [(0, 1), (5, 2)], ""), ("d", "f1", 4, 0, 0, 0, "four", None, ""), ("d", "f2", 0, 0, 0, 0, "a caption", None, "identity"),
        ("e", "g0", 1, 0, 0, 6, "abcdef", None, ""), ("e", "g1", 2, 0, 4, 10, "efghij", None, ""), ("e", "g2", 2, 1, 5, 9, "fghi", None, ""),
    ]
    df = spark.createDataFrame(rows, FRAGMENTS)
    got = {(r["path"], r["page"]): r["text"] for r in pages.true_pages(df).collect()}
    assert got == {("d", 1): "one\n\n", ("d", 2): "two", ("d", 3): "", ("d", 4): "four", ("e", 1): "abcdef", ("e", 2): "ghij"}
    texts = {r["path"]: r["text"] for r in pages.document_text(df).collect()}
    assert texts == {"d": "one\n\ntwo\n\nfour", "e": "abcdefghij"}
    cut = {r["path"]: (r["text"], r["truncated"], [tuple(p) for p in r["pages"]]) for r in pages.document_text(df, max_chars=7).collect()}
    assert cut["e"] == ("abcdefg", True, [(1, "abcdef")]) and cut["d"][0] == "one\n\ntw"
    assert pages.true_pages(df.limit(0)).collect() == [] == pages.document_text(df.limit(0)).collect()


def test_hit_page(spark):
    df = spark.createDataFrame([("alpha beta", [(0, 3), (6, 4)]), ("alpha beta", None), ("gamma", [(0, 3), (2, 4)])], "text string, spans array<struct<off:int,page:int>>")
    page = lambda q: [r[0] for r in df.select(pages.hit_page(F.lit(3), F.col("spans"), F.col("text"), q)).collect()]
    assert page("BETA AND x") == [4, 3, 3] and page('"alpha" OR beta') == [3, 3, 3] and page("and or a") == [3, 3, 3]
    assert pages.query_terms('title:Foo* NOT (b-cd ^x)') == ["title", "foo", "cd"]


# ---------------------------------------------------------------- segments


def test_boundaries_and_budget():
    assert segments.boundary("a" * 80 + ". " + "b" * 40, 100) == 82 and segments.boundary("x" * 50, 20) == 20 and segments.boundary("abc", 9) == 3
    assert "".join(p["text"] for p in segments.split_to_budget(words(10, 900), segments.Budget(300))) == words(10, 900)
    budget = segments.Budget(400, reserve=8)
    pieces = segments.split_to_budget(words(11, 900), budget, [(0, 1), (700, 2), (3000, 3)], 10)
    assert all(budget.fits(p["text"]) or len(p["text"]) <= segments.LEAST_TAKE for p in pieces)
    assert pieces[0]["start_off"] == 10 and pieces[-1]["end_off"] == 10 + len(words(11, 900))
    at, seen = 0, []
    for p in pieces:
        seen += [(at + off, page) for off, page in p["spans"][1:]]
        at += len(p["text"])
    assert seen == [(700, 2), (3000, 3)]
    assert segments.split_to_budget("short", segments.Budget(0)) == [{"text": "short", "spans": []}]
    assert "fragment 2 is 300% of the maximum length: split it into at least 6" == segments.complaint({1: 3.0})
    tail = segments.open_context(words(12, 2000), segments.Budget(2000), "fixed")
    assert words(12, 2000).endswith(tail) and 0 < len(tail) < 2000


def test_assembler(spark):
    long = "x" * 3200
    got = segments.assembled([(1, ["a", " ", "b"], False), (2, [long, "next"], False), (3, ["goes on", "z" * 4000], True)])
    assert [(f["page"], f["ord"], f["text"][:6], f["spans"]) for f in got] == [(1, 0, "a\n\nb\n\n", [(0, 1), (6, 2)]), (2, 0, "next\n\n", [(0, 2), (6, 3)])]
    rows = [("d", 1, ["a", None, "b"], False), ("d", 2, [long, "next"], False), ("d", 3, ["goes on", "z" * 4000], True), ("e", 1, [], False)]
    df = spark.createDataFrame(rows, "path string, page int, segments array<string>, continues boolean")
    out = spark_segments.assemble(df).collect()
    assert sorted((r["path"], r["page"], len(r["text"])) for r in out) == sorted(("d", f["page"], len(f["text"])) for f in got)
    cut = spark_segments.fitted(spark.createDataFrame([("d", 1, 0, 5, 5 + 4000, "word " * 800, [(0, 1), (2000, 2)])], "path string, page int, ord int, start_off int, end_off int, text string, page_spans array<struct<off:int,page:int>>"), segments.Budget(600)).collect()
    assert "".join(r["text"] for r in sorted(cut, key=lambda r: r["piece"])) == "word " * 800


# ---------------------------------------------------------------- queue


def test_enqueue_like_one_after_the_other(spark):
    rng = random.Random(3)
    jobs = [(i + 1, f"u{rng.randint(0, 9)}", rng.choice(["pending", "running", "done", "error"]), rng.randint(0, 1)) for i in range(20)]
    requests = [(rng.choice([f"u{rng.randint(0, 14)}", "", "x.textloom-regions.json"]), "t", rng.randint(0, 1), i) for i in range(80)]
    live, wanted, last = [(u, f) for _, u, s, f in jobs if s in queue.LIVE], [], 20
    for url, _, fresh, at in requests:
        if url and not url.endswith(".json") and not any(u == url and f >= fresh for u, f in live):
            last += 1
            live.append((url, fresh))
            wanted.append((last, url, fresh, at))
    got = queue.enqueued(spark.createDataFrame(jobs, "id long, url string, state string, fresh int"), spark.createDataFrame(requests, "url string, title string, fresh int, at long"))
    assert sorted((r["id"], r["url"], r["fresh"], r["at"]) for r in got.collect()) == wanted


def test_pool_like_eviction(spark):
    rng = random.Random(4)
    rows = [(f"r{i % 3}", f"f{rng.randint(0, 9)}", i, rng.randint(1, 50), 0) for i in range(60)]
    size = {f"f{k}": 10 * k for k in range(10)}
    rows = [(r, f, t, b, size[f]) for r, f, t, b, _ in rows]
    kept = [r for r in rows if r[2] >= 60 - 50]
    total = lambda rs: sum(r[3] for r in rs) + sum(size[f] for f in {r[1] for r in rs})
    kept.sort(key=lambda r: r[2])
    while total(kept) > 700:
        kept.pop(0)
    kept = kept[-20:]
    pool = spark.createDataFrame(rows, "recipe_hash string, file_hash string, last_used_at long, bytes long, image_bytes long")
    got = queue.pool_retained(pool, 60, 50, 700, 20).collect()
    assert sorted(r["last_used_at"] for r in got) == [r[2] for r in kept]


def test_running_sums_and_last_rows(spark):
    from textloom.operators.prefix import last_rows, running

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "lane string, at long, v long")
    got = {r["at"]: r["s"] for r in running(df, ["lane"], "at", F.col("v"), "s").collect()}
    assert all(got[at] == sum(v for l, t, v in rows if l == lane and t <= at) for lane, at, _ in rows)
    last = last_rows(df, ["lane"], "at", 10).collect()
    assert sorted(r["at"] for r in last) == sorted(at for lane in ("a", "b", None) for at in sorted(t for l, t, _ in rows if l == lane)[-10:])
    assert running(df.limit(0), ["lane"], "at", F.lit(1), "n").collect() == []


# ---------------------------------------------------------------- records


def test_readings(spark):
    log = spark.createDataFrame([("d", 1, 1, "m1", "ocr-fast"), ("d", 1, 2, "m1", "ocr-fast"), ("d", 1, 3, "mine", "ann"), ("d", 1, 4, "m2", "ocr-fast"), ("d", 2, 5, "x", "ocr-fast")], "path string, page int, seq long, text string, by string")
    got = {r["seq"]: (r["version"], r["active"]) for r in records.versions(log).collect()}
    assert got == {1: (1, False), 3: (2, True), 4: (3, False), 5: (1, True)}
    assert sorted(r["seq"] for r in records.superseded(log).collect()) == [1, 4]
    captions = spark.createDataFrame([("d", "n", "machine"), ("e", "n", "machine")], "path string, name string, source string")
    assert [r["path"] for r in records.to_recaption(log, captions).collect()] == ["d"]


def test_slice_proposals(spark):
    rows = [("d", 1, "FORM 22A purchase\nPage 1 of 3"), ("d", 2, "page 2 of 3"), ("d", 3, "Form 35 inspection Page 1 of 5 Form 41C Page 1 of 1"), ("d", 4, "tail"), ("e", 1, "nothing")]
    got = records.slice_proposals(spark.createDataFrame(rows, "path string, page int, text string")).collect()
    assert sorted((r["low"], r["high"], r["form"], tuple(r["shared"])) for r in got) == [(1, 2, "22A", ()), (3, 3, "41C", ("35",)), (3, 4, "35", ("41C",))]


def test_captions_notes_and_withdrawals(spark):
    schema = "path string, name string, summary string, kind string, source string, model string"
    told = "A statutory warranty deed of lot 7, from one person to another, of 2008."
    held = spark.createDataFrame([("a", "mine", told, "deed", "person", ""), ("b", "old", told, "deed", "machine", "m")], schema)
    new = spark.createDataFrame([("a", "machine's", told, "deed", "machine", "m"), ("b", "  new   name ", told, "Plat", "machine", "m"), ("c", "", told, "deed", "machine", "m")], schema)
    got = {r["path"]: (r["name"], r["kind"]) for r in records.captioned(held, new).collect()}
    assert got == {"a": ("mine", "deed"), "b": ("new name", "survey")}
    notes = spark.createDataFrame([("a", 1, "see", "p")], "path string, page int, text string, by string")
    assert records.notes_added(notes, spark.createDataFrame([("a", None, " \n", "p"), ("b", None, "ok", "p")], notes.schema)).count() == 2
    docs = spark.createDataFrame([("a",), ("b",)], "path string")
    left, gone = records.withdrawn(docs, spark.createDataFrame([("a", "wrong"), ("b", " ")], "path string, reason string"))
    assert [r["path"] for r in left.collect()] == ["b"] and gone.count() == 1 and records.restored(gone, docs).count() == 0
    branches = records.forked(spark.createDataFrame([("main", None), ("b", "main")], "name string, parent string"), "c", "b")
    assert [r["name"] for r in records.deletable(branches).collect()] == ["c"]
    assert records.ancestors({"main": None, "b": "main", "c": "b"}, "c") == ["c", "b", "main"]
    assert records.resolved(docs.limit(1))[0] is not None and records.resolved(docs) == (None, ["a", "b"])


# ---------------------------------------------------------------- sources and texts


def test_html_and_kinds(spark):
    html = ["<p>a</p><p>b</p>", "x <a <b>c> y</a>\n\n <i>z", "1 > 0 &amp; <br>\n two", None]
    df = spark.createDataFrame([(h,) for h in html], "h string")
    assert [r[0] for r in df.select(T.html_text(F.col("h"))).collect()] == [*(mail.plain(h) for h in html[:3]), None]
    given = [("a/b.MD", None), ("x", "text/html"), ("x.json", None), ("y.heic", ""), ("z", "application/vnd.ms-excel"), ("q.doc", None), ("archive.mbox", None), ("n", None)]
    kinds = spark.createDataFrame(given, "p string, c string").select(T.document_kind(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in kinds] == ["text", "office", "unknown", "image", "spreadsheet", "office", "email", "unknown"]


def test_sampling_and_small_functions(spark):
    values = [0, 7, -1, 2**63 - 1, -(2**63), 123456789012345678]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for modulus in (0, 1, 7, 32, 1000):
        got = [r[0] for r in df.select(T.sampled(F.col("v"), modulus)).collect()]
        assert got == [modulus <= 1 or (v % 2**64) % modulus == 0 for v in values]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert one(T.engine_summary(F.array(F.lit("v"), F.lit("a"), F.lit("v")))) == "a×1, v×2"
    assert one(R.expected_share(F.lit("hello world"), F.lit("Hello there"))) == pytest.approx(2 / 7)
    assert one(R.clears(F.array(F.lit("budget"), F.lit("faded")), F.array())) and not one(R.clears(F.array(F.lit("budget")), F.array()))
    assert one(T.few(F.array(*map(F.lit, "dcba")))) == "a, b, c (+1 more)" and one(T.percent(F.lit(0.0005))) == "under 0.1%"
    assert one(T.child_parent(F.lit("x#p2-y"))) == "" and one(T.child_parent(F.lit("a#p1-2#p3-4"))) == "a#p1-2"
    assert [tuple(p) for p in one(T.paragraphs(F.lit("  one\nline \n\n\n two")))] == [(2, 10, "one\nline"), (15, 18, "two")]
    assert R.reading_order([(0.5, 0.10), (0.1, 0.11), (0.2, 0.5)]) == [1, 0, 2]


def test_regions(spark):
    rows = [("p", "1", None, 0, 0, "head"), ("p", "1.1", "1", 1, 1, "Lot 7 deed"), ("p", "1.2", "1", 1, 2, ""), ("p", "1.1.1", "1.1", 2, 3, "LOT-7")]
    df = spark.createDataFrame(rows, "page_id string, region string, parent string, depth int, seq int, text string")
    assert sorted(r["region"] for r in R.leaves(df).collect()) == ["1.1.1", "1.2"]
    assert [r["region"] for r in R.quoted(df, "lot 7").collect()] == ["1.1.1", "1.1"] and R.quoted(df, "!").count() == 0
    fresh = spark.createDataFrame([("p", "1.1", "1", 1, 1, "again", "1.1")], "page_id string, region string, parent string, depth int, seq int, text string, root string")
    assert {r["region"]: r["text"] for r in R.grafted(df, fresh).collect()} == {"1": "head", "1.1": "again", "1.2": ""}
    placed = spark.createDataFrame([("p", "a", "r", 0.5, 0.1), ("p", "b", "r", 0.1, 0.11)], "page_id string, region string, parent string, x double, y double")
    assert {r["region"]: r["place"] for r in R.ordered(placed).collect()} == {"a": 1, "b": 0}


def test_transcripts_and_words(spark, tmp_path):
    rows = [("d/x.pdf", 1, "short"), ("d/x.pdf", 2, ""), ("d/x.pdf", 4, "body " * 60)]
    made = transcripts.render(spark.createDataFrame(rows, "path string, page int, text string"))
    text = made.first()["transcript"]
    assert "⚠" in text and "_(no text on this page)_" in text
    assert [(r["page"], r["text"]) for r in transcripts.parse(made).orderBy("page").collect()] == [(1, "short"), (2, ""), (3, ""), (4, ("body " * 60).strip())]
    suspects = transcripts.suspect_pages(spark.createDataFrame([*rows, ("d", 9, "a\nb\n> **figure:** map")], "path string, page int, text string"))
    assert {(r["page"], r["why"]) for r in suspects.collect()} == {(1, "thin")}
    assert spark.range(1).select(transcripts.recognised(F.lit(""))["words"], transcripts.render_dpi(F.lit(10)), transcripts.render_dpi(F.lit(0)), transcripts.render_dpi(F.lit(2))).first()[:] == (0, 400, 200, 600)
    (tmp_path / "log.jsonl").write_text('# head\n\n{"kind": "a", "n": 1}\n')
    assert transcripts.audit_log(spark, str(tmp_path / "log.jsonl"), "kind string, n int").collect()[0]["n"] == 1
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        transcripts.audit_log(spark, str(tmp_path / "bad.jsonl"), "kind string, n int").collect()
    (tmp_path / "f.bin").write_bytes(b"12345")
    got = transcripts.fetched(spark, str(tmp_path / "f.bin"), 3).first()
    assert got["bytes"] == 5 and got["content"] is None and got["error"]


def test_mail_files_and_manifest(spark):
    part = "Content-Type: application/pdf\nContent-Disposition: attachment; filename=\"../a.pdf\"\nContent-Transfer-Encoding: base64\n\nSGVsbG8=\n"
    one = f"Subject: one\nFrom: ann\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhi\n--B\n{part}\n--B--\n"
    box = f"From x\n{one}\nFrom y\n{one.replace('one', 'two')}\n".encode()
    df = spark.createDataFrame([("box", bytearray(box)), ("none", None)], "path string, content binary")
    got = mail.read_attachments(df).collect()
    assert [(r["page"], r["name"], bytes(r["content"])) for r in got] == [(2, "a.pdf", b"Hello")]
    body = mail.manifest(mail.read_mail(df)).first()["body"]
    assert body.startswith("2 messages\npage 2: one, from ann, files: ") and mail.safe_name("..", "text/plain") == "attachment.plain"


def test_source_roots(spark):
    df = spark.createDataFrame([(p,) for p in ("/r/a.md", "/r/old/a.md", "/s/a.md", "/s/b.pdf", "/t/a.md", "/r/x.tmp")], "p string")
    plan = files.planned_roots(F.col("p"), {"/r": {"ignore": ["old/**"]}, "/s": {"include": ["*.pdf"]}}, ["*.md", "*.tmp"], ["*.tmp"])
    assert [r["p"] for r in df.where(plan).collect()] == ["/r/a.md", "/s/b.pdf"]


def test_images():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (60, 80)).astype(np.uint8)
    flat = np.full((60, 80), 128, np.uint8)
    assert images.faults(noise) == [] and images.faults(flat) == ["blurred", "faded"]
    assert images.contrast(images.equalised((noise // 8 + 100).astype(np.uint8))) > images.contrast((noise // 8 + 100).astype(np.uint8))
    assert images.sharpness(images.sharpened(noise // 2 + 60)) > images.sharpness(noise // 2 + 60)
    assert images.rotated(noise, 90).shape == (80, 60) and np.array_equal(images.rotated(images.rotated(noise, 90), 270), noise)
    assert images.cropped(noise, 0.25, 0.5, 0.5, 0.5).shape == (30, 40)
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (100).to_bytes(4) + (200).to_bytes(4)
    assert images.size(png) == (100, 200) and images.too_small(png) and not images.too_small(b"?")


# ---------------------------------------------------------------- search, engine, providers


def test_index_and_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running runs runner"), (2, "the state-of-the-art plan"), (3, "art of state"), (4, None)], "id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"), stemmed=True)
    index.update(docs, "id", "text")
    assert [r["key"] for r in search.top(index.search(["Run"]), "key", 5).collect()] == [1]
    assert [r["id"] for r in search.phrase_search(docs, "id", "text", "state-of").collect()] == [2]
    assert search.phrases("what's a-b OR") == [["what", "s"], ["a", "b"], ["or"]] and search.phrase_search(docs, "id", "text", " ").count() == 0
    assert search.scoped("", "own", ["shared"]) == "own__*,shared__*" and search.scoped("code,shared:*,other:x", "own", ["shared"]) == "own__code,shared__*"
    assert search.scoped("other:x", "own", []) == "__nothing__" and search.scoped("a,b*", "") == "a,b*"


def test_engine(spark):
    from textloom.engine import Engine

    spans = "array<struct<off:int,page:int>>"
    frags = spark.createDataFrame([("a", "a@0", 1, 0, 0, 0, "alpha beta", None, ""), ("b", "b@0", 2, 0, 0, 0, "beta beta", None, "")], FRAGMENTS)
    docs = spark.createDataFrame([("a", "First", "main", "alpha beta"), ("b", "Second", "side", "beta beta")], "path string, title string, index string, text string")
    prov = spark.createDataFrame([("a", 1, "vision")], "path string, page int, engine string")
    gone = spark.createDataFrame([], "path string, reason string")
    jobs = spark.createDataFrame([], "id long, url string, state string, fresh int")
    engine = Engine(spark, {"documents": docs, "fragments": frags, "provenance": prov, "withdrawals": gone, "jobs": jobs})
    assert [(r["path"], r["title"]) for r in engine.search("alpha").collect()] == [("a", "First")]
    assert [r["path"] for r in engine.search("beta", index="side").collect()] == ["b"] and engine.search("beta", path="b").count() == 1
    assert {r["path"]: r["vision_pages"] for r in engine.list_documents().collect()} == {"a": 1, "b": 0}
    assert engine.get_document("second").first()["text"] == "beta beta"
    with pytest.raises(ValueError):
        engine.get_document("zzz")
    with pytest.raises(ValueError):
        engine.search("x", mode="fuzzy")
    left = engine.withdraw(spark.createDataFrame([("a", "wrong")], "path string, reason string"))
    assert left.tables["documents"].count() == 1 and left.tables["withdrawals"].count() == 1
    asked = spark.createDataFrame([("a", "", 0, 1), ("c", "", 0, 2)], "url string, title string, fresh int, at long")
    assert [r["url"] for r in left.ingest(asked).collect()] == ["c"]
    assert spans and set(engine.document_detail("a")) == {"pages", "jobs", "copies"}


def test_providers(spark):
    from textloom import providers as P

    assert [len(b) for b in P.batches_of(["x" * 9000, "y" * 9000, "z"], 16_384)] == [1, 2]
    rows = P.embedded(spark.createDataFrame([(1, "auth auth"), (2, None)], "id long, text string"), "id", "text", P.FakeEmbedder()).collect()
    assert {r["id"]: r["vector"] for r in rows} == {1: [1.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0]}
    assert 4744 <= P.embed_limit(P.FakeEmbedder(limit=5000)) <= 5000 and P.embed_limit(P.FakeEmbedder()) == P.PROBE_HIGH
    assert P.limit_from_error("too large; batch size: 512") == (512 - 16) * 2 and P.limit_from_error("no") is None
    good, bad = b"the quick brown fox jumps over a lazy dog today", b"xkcd qwrt zxcv bnmp ghjk lpqr sdfg hjkl"
    gate = P.is_gibberish
    assert P.page_reading(good, P.FakeEngine(), P.FakeEngine("v"), gate)[1] == "cheap" and P.page_reading(bad, P.FakeEngine(), P.FakeEngine("v"), gate)[1] == "vision"
    assert P.page_reading(b"y" * 90, None, P.FakeEngine("v", most=60), gate, lambda i, f: i[: int(len(i) * f)])[2] == 2
    images_ = spark.createDataFrame([("d", 1, bytearray(good)), ("d", 2, bytearray(good)), ("d", 3, bytearray(b" "))], "path string, page int, image binary")
    read = P.read_pages(images_, P.FakeEngine(), None)
    assert read.count() == 3 and P.to_cache(read).count() == 1
    again = P.read_pages(images_, P.FakeEngine("other"), None, P.to_cache(read)).collect()
    assert {r["page"]: (r["engine"], r["cached"]) for r in again} == {1: ("cheap", True), 2: ("cheap", True), 3: ("other", False)}
    chat = P.FakeChatter(["nonsense", '{"fragments": []}', 'x {"continues_previous": true, "fragments": [{"text": "a"}, {"text": "b"}]}'])
    assert P.segmented(chat, "page") == (["a", "b"], True, "") and len(chat.asked) == 3
    loop = P.FakeChatter(["the same block of words again and again. " * 5])
    assert P.segmented(loop, "page", retries=1)[0] == ["page"] and loop.options[1]["temperature"] == P.LOOP_TEMPERATURE
    told = '{"name": "Deed", "summary": "A statutory warranty deed of lot 7 to another person.", "kind": "Plat."}'
    assert P.identified(P.FakeChatter([told]), "w" * 300, {"plat": "survey"})["kind"] == "survey" and P.identified(P.FakeChatter([told]), "short", {}) is None
    assert P.engine_named("none", {}) is None and P.engine_named("x", {"x": P.FakeEngine()}).name == "cheap"
    with pytest.raises(ValueError):
        P.engine_named("y", {})
    media = spark.createDataFrame([(1, "auth", None), (2, "auth", bytearray(b"i")), (3, " ", None)], "media_id long, description string, image binary")
    assert {r["media_id"]: r["space"] for r in P.embedded_media(media, P.FakeEmbedder(), P.FakeImageEmbedder(), True).collect()} == {1: "text", 2: "image-aligned"}


def test_streams(spark, tmp_path):
    from textloom.streaming import jobs as S

    src, schema = str(tmp_path / "src"), "k string, seq long, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], schema).write.parquet(src)
    go = lambda: S.folded_log(spark.readStream.schema(schema).parquet(src), ["k"], "seq", str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    go()
    spark.createDataFrame([("b", 9, "w")], schema).write.mode("append").parquet(src)
    go()
    assert {r["k"]: r["v"] for r in S.latest_version(spark, str(tmp_path / "state")).collect()} == {"a": "z", "b": "w"}
    assert S.latest_version(spark, str(tmp_path / "nothing")) is None
    pages_schema = "path string, page int, segments array<string>, continues boolean, last boolean"
    rows = [("d", 1, ["a", "b"], False, False), ("d", 2, ["x" * 3200, "next"], False, False), ("d", 3, ["goes on"], True, True)]
    spark.createDataFrame(rows, pages_schema).coalesce(1).write.parquet(str(tmp_path / "pages"))
    stream = S.assembled_stream(spark.readStream.schema(pages_schema).parquet(str(tmp_path / "pages")))
    stream.writeStream.format("memory").queryName("assembled").trigger(availableNow=True).start().awaitTermination()
    wanted = segments.assembled([(p, s, c) for _, p, s, c, _ in rows])
    assert sorted((r["page"], r["ord"], r["text"]) for r in spark.table("assembled").collect()) == sorted((f["page"], f["ord"], f["text"]) for f in wanted)
    seen = []
    S.drain(spark.readStream.schema(schema).parquet(src), lambda batch, n: seen.append(batch.count()), str(tmp_path / "drained")).awaitTermination()
    assert sum(seen) == 4


def test_index_folders_and_branches(spark, tmp_path):
    from textloom.sources.folder import Indexes, IndexFolder, append_log, legacy_marks, read_log, read_reading, write_reading

    with pytest.raises(FileNotFoundError):
        IndexFolder(spark, str(tmp_path / "none"), read_only=True)
    every = Indexes(spark, str(tmp_path / "i"))
    main = every.open("Main!")
    main.write("documents", spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "path string, title string"))
    main.upsert("documents", spark.createDataFrame([("b", "B2")], "path string, title string"))
    assert {r["path"]: r["title"] for r in main.read("documents").collect()} == {"a": "A", "b": "B2", "c": "C"} and "model" in main.read("documents").columns
    branch = every.fork("work", "main")
    branch.write("documents", spark.createDataFrame([("a", "mine")], "path string, title string"))
    branch.write("tombstones", spark.createDataFrame([("c",)], "path string"))
    assert {r["path"]: r["title"] for r in every.overlaid("work", "documents").collect()} == {"a": "mine", "b": "B2"}
    assert every.names() == ["default", "main", "work"] and every.branches() == {"work": "main"}
    with pytest.raises(ValueError):
        every.delete("main")
    with pytest.raises(ValueError):
        every.fork("work", "main")
    with pytest.raises(PermissionError):
        every.open("main", read_only=True).write("notes", spark.createDataFrame([], "path string"))
    branch.write("fragments", spark.createDataFrame([("a", "a@0", 1, 0, 0, 0, "alpha", None, "")], FRAGMENTS))
    main.write("fragments", spark.createDataFrame([("a", "a@1", 1, 0, 0, 0, "alpha", None, ""), ("b", "b@0", 1, 0, 0, 0, "alpha beta", None, ""), ("c", "c@0", 1, 0, 0, 0, "alpha", None, "")], FRAGMENTS))
    from textloom.engine import Engine, search_all

    engines = {n: Engine.of(every, n) for n in ("main", "work")}
    assert [r["frag_id"] for r in engines["work"].search("alpha").collect()] == ["a@0", "b@0"]
    assert [(r["index"], r["frag_id"]) for r in search_all(engines, "alpha", "w*").collect()] == [("work", "a@0"), ("work", "b@0")]
    assert len(search_all(engines, "beta", limit=3).collect()) == 2
    every.delete("work")
    assert every.names() == ["default", "main"]
    log = str(tmp_path / "log")
    append_log(log, {"a": 1}), append_log(log, {"a": 2})
    assert [e["a"] for e in read_log(log)] == [1, 2] and read_log(f"{log}-none") == []
    write_reading(f"{log}.r", {"units": []}, 2)
    assert read_reading(f"{log}.none") is None and read_reading(f"{log}.r", 2)["units"] == []
    with pytest.raises(ValueError):
        read_reading(f"{log}.r", 1)
    (tmp_path / "marks").write_text('# old\n{"a": "y", "b": "x", "kind": "copy"}\n{"a": "x", "b": "y", "kind": "version"}\n')
    assert [(r["a"], r["b"], r["kind"]) for r in records.marks(legacy_marks(spark, str(tmp_path / "marks"))).collect()] == [("x", "y", "version")]


def test_any_file_to_pages(spark):
    from textloom.providers import FakeEngine
    from textloom.sources.extract import embedded_images, extracted

    jpeg = b"\xff\xd8\xff\xe0rest"
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Type /XObject /Subtype /Image /Filter /DCTDecode >> stream\n" + jpeg + b"\nendstream"
    assert embedded_images(pdf) == [jpeg]
    given = [("a.txt", b"one\ftwo"), ("b.pdf", pdf), ("c.png", b"words"), ("d.doc", b"x"), ("e", b"\x7fELF\x00\x01"), ("f", b"plain"), ("g", b"x" * 6000), ("h.eml", b"Subject: s\nContent-Type: text/plain\n\nhello")]
    rows = extracted(spark.createDataFrame([(p, bytearray(c)) for p, c in given], "path string, content binary"), {"pdf": lambda b: ["a page"]}, FakeEngine()).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["path"]].append(r["text"] if r["error"] is None else "!")
    assert got == {"a.txt": ["one", "two"], "b.pdf": ["a page"], "c.png": ["words"], "d.doc": ["!"], "e": ["!"], "f": ["plain"], "g": ["!"], "h.eml": ["1 messages\npage 2: s", "hello"]}


def test_caption_jobs(spark):
    schema = "path string, state string, force int, error string, enqueued_at long, owner_pid long"
    jobs = spark.createDataFrame([("a", "done", 0, "", 1, 0), ("b", "running", 0, "", 2, 7), ("c", "pending", 0, "", 3, 0)], schema)
    more = records.caption_enqueued(jobs, spark.createDataFrame([("a",), ("b",), ("d",), (" ",)], "path string"), 9, 1)
    assert {r["path"]: (r["state"], r["enqueued_at"]) for r in more.collect()} == {"a": ("pending", 9), "b": ("running", 2), "c": ("pending", 3), "d": ("pending", 9)}
    mine = records.caption_claimed(more, 5, 2)
    assert {r["path"] for r in mine.where("owner_pid = 5").collect()} == {"c", "a"}
    done = records.caption_finished(mine, spark.createDataFrame([("a", "", False), ("c", "short text", True), ("b", "no answer", False), ("d", "", False)], "path string, error string, short boolean"))
    assert {r["path"]: r["state"] for r in done.collect()} == {"a": "done", "b": "error", "c": "skipped", "d": "pending"}
    docs = spark.createDataFrame([("a", "h"), ("b", "h")], "path string, content_hash string")
    assert {r["path"]: r["content_hash"] for r in records.to_reread(docs, docs.where("path = 'a'")).collect()} == {"a": "", "b": "h"}
