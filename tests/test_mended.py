"""Names in texts, split archives, and small rules, each against a plain version or fixed facts."""

import io
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import regions as R
from textloom.functions import text as T
from textloom.operators import attest, fragments, queue, records
from textloom.sources import mail, mbox, transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- citations


@pytest.mark.parametrize("chars", [16 << 20, 12])
def test_citations(spark, monkeypatch, chars):
    """Names inside names, shared names, odd case, in one automaton and in several."""
    monkeypatch.setattr(records, "NAME_CHARS", chars)
    rng = random.Random(2)
    names = ["a/deed.pdf", "b/deed.pdf", "b/Lease 7.PDF", "eed", "x/ÉCOLE.txt", "deed", "c/", "own", "é"]
    texts = [("a/deed.pdf", 1, "see Deed.PDF, and the LEASE 7.pdf"), ("own", 1, "I am own"), ("t", 1, None), ("t", 2, ""), ("t", 3, "école.TXT " + "x" * 200 + " deed.pdf deed.pdf")]
    texts += [(f"r{k}", k, "".join(rng.choice(["deed", ".pdf", " ", "é", "lease 7", "\n", "own"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    wanted = set()
    for path in names:
        name = path.rsplit("/", 1)[-1].lower()
        for p, page, text in texts:
            if name and p != path and text and name in text.lower():
                at = text.lower().index(name)
                wanted.add((path, p, page, " ".join(text[max(at - 10, 0) : at + len(name) + 10].split())))
    found = records.citations(spark.createDataFrame([(n,) for n in [*names, "deed"]], "path string"), spark.createDataFrame(texts, "path string, page int, text string"), reach=10)
    got = {tuple(r) for r in found.collect()}
    assert {x[:3] for x in got} == {x[:3] for x in wanted} and len(got) == len(wanted) > 100
    assert {x[3] for x in got if x[1] == "t"} == {x[3] for x in wanted if x[1] == "t"}
    assert records.citations(spark.createDataFrame([], "path string"), spark.createDataFrame(texts, "path string, page int, text string")).collect() == []


# ---------------------------------------------------------------- mail archives


def archive(seed, n=12):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        end = rng.choice(["\n", "\r\n"])
        body = [rng.choice(["text", "From the start", ">From here", ">>From there", "", "", "\r", "a long line " * rng.randint(1, 30)]) for _ in range(rng.randint(0, 9))]
        body = [x if not x.startswith("From ") or rng.random() < 0.5 else ">" + x for x in body]
        out.append(f"From {i}{end}Subject: s{i}{end}{end}" + end.join(body) + end + rng.choice([end, "", end + end]))
    return "".join(out).encode()


def test_archives_cut_anywhere(monkeypatch):
    """Whatever the cuts and the blocks that are read, each message comes once, as the whole archive gives it."""
    for seed in range(25):
        raw = archive(seed)
        wanted = list(mail.split_mbox(raw))
        monkeypatch.setattr(mbox, "BLOCK", 1 + seed * 7)
        for split in (1, 7, 64, 500, len(raw), len(raw) + 9) if seed < 5 else (13, 200):
            found = [m for at in range(0, len(raw), split) for m in mbox.messages_in(io.BytesIO(raw), at, min(at + split, len(raw)))]
            assert [m for _, m in found] == wanted, (seed, split)
            assert [at for at, _ in found] == sorted(at for at, _ in found) and all(raw[at : at + 5] == b"From " for at, _ in found)
    assert list(mbox.messages_in(io.BytesIO(b"Subject: x\n\nFrom y\n"), 0, 4)) == [(0, b"Subject: x\n\nFrom y\n")]
    assert list(mbox.messages_in(io.BytesIO(b"Subject: x\n\nFrom y\n"), 4, 19)) == []


def test_split_archives_read_like_whole_ones(spark, tmp_path):
    attached = b"Subject: m\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhi\n--b\nContent-Disposition: attachment; filename=f.txt\n\nSAME\n--b\nContent-Type: message/rfc822\n\nSubject: inner\n\nnested\n--b--\n"
    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {"one.mbox": archive(1, 30), "deep/two.mbox": b"".join(b"From x\n" + attached + b"\n" for _ in range(3)) + archive(2), "three.eml": attached, "_hidden": b"From x\n", "empty.mbox": b""}
    for name, raw in files.items():
        (tmp_path / "in" / name).write_bytes(raw)
    shown = lambda df: sorted((r["path"].rsplit("/in/")[-1], r["page"], r["subject"], r["sender"], r["body"], [tuple(a) for a in r["attachments"]], r["error"]) for r in df.collect())
    whole = spark.createDataFrame([(f"{tmp_path}/in/{n}", raw) for n, raw in files.items() if n != "_hidden"], "path string, content binary")
    wanted = shown(mail.read_mail(whole))
    for split in (300, 1 << 20):
        assert shown(mbox.read_archives(spark, f"{tmp_path}/in", split)) == wanted
    assert len(wanted) > 40 and spark.read.format("textloom_mbox").option("splitBytes", "300").load(f"{tmp_path}/in/one.mbox").rdd.getNumPartitions() == -(-len(files["one.mbox"]) // 300)
    with pytest.raises(Exception, match="(?i)not.*found"):
        mbox.read_archives(spark, f"{tmp_path}/nowhere").collect()


# ---------------------------------------------------------------- small rules


def test_expected_windows(spark):
    rows = [("hello world", "Hello there"), (None, "abcdef"), ("abcdef", None), ("abcd", "abcd"), ("straße", "STRASSE"), ("aaaaaaaa", "aaaaab"), ("é漢字ab cd", "É漢字AB")]
    got = spark.createDataFrame(rows, "t string, e string").select(R.expected_share(F.col("t"), F.col("e"))).collect()
    assert [round(r[0], 6) for r in got] == [round(2 / 7, 6), 0.0, 0.0, 0.0, 0.0, 0.5, 1.0]
    long = "".join(random.Random(1).choice("ab") for _ in range(200_000))
    assert one(spark, R.expected_share(F.lit(long), F.lit(long))) == 1.0


def test_brackets(spark):
    cases = ["a<b>c", "a<b<c>d>e", "a>b", "<<x", "x>>y", "", "a<b>c<", "<p>\n<q</p>z"]
    def plain(text):
        depth, out = 0, ""
        for c in text:
            if c == "<":
                depth += 1
            elif c == ">":
                depth = max(0, depth - 1)
                out += " " if not depth else ""
            elif not depth:
                out += c
        return out

    assert [T.outside_brackets(c) for c in cases] == [plain(c) for c in cases]
    assert one(spark, T.html_text(F.lit("<" + "x" * 300_000))) == "" and one(spark, T.html_text(F.lit("a <b> c\n <i")) ) == "a   c"


def test_names_and_kinds(spark):
    by = lambda n: one(spark, T.machine_author(F.lit(n)))
    assert by("attest-batch") and by("ocr-1") and by("") and by(None) and not by("attestor") and not by("ann")
    assert one(spark, T.normal_kind(F.lit(" Work Product. "))) == "notes" and one(spark, T.normal_kind(F.lit("deed"))) == "deed"
    assert one(spark, T.junk_share(F.lit("ab\x85\x9f"))) == 0.5 and one(spark, T.junk_share(F.lit("a\tb\n"))) == 0.0
    kinds = [one(spark, T.document_kind(F.lit(p))) for p in ("a.HEIC", "b.textile", "c.csv", "d.mbox", "e.xls", "f.pdf", "g")]
    assert kinds == ["image", "office", "text", "email", "spreadsheet", "pdf", "unknown"]


def test_worst_call_is_told(spark):
    events = spark.createDataFrame([(1, 1, "429", 2.0, 61.4, 429, " slow ", 3), (1, 2, "recovered", 1.0, 10.0, 200, "ok", 0), (2, 1, "recovered", 0.0, 0.0, 200, "", 0), (3, 1, "gave-up", 0.0, 0.0, 0, "", 0)], "job_id int, seq int, kind string, delay double, elapsed double, status int, body string, ahead int")
    told = {r["job_id"]: r["d"] for r in queue.retry_tally(events).select("job_id", queue.retry_detail().alias("d")).collect()}
    assert told == {1: "1×429 (up to 3 ahead), 1 recovered; waited 3s, worst call 61s; last: 429 slow", 3: "1 gave up"}


def test_provenance_tells_the_day_and_the_missing(spark):
    units = spark.createDataFrame([("d", "u", 0, "x", "")], "path string, unit string, ord int, text string, label string")
    log = spark.createDataFrame([("d", 1, "", "affirmed", True, "", "", "ann", "all read", "2024-05-01")], "path string, seq long, unit string, kind string, blanket boolean, text string, label string, by string, statement string, at string")
    documents = spark.createDataFrame([("d",), ("none",)], "path string")
    told = {r["path"]: r["sentence"] for r in attest.provenance(attest.stats(units, log), documents).collect()}
    assert ' It reads: "all read" by ann on 2024-05-01.' in told["d"] and told["none"] == "No reading of this document by a machine is recorded."
    bare = {r["path"]: r["sentence"] for r in attest.provenance(attest.stats(units, log.drop("at"))).collect()}
    assert ' by ann.' in bare["d"] and len(bare) == 1


def test_rows_that_stand_for_files(spark):
    path = F.lit("a/b.pdf")
    name = one(spark, transcripts.stored_name(path))
    assert re.fullmatch(r"[0-9a-f]{8}-b\.pdf", name) and name != one(spark, transcripts.stored_name(F.lit("c/b.pdf")))
    assert one(spark, transcripts.page_image_name(path, F.lit(3), F.lit("image/jpeg"))) == name[:8] + "-p3.jpg" and one(spark, transcripts.page_image_name(path, F.lit(3), F.lit("x"))).endswith("-p3.bin")
    assert fragments.parameters() == (fragments.WINDOW, fragments.STRIDE, fragments.TAIL) and fragments.parameters(1000, 990, 2000, 400) == (400, 300, 400) and fragments.parameters(1, 5)[1] == 1
    assert transcripts.recipe("fixed", 1, 2, 3) != transcripts.recipe("fixed", 1, 2, 4) and len(transcripts.recipe("a", 1, 1, 1)) == 64
    table = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    fresh = spark.createDataFrame([("b", 9), ("b", 8)], "path string, n int")
    assert {tuple(r) for r in attest.projected(table, fresh, fresh).collect()} == {("a", 1), ("b", 9), ("b", 8)}
    assert {tuple(r) for r in attest.projected(table, fresh, fresh.limit(0)).collect()} == {("a", 1)}
    images = spark.createDataFrame([("a", 1, "v", "x.png"), ("a", 2, "v", ""), ("z", 1, "v", "y.png")], "path string, page int, engine string, image_path string")
    assert [tuple(r) for r in records.page_images(table, images).collect()] == [("a", 1, "v", "x.png")]
    sketched = spark.createDataFrame([("b", "r"), ("a", "r"), ("a", "r"), ("c", "old")], "path string, recipe string")
    assert [r[0] for r in records.sketched_paths(sketched, "r").collect()] == ["a", "b"]
    faults = [("", "p", 1, 2), ("i", "", 1, 2), ("i", "p", 0, 2), ("i", "p", 3, 2), ("i", "p", 1, None), ("i", "p", 2, 2)]
    got = spark.createDataFrame(faults, "i string, p string, l int, h int").select(records.slice_fault(*map(F.col, "iplh"))).collect()
    assert [r[0] for r in got] == ["a slice needs an id", "a slice needs a parent", "pages start at 1", "the range runs backwards", "the range runs backwards", None]
    assert one(spark, attest.evidence_holds(F.lit(b"x"), F.upper(F.sha2(F.lit("x"), 256)))) and not one(spark, attest.evidence_holds(F.lit(b"x"), F.lit("0" * 64)))
    jobs = spark.createDataFrame([("a", "done", 1), ("b", "error", 3), ("c", "error", 5), ("d", "error", 5)], "path string, state string, enqueued_at int")
    assert [r["path"] for r in records.caption_jobs_in(jobs, "error", 2).collect()] == ["c", "d"] and records.caption_jobs_in(jobs).count() == 4
