import random

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import jobs, overlap, search
from textloom.operators.fragments import cut, fragments, reassemble


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_cover_without_gap(spark):
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab\n ") for _ in range(rng.randint(1, 2000)))
        spans = cut(text, 300, 200, 80)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    assert len(cut("x" * 100 + "\n" + "y" * 7, 100, 70, 40)) == 1
    docs = spark.createDataFrame([(1, "line é\n" * 4000), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in reassemble(fragments(docs, "doc_id", "text"), "doc_id").collect()}
    assert got == {1: "line é\n" * 4000} and cut("") == []


def test_round_trip_has_a_row_for_each_text(spark, tmp_path):
    """Empty and null texts, keys that several rows share, and none: the rows of the SQL."""
    from hashlib import sha256

    from textloom import queries

    long = "line é\n" * 4000
    rows = [(1, long), (2, ""), (3, None), (4, long), (4, long + "x"), (4, long), (4, ""), (None, "b"), (None, "c"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = lambda found: sorted(found, key=str)
    got = queries.fragment_round_trip(spark, str(tmp_path))
    assert got.columns == ["doc_id", "digest"]
    assert order(tuple(r) for r in got.collect()) == order((k, None if t is None else sha256(t.encode()).hexdigest()) for k, t in rows)


def test_scalars(spark):
    assert one(spark, T.fold(F.lit("A-b 3,Ç"))) == "ab3ç"
    assert one(spark, T.numeric_tokens(F.lit("1,234,567 and 25.00 or 7"))) == ["1234567", "25.00"]
    assert one(spark, T.html_text(F.lit("<p>a &amp; b</p>\n<script>x</script>"))) == "a &amp; b\nx"
    assert one(spark, T.gibberish(F.lit("zxcv bcdf ghjk lmnp qrst vwxz bbbb cccc"), F.lit(0.9))) == "words"
    assert one(spark, T.gibberish(F.lit(""), F.lit(0.1))) == "ok"
    assert one(spark, T.spelling_mask(F.lit("a 12 b"))) == "a █ b"
    assert one(spark, T.index_name(F.lit("!?"))) == "default"


def test_search(spark):
    docs = spark.createDataFrame([(1, "the auth token"), (2, "deploy the auth auth"), (3, "billing")], "id long, text string")
    hits = search.top(search.bm25(docs, "id", "text", ["auth"]), "id", 5).collect()
    assert [r["id"] for r in hits] == [2, 1] and all(r["score"] > 0 for r in hits)
    fused = search.top(search.fuse([spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, score double")] * 2, "id"), "id", 2).collect()
    assert abs(fused[0]["score"] - 2 / 60) < 1e-12


def test_overlap_and_jobs(spark):
    text = "It is agreed that the parcel of land lies north of the old mill and east of the river bank."
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, "short")], "id long, text string")
    found = overlap.shingles(docs, "id", "text")
    a, b = found.withColumnsRenamed({"id": "a", "at": "at_a"}), found.withColumnsRenamed({"id": "b", "at": "at_b"})
    runs = overlap.runs(a.join(b, "hash").where("a < b")).collect()
    assert [(r["a"], r["b"], r["from_a"]) for r in runs] == [(1, 2, 0)]
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 25)], "k int, lo int, hi int")
    assert overlap.union_length(spans, "k", "lo", "hi").first()["covered"] == 17
    log = spark.createDataFrame([("p", 1, "machine", "a"), ("p", 2, "person", "b"), ("p", 3, "machine", "c")], "page string, seq int, by string, text string")
    assert jobs.active_reading(log, ["page"], "seq", F.col("by") == "person", "text").first()["text"] == "b"
    assert jobs.latest(log, ["page"], F.col("seq"), "text").first()["text"] == "c"


def test_stems(spark):
    from textloom.functions.stem import stem, stems

    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "café": "cafe", "42": "42", "is": "is"}
    assert {w: stem(w) for w in known} == known
    assert one(spark, stems(F.array(F.lit("hopes"), F.lit("hoping")))) == ["hope", "hope"]
    docs = spark.createDataFrame([(1, "Relations hold"), (2, "none"), (3, None)], "id long, text string")
    assert [r["id"] for r in search.bm25(docs, "id", "text", ["relational"], stemmed=True).collect()] == [1]


def test_globs():
    import re

    from textloom.sources.files import glob_pattern

    cases = [("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/a.md", "a.md", True), ("**/a.md", "x/y/a.md", True), ("x/**", "x/y/z", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a+b", "a+b", True), ("a.b", "axb", False)]
    for glob, path, wanted in cases:
        assert bool(re.match(glob_pattern(glob), path)) == wanted, (glob, path)


def test_masks(spark):
    shingled = spark.createDataFrame([(1, i, i) for i in range(200)], "k int, at int, hash long")
    found = overlap.masks(shingled, "k", spark.createDataFrame([(0,), (5,), (150,), (199,)], "hash long"), 32, 16).collect()
    assert sorted((r["lo"], r["hi"]) for r in found) == [(0, 53), (134, 231)]


def test_sheets(spark):
    import io
    import zipfile

    from textloom.sources.sheets import read_sheets

    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="One" r:id="r1"/><sheet name="Gone" r:id="r9"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>1.5</v></c><c t="inlineStr"><is><t>z</t></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("b.xlsx", held.getvalue()), ("bad", b"no"), ("none", None)], "path string, content binary")
    rows = {r["path"]: r for r in read_sheets(files).collect()}
    assert rows["b.xlsx"]["text"] == "## One\n\nname\tab\n1.5\tz" and rows["b.xlsx"]["page"] == 1
    assert rows["bad"]["page"] is None and rows["bad"]["error"] and rows["none"]["error"]


def test_mail(spark):
    from textloom.sources.mail import plain, read_mail

    alternative = b"From a\nSubject: =?utf-8?q?caf=C3=A9?=\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>html</p>\n--B\nContent-Type: text/plain\n\nplain\n>From here\n--B--\n\n"
    file = b"From b\nSubject: two\nContent-Type: multipart/mixed; boundary=C\n\n--C\nContent-Type: text/plain\n\nbody\n--C\nContent-Disposition: attachment; filename=f.txt\n\nxyz\n--C--\n"
    files = spark.createDataFrame([("m", alternative + file), ("e", b""), ("n", None), ("one", b"Subject: s\n\nFrom the top\n")], "path string, content binary")
    rows = {(r["path"], r["page"]): r for r in read_mail(files).collect()}
    assert set(rows) == {("m", 2), ("m", 3), ("one", 2)}
    assert rows["m", 2]["subject"] == "café" and rows["m", 2]["body"].strip() == "plain\nFrom here"
    assert rows["m", 3]["body"].strip() == "body" and rows["m", 3]["attachments"][0]["name"] == "f.txt" and rows["m", 3]["attachments"][0]["bytes"] == 3
    assert plain("a<b<c>d>e\n\n> f") == "a e\nf"
