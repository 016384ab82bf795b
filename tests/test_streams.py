"""Folds on streams against the batch folds, however the logs are cut into batches; watched folders over polls and restarts."""

import json
import os
import random

from pyspark.sql import functions as F

from textloom.operators import attest, records
from textloom.sources.watcher import Watcher, changes, listing
from textloom.streaming import folds

UNIT = "array<struct<unit:string,text:string,label:string>>"
LOG = f"path string, seq long, unit string, kind string, blanket boolean, text string, label string, by string, retires array<string>, adds {UNIT}"


def ruling_log(rng, path, n):
    """A document's units and a log with rulings, sweeps, retracts and resegments."""
    out = [(path, 0, "", "units", False, "", "", "", [], [(f"u{k}", f"own {k}", "l") for k in range(4)])]
    for i in range(1, n):
        kind = rng.choice([*attest.KINDS, "retract", "retract", "resegment"])
        if kind == "resegment":
            out.append((path, i, "", kind, False, "", "", "p", [f"u{rng.randint(0, 5)}"], [(f"u{rng.randint(4, 6)}", f"new {i}", "")]))
        else:
            blanket = kind in ("affirmed", "retract") and rng.random() < 0.5
            out.append((path, i, "" if blanket else f"u{rng.randint(0, 6)}", kind, blanket, f"t{i}" if kind == "corrected" else "", "", f"p{i % 3}", [], []))
    return out


def plain(log):
    entries = [dict(zip([f.split()[0] for f in LOG.split(", ")], e)) for e in log]
    units = [dict(zip(("unit", "text", "label"), u)) for u in entries[0]["adds"]]
    rest = [{**e, "adds": [dict(zip(("unit", "text", "label"), u)) for u in e["adds"]]} for e in entries[1:]]
    order, _ = attest.resolve(units, rest)
    return [(e["unit"], i, e["kind"], e["swept"], e["by"], e["seq"], e["text"], e["label"]) for i, e in enumerate(order)]


def batched(spark, folder, rows, schema, cuts):
    """Write rows as one file a batch, in order."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        if b > a:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_folds_are_the_batch_folds(spark, tmp_path):
    folds.stateful(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(3)
    logs = {f"d{k}": ruling_log(rng, f"d{k}", rng.randint(2, 30)) for k in range(12)}
    rows = sorted((e for log in logs.values() for e in log), key=lambda e: (e[1], e[0]))  # documents take turns
    for name, cuts in (("many", [len(rows) // 3, len(rows) // 2, len(rows) - 5]), ("one", [])):
        stream = folds.rulings(batched(spark, f"{tmp_path}/in-{name}", rows, LOG, cuts))
        table = folds.FoldedTable(spark, f"{tmp_path}/t-{name}", ["path", "unit"], f"path string, {folds.UNIT}")
        table.follow(stream, f"{tmp_path}/c-{name}").awaitTermination()
        shown = lambda t: {p: sorted((tuple(r)[1:9] for r in rs), key=lambda r: r[1]) for p in logs for rs in [[x for x in t if x["path"] == p]]}
        wanted = {p: plain(log) for p, log in logs.items()}
        assert shown(table.read().collect()) == wanted
        table.merge()
        assert shown(table.read().collect()) == wanted and len(table._parts()) == 1
    # a restart goes on where it was: one more batch, of one document, changes that one's rows alone
    late = [("d0", 100, "", "affirmed", True, "", "", "late", [], [])]
    spark.createDataFrame(late, LOG).coalesce(1).write.parquet(f"{tmp_path}/in-many/900")
    stream = folds.rulings(spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-many"))
    table = folds.FoldedTable(spark, f"{tmp_path}/t-many", ["path", "unit"], f"path string, {folds.UNIT}")
    table.follow(stream, f"{tmp_path}/c-many").awaitTermination()
    assert shown(table.read().collect()) == {**wanted, "d0": plain([*logs["d0"], late[0]])}
    assert spark.read.parquet(*(f"{tmp_path}/t-many/delta={n}" for n in table._numbers("delta"))).where("path <> 'd0'").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_seats_and_marks(spark, tmp_path):
    folds.stateful(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(8)
    schema = "path string, page int, seq long, text string, by string"
    rows = [(f"d{rng.randint(0, 3)}", rng.randint(1, 3), i, f"v{rng.randint(0, 2)}", rng.choice(["ann", "ocr-x", "attest-y", "ocr-z"])) for i in range(120)]
    table = folds.FoldedTable(spark, f"{tmp_path}/seats", ["path", "page"], f"path string, page int, {folds.READING}")
    table.follow(folds.readings(batched(spark, f"{tmp_path}/readings", rows, schema, [30, 60, 61])), f"{tmp_path}/c1").awaitTermination()
    active = records.versions(spark.createDataFrame(rows, schema)).where("active")
    names = ["path", "page", "seq", "text", "by", "version", "person"]
    assert {tuple(r) for r in table.read().select(names).collect()} == {tuple(r) for r in active.select(names).collect()} != set()
    schema = "a long, b long, kind string, seq int, supersedes string"
    rows = [(rng.randint(0, 4), rng.randint(0, 4), rng.choice(records.MARKS), i, "") for i in rng.sample(range(90), 90)]
    table = folds.FoldedTable(spark, f"{tmp_path}/marks", ["a", "b"], f"a bigint, b bigint, {folds.MARK}")
    table.follow(folds.marks(batched(spark, f"{tmp_path}/log", rows, schema, [10, 50])), f"{tmp_path}/c2").awaitTermination()
    last = records.marks(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in table.read().select("a", "b", "kind", "seq").collect()} == {tuple(r) for r in last.select("a", "b", "kind", "seq").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fold_state_goes_through_json():
    rng = random.Random(5)
    for k in range(20):
        log = ruling_log(rng, "d", 25)
        entries = [dict(zip([f.split()[0] for f in LOG.split(", ")], e)) for e in log]
        entries = [{**e, "adds": [dict(zip(("unit", "text", "label"), u)) for u in e["adds"]]} for e in entries]
        fold = attest.Fold(entries[0]["adds"])
        for e in entries[1:]:
            fold = attest.Fold.restored(json.loads(json.dumps(fold.state())))
            fold.apply(e)
        assert [(s["unit"], i, s["kind"], s["swept"], s["by"], s["seq"], s["text"], s["label"]) for i, s in enumerate(fold.order)] == plain(log)


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "docs"
    index = lambda p: F.when(p.endswith(".md"), "notes").when(p.endswith(".pdf"), "papers")
    new = lambda: Watcher(spark, f"{tmp_path}/state", lambda: listing(spark, str(folder), index))
    told = []
    keep = lambda df: told.append({(r["path"].rsplit("/", 1)[-1], r["index"], r["change"]) for r in df.collect()})
    assert new().poll(keep) == {} and told == []
    (folder / "deep").mkdir(parents=True)
    for name in ("a.md", "b.pdf", "deep/c.md", "skip.bin"):
        (folder / name).write_text(name)
    watcher = new()
    assert watcher.poll(keep) == {"new": 3} and told.pop() == {("a.md", "notes", "new"), ("b.pdf", "papers", "new"), ("c.md", "notes", "new")}
    assert watcher.poll(keep) == {} and not told
    (folder / "a.md").write_text("longer text")
    os.utime(folder / "b.pdf", (1, 1))
    (folder / "deep" / "c.md").unlink()
    (folder / "d.md").write_text("d")

    def broken(df):
        raise RuntimeError("stopped")

    try:
        watcher.poll(broken)
    except RuntimeError:
        pass
    watcher = new()  # a restart: what was not handed on is told again
    assert watcher.poll(keep) == {"changed": 2, "gone": 1, "new": 1}
    assert told.pop() == {("a.md", "notes", "changed"), ("b.pdf", "papers", "changed"), ("c.md", "notes", "gone"), ("d.md", "notes", "new")}
    moved = Watcher(spark, f"{tmp_path}/state", lambda: listing(spark, str(folder), lambda p: F.when(p.endswith("a.md"), "other").when(p.endswith("d.md"), "notes")))
    assert moved.poll(keep) == {"gone": 2, "changed": 1}
    assert told.pop() == {("a.md", "other", "changed"), ("a.md", "notes", "gone"), ("b.pdf", "papers", "gone")}
    assert len(moved._versions()) <= 2 and moved.seen().count() == 2
    for f in folder.glob("*.*"):
        f.unlink()
    assert moved.poll(keep) == {"gone": 2} and moved.poll(keep) == {}
    same = spark.createDataFrame([], "path string, modified timestamp, bytes long, index string")
    assert changes(same, same).collect() == []
