"""An index as a folder of versioned tables: opened, migrated, swapped whole, branched."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What an index has at least; a newer program adds columns here, and old tables get them as nulls.
SCHEMAS = {
    "documents": "path string, title string, added_at long, content_hash string, frag_mode string, frag_recipe string, name string, summary string, kind string, source string, model string, text_hash string",
    "fragments": "path string, frag_id string, page int, ord int, start_off int, end_off int, text string, page_spans array<struct<off:int,page:int>>, origin string",
    "vectors": "frag_id string, vector array<float>",
    "media": "media_id string, path string, frag_id string, page int, ord int, kind string, description string, image_path string, box struct<x:double,y:double,w:double,h:double>",
    "media_vectors": "media_id string, space string, vector array<float>",
    "provenance": "path string, page int, engine string, model string, dpi int, image_path string",
    "jobs": "id long, url string, title string, state string, error string, enqueued_at long, started_at long, finished_at long, owner_pid long, fresh int",
    "job_stages": "job_id long, seq int, name string, engine string, state string, detail string, at long",
    "readings": "path string, page int, seq long, text string, by string, note string, read_at string",
    "rulings": "path string, seq long, unit string, kind string, blanket boolean, text string, label string, by string, statement string",
    "withdrawals": "path string, reason string",
    "tombstones": "path string",
    "notes": "path string, page int, text string, by string",
    "caption_jobs": "path string, state string, force int, error string, enqueued_at long, owner_pid long",
    "meta": "key string, value string, at long",
}


def index_name(name: str) -> str:
    return re.sub("[^a-z0-9_-]", "", name.lower()) or "default"


class IndexFolder:
    """The tables of one index under ``path``, each in versions ``v=N``; readers take the newest version that is whole.

    ``read_only`` never creates or writes.  A missing table reads as an empty one.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        if read_only and not self._exists(self.path):
            raise FileNotFoundError(self.path)
        if not read_only:
            self._fs(self.path).mkdirs(self._hadoop(self.path))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs(path).exists(self._hadoop(path))

    def _names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs(path).listStatus(self._hadoop(path))] if self._exists(path) else []

    def _versions(self, name: str) -> list[int]:
        top = f"{self.path}/{name}"
        return sorted(int(n[2:]) for n in self._names(top) if n.startswith("v=") and self._exists(f"{top}/{n}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        """A table, with any column that its program's schema has and the file has not, as nulls."""
        schema = StructType.fromDDL(SCHEMAS[name])
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(f"{self.path}/{name}/v={versions[-1]}")
        for field in schema:
            if field.name not in found.columns:
                found = found.withColumn(field.name, F.lit(None).cast(field.dataType))
        return found

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        """A new whole version of a table; all but the last ``keep`` go."""
        if self.read_only:
            raise PermissionError("the index is open for reading only")
        versions = self._versions(name)
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/v={versions[-1] + 1 if versions else 0}")
        for old in self._versions(name)[:-keep]:
            self._fs(self.path).delete(self._hadoop(f"{self.path}/{name}/v={old}"), True)

    def upsert(self, name: str, rows: DataFrame, key: str = "path") -> None:
        """All rows of each key in ``rows`` replaced by these, in one swap."""
        from textloom.operators.records import replaced

        self.write(name, replaced(self.read(name).select(rows.columns), rows, key))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in SCHEMAS}


class Indexes:
    """The indexes under one folder; a branch is an index with a parent, and shows its parent's rows where it has none of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        return sorted({"default", *(n for n in IndexFolder(self.spark, self.path)._names(self.path) if not n.startswith((".", "_")))})

    def open(self, name: str, read_only: bool = False) -> IndexFolder:
        return IndexFolder(self.spark, f"{self.path}/{index_name(name)}", read_only)

    def _parent_file(self, name: str) -> str:
        return f"{self.path}/{index_name(name)}/_branch"

    def parent(self, name: str) -> str | None:
        top = self.open(name)
        if not top._exists(self._parent_file(name)):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self._parent_file(name)).collect()))["parent"]

    def branches(self) -> dict[str, str]:
        return {n: p for n in self.names() if (p := self.parent(n)) is not None}

    def fork(self, name: str, parent: str) -> IndexFolder:
        name, parent = index_name(name), index_name(parent)
        if name == parent or self.parent(name) is not None:
            raise ValueError(f"{name!r} cannot become a branch of {parent!r}")
        made = self.open(name)
        self.spark.createDataFrame([(json.dumps({"parent": parent}),)], "value string").coalesce(1).write.mode("overwrite").text(self._parent_file(name))
        return made

    def delete(self, name: str) -> None:
        """Remove an index; one that is a parent stays."""
        name = index_name(name)
        if name in self.branches().values():
            raise ValueError(f"{name!r} has branches")
        top = self.open(name)
        top._fs(top.path).delete(top._hadoop(top.path), True)

    def overlaid(self, name: str, table: str) -> DataFrame:
        """A table of a branch over those of its parents, less what it deleted."""
        from textloom.operators.records import ancestors, layered

        chain = ancestors({**dict.fromkeys(self.names()), **self.branches()}, index_name(name))
        opened = [self.open(n) for n in chain]
        hidden = [i.read("documents").select("path").unionByName(i.read("tombstones")) for i in opened]
        return layered([(i.read(table).select(*(c.split()[0] for c in _columns(table))), h) for i, h in zip(opened, hidden)])


def _columns(table: str) -> list[str]:
    return [f"{f.name} x" for f in StructType.fromDDL(SCHEMAS[table])]


def legacy_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks (a, b, kind, supersedes, note, by, seq) of an old log of JSON lines; one without both sides is an error."""
    entry = F.expr("case when trim(value) <> '' and not startswith(ltrim(value), '#') then value end")  # filters may change places: comments never reach the parser
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), entry.alias("value")).where("value is not null")
    rows = lines.select("seq", F.from_json("value", "a string, b string, kind string, supersedes string, note string, by string", {"mode": "FAILFAST"}).alias("x")).select("x.*", "seq")
    whole = (F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != "")
    return rows.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a mark needs both sides"))))


def write_reading(path: str, reading: dict, version: int = 1) -> None:
    """A reading as a JSON file beside its asset, replaced whole."""
    import os

    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump({"version": version, **reading}, f, ensure_ascii=False, indent=1)
    os.replace(f"{path}.part", path)


def read_reading(path: str, version: int = 1) -> dict | None:
    """A reading, or nothing where none was written; one of a newer program is an error."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return None
    if found.get("version", 1) > version:
        raise ValueError(f"{path} was written by a newer program")
    return found


def append_log(path: str, *entries: dict) -> None:
    """Entries at the end of a log of JSON lines."""
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entries))


def read_log(path: str) -> list[dict]:
    """All entries of a log; a malformed line is an error, a missing file an empty log."""
    try:
        with open(path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip() and not line.lstrip().startswith("#")]
    except FileNotFoundError:
        return []
