"""Mail archives read by many tasks: a data source whose partitions are byte ranges that begin with the next message."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.operators.prefix import running
from textloom.sources.mail import SCHEMA, messages_of

BLOCK = 1 << 20
SPLIT = 32 << 20
MANY = 256  # ranges from which on neighbours are read as one, up to SPLIT bytes: each costs a task, and its first block
MARK = b"From "

RAW = "path string, start long, message binary"


def _opened(path: str):
    from pyarrow.fs import FileSystem

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    files, inside = FileSystem.from_uri(path)
    return files, inside


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder that are not hidden."""
    from pyarrow.fs import FileSelector, FileType

    files, inside = _opened(path)
    top = files.get_file_info(inside)
    if top.type == FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    found = [top] if top.type == FileType.File else files.get_file_info(FileSelector(inside, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == FileType.File and f.size and not f.base_name.startswith(("_", ".")))


class Lines:
    """Lines of an open file from a place on, with the place of each, by blocks."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, held = self.at, b""
        while block := self.file.read(BLOCK):
            *whole, held = (held + block).split(b"\n")
            for line in whole:
                yield at, line + b"\n"
                at += len(line) + 1
        if held:
            yield at, held


def _after_blank(file, at: int) -> bool:
    """Whether the line at ``at`` is the file's first or comes after a blank one (line ends alone)."""
    if at == 0:
        return True
    seen = b""
    while True:
        low = max(0, at - 64 - 2 * len(seen))
        file.seek(low)
        seen = file.read(at - low)
        line = seen[:-1].rstrip(b"\r")
        if line.endswith(b"\n") or not line:
            if line or low == 0:
                return True
        elif line:
            return False


def _line_from(file, at: int) -> int | None:
    """Where the first line begins that is not before ``at``; None behind the last."""
    if at == 0:
        return 0
    file.seek(at - 1)
    place = at - 1
    while block := file.read(BLOCK):
        end = block.find(b"\n")
        if end >= 0:
            return place + end + 1
        place += len(block)
    return None


def messages_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, message) of the messages of an open archive that begin in [start, end), whole, as ``split_mbox`` gives them.

    A file that does not begin with the mark is one message of its own, in the range that has its first byte.
    """
    file.seek(0)
    if file.read(len(MARK)) != MARK:
        if start == 0:
            file.seek(0)
            yield 0, file.read()
        return
    first = _line_from(file, start)
    if first is None:
        return
    after_blank, began, message = _after_blank(file, first), None, []
    for at, line in Lines(file, first):
        if after_blank and line.startswith(MARK):
            if message:
                yield began, b"".join(message)
            if at >= end:
                return
            began, message, after_blank = at, [], False
            continue
        after_blank = not line.rstrip(b"\r\n")
        if began is None:
            if at >= end:
                return
            continue
        bare = line.lstrip(b">")
        message.append(line[1:] if len(bare) < len(line) and bare.startswith(MARK) else line)
    if message:
        yield began, b"".join(message)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class MboxReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        ranges = sum(-(-size // self.split) for _, size in files)
        joined = self.split * max(1, min(SPLIT // self.split, -(-ranges // MANY)))
        return [Range(path, at, min(at + joined, size)) for path, size in files for at in range(0, size, joined)]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, inside = _opened(partition.path)
        with files.open_input_file(inside) as file:
            for start, message in messages_in(file, partition.start, partition.end):
                yield partition.path, start, message


class MboxSource(DataSource):
    """``spark.read.format("textloom_mbox").load(path)``: path, start and raw bytes of each message; option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "textloom_mbox"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options["path"], int(self.options.get("splitbytes", SPLIT)))


def read_archives(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The rows of ``read_mail`` for archives under ``path``, each read by as many tasks as it has ranges of ``split`` bytes.

    A message is parsed where it is read.  Pages are numbered by running sums, and a
    file's bytes count with its first place in the archive, so no archive is ever in one
    task.  There is no bound on an archive's messages; a message that cannot be read is
    a row with its error.
    """
    spark.dataSource.register(MboxSource)
    raw = spark.read.format("textloom_mbox").option("splitBytes", str(split)).load(path)
    fields = SCHEMA.removeprefix("path string, page int, ")

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, start, message in zip(batch["path"], batch["start"], batch["message"]):
                try:
                    found = [{**m, "error": None} for m in messages_of(bytes(message), whole=True)]
                except ValueError as error:
                    found = [{"subject": None, "sender": None, "sent": None, "body": None, "attachments": [], "error": str(error)}]
                rows += [{"path": path, "start": start, "n": n, **m} for n, m in enumerate(found)]
            if rows:
                yield pd.DataFrame(rows)

    from textloom.plans.tasks import written

    parsed = written(raw.mapInPandas(run, f"path string, start long, n int, {fields}"))
    numbered = running(parsed, ["path"], "start", F.lit(1), "page", ties=("n",)).withColumn("page", (F.col("page") + 1).cast("int"))
    place = F.struct("start", "n", "i")
    files = parsed.select("path", "start", "n", F.posexplode("attachments").alias("i", "f"))
    first = files.groupBy("path", F.col("f.sha256").alias("sha256")).agg(F.min(place).alias("at"))
    counted = files.withColumn("sha256", F.col("f.sha256")).join(first, ["path", "sha256"])
    here = F.struct("start", "n", "i") == F.col("at")
    listed = counted.select("path", "start", "n", "i", F.struct(F.col("f.name").alias("name"), "sha256", F.when(here, F.col("f.bytes")).otherwise(0).alias("bytes")).alias("f"))
    listed = listed.groupBy("path", "start", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "f"))), lambda x: x["f"]).alias("listed"))
    met = numbered.join(listed, ["path", "start", "n"], "left")
    return met.select("path", "page", "subject", "sender", "sent", "body", F.coalesce("listed", F.expr("cast(array() as array<struct<name:string,sha256:string,bytes:bigint>>)")).alias("attachments"), "error")
